"""Periodic runs: stretches of words that repeat with a period, found exactly with a dictionary of basic factors.

A basic factor is a stretch of ``L`` = 1, 2, 4, ... words. Factors of one length get names, so that equal names mean equal words; the
name of a factor of 2L comes from the names of its halves. Where a factor occurs again within the next L places, the distance to its
successor is a period of the words in between; places in a row whose successors are equally far belong to one arithmetic progression
i, i + q, i + 2q, ... and together reach exactly from the first to the last word of a run:

* Inside a run of smallest period q <= L the successor of every factor is q words on, as a nearer one would make q reducible; a
  run of three periods holds such factors, since L < 2q for the first power of two L >= q.
* One word before or behind the run the words q apart differ, so there the progression ends.

So each period is proposed at one length alone, q <= L < 2q, its progressions are extended as far as they go, and no run is told twice.
Factors that do not occur again in their own text are left out of longer ones, which leaves little after a few rounds.
Many short texts are worked on at once, with an empty place behind each that no factor can cross.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BLOCK_CHARS = 1 << 20  # texts of about so many characters are searched together (one text at least)
SPACES = r"[\x20\x09-\x0D]+"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one after the other, and the bounds between texts; null counts as empty."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), pattern=SPACES)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    filled = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(filled), before[np.concatenate(([0], np.cumsum(sizes)))]


def runs(codes: np.ndarray, bounds: np.ndarray, *, least_length: int, least_exponent: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in this order; equal words have equal ``codes``, text i is ``codes[bounds[i]:bounds[i + 1]]``."""
    if least_exponent < 3:
        raise ValueError("runs of less than three periods are not found")
    lengths = np.diff(bounds)
    first = bounds[:-1] + np.arange(len(lengths))
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    size = len(owner)
    active = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)
    names = codes.astype(np.int64)  # of the factors at the active places
    told, length = [], 1
    while len(active):
        keys = np.sort(names * size + active)
        name, place = keys // size, keys % size
        gap = np.diff(place)
        same = (np.diff(name) == 0) & (owner[place[1:]] == owner[place[:-1]])
        proposed = same & (gap <= length) & (gap > length // 2)
        told.append(_progressions(place[:-1][proposed], gap[proposed], length))
        again = np.zeros(len(place), bool)
        again[1:] |= same
        again[:-1] |= same
        named = np.full(size + length, -1, np.int64)
        named[place[again]] = name[again]
        active = np.sort(place[again])
        active = active[named[active + length] >= 0]
        names = np.unique(named[active] * size + named[active + length], return_inverse=True)[1] if len(active) else active
        length *= 2
    found = np.concatenate(told) if told else np.empty((0, 3), np.int64)
    found = found[found[:, 1] >= np.maximum(least_length, least_exponent * found[:, 2])]
    texts = owner[found[:, 0]]
    table = np.column_stack((texts, found[:, 0] - first[texts], found[:, 1], found[:, 2]))
    return table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))]


def _progressions(places: np.ndarray, gaps: np.ndarray, length: int) -> np.ndarray:
    """Start, length and period of the stretches that successors at ``gaps`` span: neighbouring places with equal gaps make one."""
    order = np.argsort(places)
    places, gaps = places[order], gaps[order]
    heads = np.flatnonzero(np.concatenate(([True], (np.diff(places) != 1) | (np.diff(gaps) != 0)))) if len(places) else places
    ends = np.append(heads[1:], len(places)) - 1 if len(places) else places
    return np.column_stack((places[heads], places[ends] - places[heads] + length + gaps[heads], gaps[heads]))


def _judged(texts: pa.Array, least_length: int, least_exponent: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    flat, bounds = split(texts)
    codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False)
    found = runs(codes, bounds, least_length=least_length, least_exponent=least_exponent)
    starts = bounds[found[:, 0]] + found[:, 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, starts + found[:, 3], 1)
    np.add.at(cover, starts + found[:, 2], -1)
    keep = np.cumsum(cover[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(keep)))[bounds]
    words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(keep)))
    offsets = np.searchsorted(found[:, 0], np.arange(len(bounds)))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(found[:, k], pa.int64()) for k in (1, 2, 3)], fields=list(_RUN)))
    return lists, pc.if_else(pc.is_valid(texts), pc.binary_join(words, " "), pa.scalar(None, pa.string()))


def with_runs(docs: DataFrame, *, text: str = "text", least_length: int = 24, least_exponent: int = 3) -> DataFrame:
    """All columns of ``docs``, ``_runs`` (start, length and period in words, by start, then period) and ``_collapsed``.

    Words lie between ASCII white space. A run is a stretch with smallest period q, at least ``least_length`` words and ``least_exponent``
    periods long, that neither neighbouring word extends. ``_collapsed`` holds the words that no run covers after its first period, joined by
    single spaces. A null text has no runs and collapses to null, a text without words to an empty one. Columns of these two names are
    replaced. Rows are judged alone, so repeated rows have equal answers; whole texts are searched. No shuffle.
    """
    kept = docs.drop("_runs", "_collapsed")
    names, place = kept.columns, kept.columns.index(text)

    def apply(batches):
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_CHARS, "right")))
                part = batch.slice(at, end - at)
                lists, collapsed = _judged(part.column(place), least_length, least_exponent)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, collapsed], [*names, "_runs", "_collapsed"])
                at = end

    empty = (F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("_runs"), F.lit(None).cast("string").alias("_collapsed"))
    return kept.mapInArrow(apply, kept.select("*", *empty).schema)
