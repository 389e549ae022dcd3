"""Best-fit packing of tokenised documents by linear grouping.

Lengths are whole numbers up to the capacity, so all that the plan needs is how many pieces have each length: a
table of at most ``capacity`` rows, whatever the corpus. From it the driver plans *runs*, sets of sequences filled
alike: large lengths are dealt into groups of equal cardinality and rounded up to the largest of the group, a linear
program over the few sizes picks configurations, the slots get the actual lengths of their group, and what is left
(and all small pieces) goes by best fit into the smallest gap that takes it. A run names its pieces by length and
rank; ranks within a length are numbered on the cluster, and each piece looks its place up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens
from .shared import lean, stored

SALTS = 64
SLICE_ROWS = 16  # documents whose ids are held at once; texts go through the encoder in blocks of characters
MEMO_SLOTS = 1 << 19  # workers keep this between stages of a pipeline
GROUPS = 24
LARGE_SHARES = (4, 3, 2)


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id",
           text_column: str = "text", digests: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, ``piece``, ``start``, ``length``, ``ids`` (little-endian 32-bit).

    A document is its text's ids (none for null or empty) and ``end_id``; only longer ones are cut, so that the first piece
    takes the remainder. Repeated rows give repeated pieces; other columns are ignored. With ``digests``, ``ids_crc32`` (the unsigned
    checksum of ``ids``) comes in place of ``ids``, from the same worker: a second one behind it would hold as much memory again.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    last, last_kind = ("ids_crc32", "bigint") if digests else ("ids", "binary")

    def cut(batches):
        encoder = tokens.encoder(tokenizer, MEMO_SLOTS)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                flat, counts = encoder.encode(part.column(1).to_pylist())
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = counts - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                at = np.concatenate(([0], np.cumsum(length))) * 4
                raw = memoryview(flat.tobytes())
                ids = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                told = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digests else pa.array([bytes(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), told],
                    [id_column, "piece", "start", "length", last])

    return docs.select(id_column, text_column).mapInArrow(
        lean(cut), f"`{id_column}` {kind}, piece int, start bigint, length bigint, {last} {last_kind}")


def place(measured: DataFrame, *, capacity: int = 2048, id_column: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table of pieces with ``length`` from 1 to ``capacity``."""
    salt = F.pmod(F.xxhash64(id_column, "piece"), F.lit(SALTS)).cast("int")
    salted = measured.withColumn("_salt", salt)
    counts = stored(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")  # at most capacity * SALTS rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("_n")).collect():
        histogram[length] = n
    table = slots(plan(histogram, capacity))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    offsets = counts.select("length", "_salt", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_column, "piece", *(
        c for c in measured.columns if c not in (id_column, "piece", "length"))))
    ranked = salted.withColumn("_own", own).join(F.broadcast(offsets), ["length", "_salt"]).withColumn(
        "_rank", F.col("_before") + F.col("_own") - 1).select(*measured.columns, "_rank")
    names = measured.columns

    def look_up(batches):
        key = table["length"] << np.int64(44) | table["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = np.searchsorted(key, length << np.int64(44) | rank, "right") - 1
            copy, i = np.divmod(rank - table["rank"][row], table["bins"][row])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(table["sequence"][row] + i), pa.array(table["offset"][row] + copy * length)],
                [*names, "sequence_id", "offset"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema)
    return ranked.mapInArrow(lean(look_up), f"{rest}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """Every piece of every document with its sequence: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. Sequences have no gaps and at most ``capacity`` ids. An empty table gives no rows.
    """
    cut = pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_column=id_column, text_column=text_column, digests=True)
    return place(stored(cut, "pieces"), capacity=capacity, id_column=id_column)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0,
              id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The sequences themselves (``sequence_id``, ``ids``) from documents with distinct ids and what ``pack`` gave for them."""
    cut = pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_column=id_column, text_column=text_column)
    parts = placed.select(id_column, "piece", "sequence_id", "offset").join(cut.select(id_column, "piece", "ids"), [id_column, "piece"])
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids together
    return parts.groupBy("sequence_id").agg(in_order.alias("_p")).select(
        "sequence_id", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


# ---------------------------------------------------------------------------
# The plan, from the histogram of lengths
# ---------------------------------------------------------------------------


@dataclass
class Run:
    """``bins`` sequences filled alike: (length, first rank, copies in each sequence) in order; copy k of bin i has rank first + k * bins + i."""

    bins: int
    items: list[tuple[int, int, int]]
    gap: int


def plan(histogram: np.ndarray, capacity: int) -> list[Run]:
    """The plan with the fewest sequences over what may count as a large piece."""
    plans = [_plan(histogram, capacity, share) for share in LARGE_SHARES]
    return min(plans, key=lambda runs: sum(r.bins for r in runs))


def _plan(histogram: np.ndarray, capacity: int, share: int) -> list[Run]:
    left = histogram.copy()
    next_rank = np.zeros(capacity + 1, np.int64)
    runs = []
    if left[capacity]:
        runs.append(Run(int(left[capacity]), [(capacity, 0, 1)], 0))
        left[capacity] = 0
    open_runs = _large(left, next_rank, capacity, share)
    by_gap: dict[int, list[Run]] = {}
    for run in open_runs:
        by_gap.setdefault(run.gap, []).append(run)
    for length in range(capacity - 1, 0, -1):
        _best_fit(length, left, next_rank, by_gap, capacity)
    return runs + [r for same in by_gap.values() for r in same]


def _best_fit(length: int, left: np.ndarray, next_rank: np.ndarray, by_gap: dict[int, list[Run]], capacity: int) -> None:
    """All pieces of one length: each time the smallest gap that takes one, filled as often as it goes."""
    while left[length] > 0:
        gap = min((g for g, same in by_gap.items() if same and g >= length), default=None)
        each = (capacity if gap is None else gap) // length
        if gap is None:
            run = Run(max(1, int(left[length]) // each), [], capacity)
        else:
            run = by_gap[gap].pop()
        if left[length] < run.bins * each:
            bins = int(left[length]) // each
            if bins == 0:
                bins, each = 1, int(left[length])
            run, rest = split(run, bins)
            if rest:
                by_gap.setdefault(rest.gap, []).append(rest)
        run.items.append((length, int(next_rank[length]), each))
        run.gap -= each * length
        next_rank[length] += run.bins * each
        left[length] -= run.bins * each
        by_gap.setdefault(run.gap, []).append(run)


def split(run: Run, bins: int) -> tuple[Run, Run | None]:
    """The first ``bins`` sequences of a run, and the others. Where an item has several copies, each copy becomes an item."""
    if bins >= run.bins:
        return run, None
    first, rest = [], []
    for length, rank, copies in run.items:
        for k in range(copies):
            first.append((length, rank + k * run.bins, 1))
            rest.append((length, rank + k * run.bins + bins, 1))
    return Run(bins, first, run.gap), Run(run.bins - bins, rest, run.gap)


def _large(left: np.ndarray, next_rank: np.ndarray, capacity: int, share: int) -> list[Run]:
    """Linear grouping of the lengths above ``capacity / share``; takes what it places out of ``left``."""
    lengths = [x for x in range(capacity // share + 1, capacity) if left[x]]
    total = int(sum(left[x] for x in lengths))
    if total == 0:
        return []
    groups: list[list[list[int]]] = [[]]  # of [length, first rank, count], ascending
    most, held = -(-total // GROUPS), 0
    for x in lengths:
        rank, n = 0, int(left[x])
        while n:
            if held == most:
                groups.append([])
                held = 0
            take = min(n, most - held)
            groups[-1].append([x, rank, take])
            rank, n, held = rank + take, n - take, held + take
    sizes = np.array([g[-1][0] for g in groups])
    demand = np.array([sum(n for _, _, n in g) for g in groups])
    runs = []
    for config, times in configurations(sizes, demand, capacity):
        runs += _substitute(config, times, groups, capacity)
    for x in lengths:  # what no configuration took; renumbered behind what was taken
        left[x] = 0
    for g in groups:
        for x, rank, n in g:
            left[x] += n
    kept = _renumber(runs, groups)
    for x, n in kept.items():
        next_rank[x] = n
    return runs


def _substitute(config: np.ndarray, times: int, groups: list[list[list[int]]], capacity: int) -> list[Run]:
    """``times`` sequences with a slot for each size of the configuration, filled with the actual lengths of the groups."""
    slots_: list[list[tuple[int, int, int]]] = []
    for j in np.flatnonzero(config):
        for _ in range(int(config[j])):
            need, got = times, []
            while need and groups[j]:
                x, rank, n = groups[j][-1]  # the largest first
                take = min(n, need)
                got.append((x, rank + n - take, take))
                groups[j][-1][2] -= take
                if not groups[j][-1][2]:
                    groups[j].pop()
                need -= take
            slots_.append(got)
    runs, used = [], [0] * len(slots_)
    while any(slots_):
        live = [i for i, s in enumerate(slots_) if s]
        n = min(slots_[i][0][2] - used[i] for i in live)
        items = []
        for i in live:
            x, rank, count = slots_[i][0]
            items.append((x, rank + used[i], 1))
            used[i] += n
            if used[i] == count:
                slots_[i].pop(0)
                used[i] = 0
        runs.append(Run(n, items, capacity - sum(x for x, _, _ in items)))
    return runs


def _renumber(runs: list[Run], groups: list[list[list[int]]]) -> dict[int, int]:
    """Ranks of each length from 0 without holes, in the order of the runs; the number taken of each length."""
    taken: dict[int, int] = {}
    for run in runs:
        fresh = []
        for x, _, copies in run.items:
            fresh.append((x, taken.get(x, 0), copies))
            taken[x] = taken.get(x, 0) + run.bins * copies
        run.items = fresh
    return taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole parts of an optimal mix of configurations for few sizes: a linear program by column generation,
    new columns from a knapsack over the capacity."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        column, worth = _knapsack(sizes, duals, capacity)
        if worth <= 1 + 1e-9:
            break
        x, step = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, demand.astype(float))
    out, left = [], demand.copy()
    for j in np.argsort(-x):
        config = np.round(basis[:, j]).astype(np.int64)
        used = config > 0
        times = min(int(x[j] + 1e-6), int((left[used] // config[used]).min()))
        if times > 0:
            left -= times * config
            out.append((config, times))
    return out


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.flatnonzero(sizes <= c)
        if len(fits):
            got = best[c - sizes[fits]] + values[fits]
            top = int(np.argmax(got))
            if got[top] > best[c] + 1e-12:
                best[c], pick[c] = got[top], fits[top]
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return column, float(best[capacity])


def slots(runs: list[Run]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: from which rank of which length on, to which sequence and offset."""
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, rank, copies in run.items:
            rows.append((length, rank, run.bins, sequence, offset))
            offset += length * copies
        sequence += run.bins
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bins", "sequence", "offset"), columns))
