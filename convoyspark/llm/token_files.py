"""Token ids in files of independently coded blocks.

A file is a sequence of frames, each a block of whole documents: header, document table and coded ids, with a CRC-32
over all of it, so that any block can be read (and found broken) alone. Frames are rows of Parquet files, because
Spark's writer commits those safely when tasks are repeated and works on every store.

The coder is an adaptive context-mixing range coder. An id may be predicted by the two ids before it (order 2) or by
the one before it (order 1); the weights of both predictions are learned for each pair of confidences, and the rest of the
range goes to adaptive counts of all ids (order 0). Models start afresh in each block. To run in numpy, a block is cut
into lanes that are coded in step: each lane has a range coder of its own, all share the models, and the models learn
after each step. Everything is integer arithmetic, so that reader and writer agree exactly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import ragged, tokens

BLOCK_IDS = 1 << 20
STEPS = 256
MOST_LANES = 4096
MAGIC = b"TIB1"
HEAD = struct.Struct("<4sIQQIIII")  # magic, documents, ids, ids of the file before, vocabulary, lanes, digits, crc
HASH_BITS = 18
ADD, MOST_COUNT = 24, 1 << 24


class Models:
    """What reader and writer learn alike: predictions by context, their weights, and counts of all ids."""

    def __init__(self, vocabulary: int, lanes: int):
        self.size = vocabulary
        self.counts = np.ones(vocabulary, np.int64)
        self.upto = np.arange(vocabulary + 1, dtype=np.uint64)
        self.one = np.zeros(vocabulary, np.int64)  # predicted id * 4 + confidence
        self.two = np.zeros(1 << HASH_BITS, np.int64)
        self.seen, self.hits = np.zeros(16, np.int64), np.zeros((2, 16), np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self):
        """For each lane the ids predicted by order 2 and order 1, and the upper ends of their shares of 65,536."""
        self.at = (self.last * 0x9E3779B1 + self.before * 0x85EBCA77 >> 7) & ((1 << HASH_BITS) - 1)
        self.by_two, self.by_one = self.two[self.at], self.one[self.last]
        self.context = (self.by_two & 3) << 2 | self.by_one & 3
        weights = 1 + self.hits * 65_000 // (self.seen + 2)
        ends = np.cumsum(weights, axis=0).astype(np.uint64)
        return self.by_two >> 2, self.by_one >> 2, ends[0][self.context], ends[1][self.context]

    def learn(self, ids: np.ndarray, hit_two: np.ndarray, hit_one: np.ndarray) -> None:
        context = self.context
        self.seen += np.bincount(context, minlength=16)
        self.hits[0] += np.bincount(context[hit_two], minlength=16)
        self.hits[1] += np.bincount(context[hit_one], minlength=16)
        self.two[self.at] = _next(self.by_two, ids)
        self.one[self.last] = _next(self.by_one, ids)
        self.counts += ADD * np.bincount(ids, minlength=self.size)
        np.cumsum(self.counts, out=self.upto[1:].view(np.int64))
        if self.upto[-1] > MOST_COUNT:
            self.counts = (self.counts + 1) >> 1
            np.cumsum(self.counts, out=self.upto[1:].view(np.int64))
        self.before, self.last = self.last, ids


def _next(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A prediction grows surer when right, less sure when wrong, and gives way when it was not sure."""
    sure = held & 3
    right = held >> 2 == ids
    return np.where(right, held + (sure < 3), np.where(sure > 0, held - 1, ids << 2 | 1))


_LOW, _FULL = np.uint64(1 << 32), np.uint64(1 << 48)
_16, _32, _MASK16, _MASK32 = np.uint64(16), np.uint64(32), np.uint64(0xFFFF), np.uint64((1 << 32) - 1)
_65536 = np.uint64(65536)


def _share(unit: np.ndarray, end_one: np.ndarray, total: np.uint64) -> np.ndarray:
    """Width of one order-0 count, rounded down by one unit more, as the quotient is rounded too."""
    return (unit * (_65536 - end_one) / float(total)).astype(np.uint64) - np.uint64(1)


def _grid(n: int) -> tuple[int, int]:
    lanes = min(MOST_LANES, max(1, n // STEPS))
    return lanes, -(-n // lanes) if n else 0


def encode(ids: np.ndarray, vocabulary: int) -> tuple[int, bytes]:
    """Number of 16-bit digits, and lane lengths and digits as bytes."""
    lanes, steps = _grid(len(ids))
    table = np.zeros(lanes * steps, np.int64)
    table[: len(ids)] = ids  # the last lane is filled up with id 0
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    models = Models(vocabulary, lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    out_lane, out_digit = [], []
    for now in table:
        two, one, end_two, end_one = models.predict()
        hit_two = now == two
        hit_one = (now == one) & ~hit_two
        unit = width >> _16
        rest = _share(unit, end_one, models.upto[-1])
        first = models.upto[now]
        miss = ~(hit_two | hit_one)
        low = low + np.where(miss, unit * end_one + rest * first, np.where(hit_one, unit * end_two, np.uint64(0)))
        width = np.where(miss, rest * (models.upto[now + 1] - first), unit * np.where(hit_two, end_two, end_one - end_two))
        small = np.flatnonzero(width < _LOW)
        while small.size:
            part = low[small]
            out_lane.append(small)
            out_digit.append(part >> _32)  # may carry into the digit before
            low[small] = (part & _MASK32) << _16
            width[small] <<= _16
            small = small[width[small] < _LOW]
        models.learn(now, hit_two, hit_one)
    for digit in (low >> _32, low >> _16 & _MASK16, low & _MASK16):
        out_lane.append(np.arange(lanes))
        out_digit.append(digit)
    lane, digit = np.concatenate(out_lane).astype(np.uint16), np.concatenate(out_digit)
    order = np.argsort(lane, kind="stable")
    lane, digit = lane[order], digit[order]
    while True:
        carry = digit >> _16
        if not carry.any():
            break
        digit &= _MASK16
        digit[:-1] += np.where(lane[:-1] == lane[1:], carry[1:], np.uint64(0))
    return len(digit), np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + digit.astype("<u2").tobytes()


def decode(raw: bytes, n: int, vocabulary: int) -> np.ndarray:
    lanes, steps = _grid(n)
    lengths = np.frombuffer(raw, "<u4", lanes).astype(np.int64)
    digits = np.append(np.frombuffer(raw, "<u2", offset=4 * lanes), 0).astype(np.uint64)
    at = np.cumsum(lengths) - lengths
    code = digits[at] << _32 | digits[at + 1] << _16 | digits[at + 2]
    at += 3
    width = np.full(lanes, _FULL)
    models = Models(vocabulary, lanes)
    out = np.empty((steps, lanes), np.int64)
    for t in range(steps):
        two, one, end_two, end_one = models.predict()
        unit = width >> _16
        upper = unit * end_one
        middle = unit * end_two
        hit_two = code < middle
        hit_one = ~hit_two & (code < upper)
        rest = _share(unit, end_one, models.upto[-1])
        miss = np.flatnonzero(code >= upper)
        now = np.where(hit_two, two, one)
        below = (code[miss] - upper[miss]) // rest[miss]
        found = np.searchsorted(models.upto, below, "right") - 1
        now[miss] = found
        base = np.where(hit_two, np.uint64(0), middle)
        width = np.where(hit_two, middle, upper - middle)
        first = models.upto[found]
        base[miss] = upper[miss] + rest[miss] * first
        width[miss] = rest[miss] * (models.upto[found + 1] - first)
        code = code - base
        small = np.flatnonzero(width < _LOW)
        while small.size:
            code[small] = code[small] << _16 | digits[at[small]]
            at[small] += 1
            width[small] <<= _16
            small = small[width[small] < _LOW]
        models.learn(now, hit_two, hit_one)
        out[t] = now
    return out.T.reshape(-1)[:n]


def frame(doc_ids: list, counts: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """A block of whole documents; a null id is written as the empty text, others in their text form."""
    names = [b"" if d is None else str(d).encode() for d in doc_ids]
    table = np.concatenate((counts, [len(x) for x in names])).astype("<u4").tobytes() + b"".join(names)
    vocabulary = int(ids.max(initial=0)) + 1
    digits, coded = encode(ids, vocabulary)
    body = struct.pack("<I", len(table)) + table + coded
    head = (MAGIC, len(names), len(ids), before, vocabulary, _grid(len(ids))[0], digits)
    return HEAD.pack(*head, zlib.crc32(HEAD.pack(*head, 0) + body)) + body


def read_frame(raw: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Document ids in text form (or null), ids per document, all ids, and the ids of the file before this block."""
    magic, n_docs, n, before, vocabulary, lanes, digits, crc = HEAD.unpack_from(raw)
    body = raw[HEAD.size :]
    if magic != MAGIC or zlib.crc32(HEAD.pack(magic, n_docs, n, before, vocabulary, lanes, digits, 0) + body) != crc:
        raise ValueError("broken block of token ids")
    size = struct.unpack_from("<I", body)[0]
    numbers = np.frombuffer(body, "<u4", 2 * n_docs, 4).astype(np.int64)
    counts, ends = numbers[:n_docs], np.cumsum(numbers[n_docs:]) + 4 + 8 * n_docs
    names = [body[e - k : e].decode() or None for e, k in zip(ends.tolist(), numbers[n_docs:].tolist())]
    return names, counts, decode(body[4 + size :], n, vocabulary) if n else np.zeros(0, np.int64), before


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the ids of all texts (null: none), each followed by ``end_id``, in ascending order of ids, nulls first.

    Files hold consecutive ranges of ids. Other columns are ignored; repeated rows are repeated; an empty table gives no frames.
    """

    def code(batches):
        encoder, file = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        names, counts, flats, held, block, done = [], [], [], 0, 0, 0

        def emit():
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([frame(names, np.concatenate(counts), np.concatenate(flats), done)], pa.binary()), pa.array([held], pa.int64())],
                ["file", "block", "frame", "n_ids"])

        for part in (batch.slice(i, 512) for batch in batches for i in range(0, batch.num_rows, 512)):
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for start, stop in ragged.blocks(texts, BLOCK_IDS // 2):
                flat, n = encoder.encode(texts[start:stop])
                names += ids[start:stop]
                flats.append(np.insert(flat, np.cumsum(n), end_id).astype(np.int64))
                counts.append(n + 1)
                held += len(flats[-1])
                if held >= BLOCK_IDS:
                    yield emit()
                    names, counts, flats, held, block, done = [], [], [], 0, block + 1, done + held
        if names:
            yield emit()

    ordered = docs.select(id_column, text_column).repartitionByRange(F.col(id_column).asc_nulls_first()).sortWithinPartitions(
        F.col(id_column).asc_nulls_first(), text_column)
    ordered.mapInArrow(code, "file int, block int, frame binary, n_ids bigint").write.parquet(path)


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``ids`` (little-endian 32-bit)."""

    def open_frames(batches):
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, counts, ids, before = read_frame(raw)
                at = np.concatenate(([0], np.cumsum(counts)))
                flat = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(before + at[:-1], pa.int64()),
                     pa.array([flat[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())],
                    ["file", "name", "own", "ids"])

    frames = spark.read.schema("file int, block int, frame binary, n_ids bigint").parquet(path)
    rows = frames.select("file", "frame").mapInArrow(open_frames, "file int, name string, own bigint, ids binary")
    totals = frames.groupBy("file").agg(F.sum("n_ids").alias("_n"))  # a row for each file
    before = totals.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "file").select(
        F.col("name").cast(id_type).alias("doc_id"), (F.col("_before") + F.col("own")).alias("start"), "ids")


def with_digests(docs: DataFrame) -> DataFrame:
    """``ids`` replaced by their number and unsigned checksum."""

    def sums(batches):
        for batch in batches:
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array([len(x.as_buffer()) // 4 for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sums, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
