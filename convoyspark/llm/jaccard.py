"""Set-similarity join of documents on word n-grams: rare-first prefix filtering, then length, positional and suffix filters.

All sets get one global order of n-grams, rare ones first. Two sets with a Jaccard similarity of at least the threshold share
an n-gram among the first few of each (the prefix), so prefixes are joined instead of sets. Frequencies come from a table of
counters of fixed size over the hashes of *all* n-grams; counters that happen to be shared only change the order, and any order
gives the same links. Equal sets are one node from the start. The suffix filter bounds the symmetric difference of two sets
from below by the differing bits of their parity sketches.

N-grams whose prefix rows name the same nodes (as those of one shared passage do) are one: a single n-gram of each such list of
nodes goes on, so two nodes meet once per list and not once per n-gram. The filters hold at any n-gram that two prefixes share,
so no link is lost.

Not all pairs of a large group are listed. First every node is compared with its neighbour and with the most central node in each
n-gram's group, and what is linked becomes one component; then all remaining pairs *between* components are compared. So large
groups of near copies cost about their size, and no link that would join two components is lost. Two nodes of different components
meet at the least n-gram that both have: each row has the few least n-grams of its node, and a row beyond one that both nodes list
is passed over. Pairs are distinct before sketches are looked up, and only what passes them has its sets compared, once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import ragged
from .components import components
from .shared import lean, stored

COUNTER_BITS = 22
COUNTERS_PER_ROW = 1 << 16
SKETCH_LONGS = 8
MOST_SKETCH_BITS = 20
FAN_IN = 256
BROADCAST_ROWS = 1 << 20
BLOCK_CHARS = 1 << 17
LISTED = 16  # least n-grams that a row has of its node; two nodes that share none of these may meet more than once
SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]
_PLACE = ragged.mix(np.arange(1001, 1129, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams: A-Z lower-cased, words between ASCII white space.
    With fewer words the whole sequence is one; without words the set is empty."""
    out = []
    for start, stop in ragged.blocks(texts, BLOCK_CHARS):
        data, bounds = ragged.joined(texts[start:stop])
        data = ragged.LOWER_AZ[data]
        starts, ends, counts = ragged.words(data, bounds)
        h = ragged.hashes(data, starts, ends)
        n = max(0, len(h) - words + 1)
        grams = np.full(n, words, np.uint64)
        for j in range(words):
            grams += h[j : j + n] * _PLACE[j]
        grams = ragged.mix(grams)
        at = 0
        for k in counts.tolist():
            if k >= words:
                out.append(np.unique(grams[at : at + k - words + 1]))
            elif k:
                out.append(ragged.mix((h[at : at + k] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += k
    return out


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the number of tokens that fall on b, so differing bits never exceed differing tokens. Larger sets
    have more bits; halves can be folded together."""
    bits = 1 << min(MOST_SKETCH_BITS, max(6 + SKETCH_LONGS.bit_length() - 1, (4 * len(tokens)).bit_length()))
    at = ragged.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _differing(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def _signatures(docs: DataFrame, sets_of) -> DataFrame:
    """A row for each document (set size, 128-bit digest, sketch), and rows with each task's counters of n-grams."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "n_shingles", "d1", "d2", "sketch", *SKETCH, "task", "block", "counts"]

    def measure(batches):
        totals = np.zeros(1 << COUNTER_BITS, np.int64)
        task, id_type = TaskContext.get().partitionId(), None
        for batch in batches:
            id_type = batch.column(0).type
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = sets_of(part.column(1).to_pylist())
                tokens = np.concatenate(sets)
                at, times = np.unique(tokens >> np.uint64(64 - COUNTER_BITS), return_counts=True)
                totals[at.astype(np.int64)] += times
                d1 = np.array([x.sum(dtype=np.uint64) for x in sets]).view(np.int64)
                d2 = np.array([ragged.mix(x ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) for x in sets]).view(np.int64)
                sketches = [_sketch(x) for x in sets]
                bits = np.array([_folded(x, 8 * SKETCH_LONGS) for x in sketches]).view(np.int64)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(d1), pa.array(d2),
                     pa.array([x.tobytes() for x in sketches], pa.binary()), *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(SKETCH_LONGS)),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], columns)
        if id_type is None:
            return
        for block in range(0, len(totals), COUNTERS_PER_ROW):
            raw = _packed(totals[block : block + COUNTERS_PER_ROW])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_type), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), *(pa.nulls(1, pa.int64()) for _ in SKETCH),
                 pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([raw], pa.binary())], columns)

    sketch = ", ".join(f"{c} bigint" for c in SKETCH)
    return docs.mapInArrow(lean(measure), f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, sketch binary, {sketch}, task int, block int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return zlib.compress(at.astype("<u2").tobytes() + counts[at].astype("<u8").tobytes(), 1)


def _order(signatures: DataFrame) -> np.ndarray:
    """For each counter the logarithm of its count in eighths, as bytes: 2**COUNTER_BITS of them, whatever the corpus."""

    def add(pdf):
        total = np.zeros(COUNTERS_PER_ROW, np.int64)
        for raw in pdf["counts"]:
            raw = zlib.decompress(raw)
            k = len(raw) // 10
            total[np.frombuffer(raw, "<u2", k)] += np.frombuffer(raw, "<u8", k, 2 * k).astype(np.int64)
        return pdf[["task", "block"]].head(1).assign(counts=[_packed(total)])

    kind = "task int, block int, counts binary"
    parts = signatures.filter("block IS NOT NULL").select((F.col("task") % FAN_IN).alias("task"), "block", "counts")
    some = parts.groupBy("block", "task").applyInPandas(add, kind)
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for row in some.groupBy("block").applyInPandas(add, kind).collect():  # one row for each block of counters
        raw = zlib.decompress(row["counts"])
        k = len(raw) // 10
        counts = np.frombuffer(raw, "<u8", k, 2 * k).astype(np.float64)
        out[row["block"] + np.frombuffer(raw, "<u2", k).astype(np.int64)] = np.minimum(255, np.round(8 * np.log2(1 + counts)))
    return out


def _prefixes(docs: DataFrame, sets_of, order: np.ndarray, percent: int) -> DataFrame:
    """The rarest n-grams of each set, as many as any set similar enough must meet."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out, sizes = [], []
                for x in sets_of(part.column(1).to_pylist()):
                    n = len(x)
                    sizes.append(n)
                    size = n - -(-n * percent // 100) + 1 if n else 0
                    rank = order[(x >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                    out.append(x[np.argsort(rank, kind="stable")[:size]].view(np.int64))  # x is sorted: ties in hash order
                at = np.concatenate(([0], np.cumsum([len(x) for x in out])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(out))),
                     pa.array(sizes, pa.int64())], ["doc_id", "prefix", "n"])

    return docs.mapInArrow(lean(cut), f"doc_id {kind}, prefix array<bigint>, n bigint")


def _token_sets(docs: DataFrame, sets_of) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def all_tokens(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = sets_of(part.column(1).to_pylist())
                at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))],
                    ["node", "tokens"])

    return docs.mapInArrow(lean(all_tokens), f"node {kind}, tokens array<bigint>")


def _may_link(x: str, y: str, percent: int):
    """Length, positional and suffix filters for rows that share an n-gram; ``x`` and ``y`` are prefixes of column names."""
    nx, ny, px, py = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
    length = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    most = F.least(px, py) + F.least(nx - px, ny - py)
    position = (100 + percent) * most >= percent * (nx + ny)
    differing = sum((F.bit_count(F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}"))) for s in SKETCH[1:]),
                    F.bit_count(F.col(f"{x}{SKETCH[0]}").bitwiseXOR(F.col(f"{y}{SKETCH[0]}"))))
    return length & position & ((100 + percent) * differing <= (100 - percent) * (nx + ny))


def _few(rows: DataFrame) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has at most ``BROADCAST_ROWS`` of them; beyond that joins shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _ends(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select("x").union(pairs.select("y")).distinct().toDF("doc_id"), "ends")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, sets_of, percent: int, confirm) -> DataFrame:
    """Those of the stored, distinct pairs (``x`` < ``y``) whose sets are similar enough and, if asked for, that ``confirm`` keeps.
    Sketches go first; sets are made again only for what passes them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def near(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            most = ((100 - percent) * (batch.column("m").to_numpy() + batch.column("n").to_numpy())).tolist()
            rows = [i for i, limit in enumerate(most) if (100 + percent) * _differing(a[i], b[i]) <= limit]
            yield batch.select(["x", "y"]).take(pa.array(rows, pa.int64()))

    own = classes.join(_few(_ends(pairs)), F.col("node") == F.col("doc_id"), "left_semi")
    left = own.select(F.col("node").alias("x"), F.col("n_shingles").alias("m"), F.col("sketch").alias("a"))
    right = own.select(F.col("node").alias("y"), F.col("n_shingles").alias("n"), F.col("sketch").alias("b"))
    sized = pairs.join(left, "x").join(right, "y").select("x", "y", "m", "n", "a", "b")
    pairs = stored(sized.filter(100 * F.least("m", "n") >= percent * F.greatest("m", "n")).mapInArrow(lean(near), f"x {kind}, y {kind}").distinct(), "near")
    kept = docs.join(_few(_ends(pairs)), "doc_id", "left_semi").select("doc_id", "text")
    sets = stored(_token_sets(kept, sets_of), "sets")
    left, right = sets.select(F.col("node").alias("x"), F.col("tokens").alias("tx")), sets.select(F.col("node").alias("y"), F.col("tokens").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty")).cast("bigint")
    union = F.size("tx") + F.size("ty") - both
    linked = pairs.join(left, "x").join(right, "y").filter(100 * both >= percent * union).select("x", "y").distinct()
    return confirm(linked, kept) if confirm else linked


def similar(docs: DataFrame, *, words: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when the Jaccard similarity of their sets of word n-grams is at least ``percent`` / 100. Empty
    and null texts have an empty set and link with nothing. Repeated rows are equal sets, and rows that share an id are one
    document. Rows with a null id join the component of equal sets (null where there are none with an id). Other columns are
    ignored; an empty table gives no rows.
    """
    found = linked_sets(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")),
                        lambda texts: shingle_sets(texts, words), percent)
    return found.select(F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def linked_sets(docs: DataFrame, sets_of, percent: int, confirm=None) -> DataFrame:
    """``doc_id``, set size ``n`` and ``component_id`` for each row of ``docs`` (``doc_id``, ``text``). ``sets_of`` makes sorted distinct
    64-bit hashes of each of a list of texts; ``confirm(pairs, docs)`` may drop pairs of similar sets that are not to link."""
    signatures = stored(_signatures(docs, sets_of), "signatures")
    own = signatures.filter("block IS NULL").drop("task", "block", "counts")
    digest = ["n_shingles", "d1", "d2"]
    classes = stored(own.filter("n_shingles > 0").groupBy(*digest).agg(
        F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), *(F.first(c).alias(c) for c in SKETCH)).filter("node IS NOT NULL"), "classes")
    found = components(_links(docs, own, signatures, classes, sets_of, percent, confirm))
    of_class = classes.join(found, "node", "left").select(*digest, F.coalesce("component", "node").alias("_component"))
    alone = own.filter("n_shingles = 0").select("doc_id", F.col("n_shingles").alias("n"), F.col("doc_id").alias("component_id"))
    full = own.filter("n_shingles > 0").join(of_class, digest, "left").select("doc_id", F.col("n_shingles").alias("n"), F.col("_component").alias("component_id"))
    return full.unionByName(alone)


def _links(docs: DataFrame, own: DataFrame, signatures: DataFrame, classes: DataFrame, sets_of, percent: int, confirm) -> DataFrame:
    nodes = classes.select(F.col("node").alias("doc_id")).distinct()
    copies = stored(own.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(nodes, "doc_id", "left_anti"), "copies")
    singles = docs.filter("doc_id IS NOT NULL").join(_few(copies), "doc_id", "left_anti")
    prefixes = _prefixes(singles.select("doc_id", "text"), sets_of, _order(signatures), percent)
    rows = prefixes.select(F.col("doc_id").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    group = Window.partitionBy("token")
    met = _one_per_list(rows)
    met = met.withColumn("b", F.lag("node").over(group.orderBy("n", "node"))).withColumn("c", F.first("node").over(group.orderBy("pos", "n", "node")))
    met = stored(met, "shared")
    first = _pairs(met.select("node", F.explode(F.array("b", "c")).alias("other")), "node", "other")
    links = stored(_verified(first, docs, classes, sets_of, percent, confirm), "links")
    label = stored(components(links), "labels")
    spread = met.drop("b", "c").join(_few(label), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    spread = spread.withColumn("_a", F.min("comp").over(group)).withColumn("_b", F.max("comp").over(group)).filter("_a < _b").drop("_a", "_b")
    spread = stored(spread, "spread")
    tagged = stored(spread.join(classes.select("node", *SKETCH), "node").join(_least(spread, own), "node", "left"), "between")
    fields = ["node", "n", "pos", *SKETCH, "comp", "least"]
    x, y = (tagged.select("token", *(F.col(f).alias(f"{p}{f}") for f in fields)) for p in ("x", "y"))
    met_at = F.array_min(F.array_intersect("xleast", "yleast"))
    apart = x.join(y, (x["token"] == y["token"]) & (F.col("xcomp") < F.col("ycomp")) & _may_link("x", "y", percent)
                   & (x["token"] <= F.coalesce(met_at, x["token"])))
    return links.unionByName(_verified(_pairs(apart, "xnode", "ynode"), docs, classes, sets_of, percent, confirm))


def _one_per_list(rows: DataFrame) -> DataFrame:
    """Rows (``node``, ``n``, ``pos``, ``token``) of n-grams with two rows or more, of one n-gram for each list of nodes that n-grams have.
    Lists are told apart by their length and by sums of four 31-bit hashes of their nodes, so that repeated rows count, too."""
    group = Window.partitionBy("token")
    halves = [f(F.xxhash64("node", F.lit(seed))) for seed in (1, 2) for f in (lambda h: h.bitwiseAND(0x7FFFFFFF), lambda h: F.shiftrightunsigned(h, 33))]
    count, *sums = F.count("*").over(group), *(F.sum(h).over(group) for h in halves)
    met = rows.select("*", count.alias("_n"), *(s.alias(f"_s{i}") for i, s in enumerate(sums))).filter("_n > 1")
    met = stored(met.select(*rows.columns, F.xxhash64("_n", "_s0", "_s1").alias("l1"), F.xxhash64("_n", "_s2", "_s3").alias("l2")), "met")
    kept = met.groupBy("l1", "l2").agg(F.min("token").alias("token")).select("token")
    return met.drop("l1", "l2").join(kept, "token", "left_semi")


def _least(rows: DataFrame, own: DataFrame) -> DataFrame:
    """``node`` and ``least``, the ``LISTED`` least n-grams that rows name it for. Ids of several documents are left out: what one of their
    texts shares says nothing about the others."""
    repeated = own.select("doc_id").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("node"))
    least = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("token")), 1, LISTED).alias("least"))
    return least.join(repeated, "node", "left_anti")


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return stored(rows.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct(), "pairs")
