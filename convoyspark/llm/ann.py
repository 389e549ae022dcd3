"""Approximate nearest neighbours by learned partitions, under the largest inner product.

A neighbour graph of a bounded sample is cut into parts of equal size with few edges between them; a small neural network learns
which part a vector belongs to, puts every vector of the table into its most probable partition, and routes a query to the
several most probable ones, where candidates are ranked by exact products. Partitions are searched in blocks of bounded size, so
one that holds a third of all rows is many tasks. Equal vectors are one candidate until the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import stored

SAMPLE = 8192
GRAPH_NEIGHBOURS = 16
PART_ROWS, MOST_PARTS = 2048, 256
FEW_PARTS, FEW_ROWS = 8, 32  # of small tables, too, so many parts are made, unless these would have fewer rows
HIDDEN, EPOCHS = 128, 20
TARGET_RECALL, TRIALS = 0.96, 512
BLOCK_ROWS = 4096
EXACT_ROWS = 8192  # products summed exactly at once


@dataclass
class Router:
    layers: list[np.ndarray]

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        """Partitions of each vector, the most probable first."""
        a, b, c, d = self.layers
        return np.argsort(-(np.maximum(vectors @ a + b, 0) @ c + d), axis=1, kind="stable")


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(vectors), min(k, len(vectors) - 1)), np.int64)
    for i in range(0, len(vectors), 512):
        products = vectors[i : i + 512] @ vectors.T
        products[np.arange(len(products)), np.arange(i, i + len(products))] = -np.inf
        out[i : i + 512] = np.argpartition(-products, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Equal halves along the main direction, again and again; then swaps of vertices that have more neighbours elsewhere."""
    part = np.zeros(len(vectors), np.int64)
    width = 1
    while width < parts:
        for p in range(width):
            own = np.flatnonzero(part == p)
            centred = vectors[own] - vectors[own].mean(0)
            _, _, axes = np.linalg.svd(centred.T @ centred)
            order = own[np.argsort(centred @ axes[0], kind="stable")]
            part[order[len(order) // 2 :]] += width
        width *= 2
    for _ in range(rounds):
        votes = np.zeros((len(vectors), parts))
        for column in graph.T:
            votes[np.arange(len(vectors)), part[column]] += 1
            np.add.at(votes, (column, part), 1)
        own = votes[np.arange(len(vectors)), part]
        want = votes.argmax(1)
        gain = votes.max(1) - own
        moves = np.flatnonzero((want != part) & (gain > 0))
        moves = moves[np.argsort(-gain[moves], kind="stable")]
        waiting: dict[tuple[int, int], list[int]] = {}
        swapped = 0
        for v in moves.tolist():  # two vertices that want each other's place swap, so sizes stay
            other = waiting.get((want[v], part[v]))
            if other:
                u = other.pop(0)
                part[u], part[v] = part[v], part[u]
                swapped += 1
            else:
                waiting.setdefault((part[v], want[v]), []).append(v)
        if swapped < len(vectors) // 500:
            break
    return part


def fit(vectors: np.ndarray, parts: int, seed: int = 5) -> Router:
    rng = np.random.default_rng(seed)
    n, dims = vectors.shape
    if n < 2 * parts:
        parts = 1
    target = balanced_parts(vectors, neighbour_graph(vectors, GRAPH_NEIGHBOURS), parts) if parts > 1 else np.zeros(n, np.int64)
    scale = 1 / max(1e-12, float(np.sqrt((vectors**2).mean())))
    layers = [rng.normal(0, np.sqrt(2 / dims), (dims, HIDDEN)) * scale, np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    t = 0
    for _ in range(EPOCHS * -(-SAMPLE // n) if parts > 1 else 0):  # about as many steps for a small sample
        order = rng.permutation(n)
        for i in range(0, n, 256):
            batch = order[i : i + 256]
            x = vectors[batch]
            inner = np.maximum(x @ layers[0] + layers[1], 0)
            z = inner @ layers[2] + layers[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), target[batch]] -= 1
            p /= len(batch)
            back = (p @ layers[2].T) * (inner > 0)
            t += 1
            for j, g in enumerate((x.T @ back, back.sum(0), inner.T @ p, p.sum(0))):  # Adam
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                rate = 0.003 * (scale if j == 0 else 1)
                layers[j] -= rate * (first[j] / (1 - 0.9**t)) / (np.sqrt(second[j] / (1 - 0.999**t)) + 1e-12)
    return Router(layers)


def probes_for(router: Router, vectors: np.ndarray, k: int) -> int:
    """How many partitions hold the target share of the nearest neighbours of some of the sample within the sample. Neighbours
    in the whole table are closer, so they are rather easier to find."""
    if len(vectors) < 2:
        return 1
    ranked = router.ranked(vectors)
    own, trials = ranked[:, 0], np.arange(0, len(vectors), max(1, len(vectors) // TRIALS))
    products = vectors[trials] @ vectors.T
    products[np.arange(len(trials)), trials] = -np.inf
    near = np.argsort(-products, axis=1, kind="stable")[:, : min(k, len(vectors) - 1)]
    place = np.argsort(ranked[trials], axis=1)  # of each partition among those of the query
    depth = np.take_along_axis(place, own[near], 1)
    recall = [(depth < m).mean() for m in range(1, ranked.shape[1] + 1)]
    return 1 + int(np.argmax(np.array(recall) >= TARGET_RECALL))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part."""
    rows = vectors.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(good)
    common = rows.groupBy(F.size("vector").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(1).collect()
    return rows.filter(F.size("vector") == (common[0]["k"] if common else 0))


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query among all other rows: ``query_id``, ``rank`` (from 1), the id and ``score``.

    ``is_query`` is a condition on ``id``. Rows take part if their id and vector are not null, no component is null or not finite, not all are
    zero, and the length is the most common one. Score is the inner product in double precision; ties go to smaller ids; fewer
    candidates give fewer rows. Repeated rows of one id are candidates of one another's queries only by another id.
    """
    same = Window.partitionBy("vector").orderBy("id")
    rows = stored(usable(vectors, id_column, vector_column), "vectors").distinct()
    # Of equal vectors no more than these can be among the nearest, the query aside; Spark drops the others before the shuffle.
    members = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    tops = stored(members.groupBy("vector").agg(F.min("id").alias("top"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    n = tops.count()
    sample = tops.orderBy(F.xxhash64("top", F.lit(3)), "top").limit(SAMPLE).select("vector").collect()
    parts = 1 << max(0, min(MOST_PARTS, max(n // PART_ROWS, min(FEW_PARTS, n // FEW_ROWS))).bit_length() - 1)
    matrix = np.array([r["vector"] for r in sample], float)
    router = fit(matrix, parts) if sample else Router([])
    probes = probes_for(router, matrix, k) if sample else 1
    kind = rows.schema["id"].dataType.simpleString()
    indexed = stored(_routed(tops.select(F.col("top").alias("id"), "vector"), router, 1, kind), "index")
    held = np.zeros(parts, np.int64)
    for r in indexed.groupBy("part").count().collect():
        held[r["part"]] = r["count"]
    asked = stored(_routed(rows.filter(is_query), router, probes, kind, held, k + 1), "asked")
    number = lambda name: F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name)
    sizes = stored(indexed.groupBy("part").agg(number("blocks")).join(asked.groupBy("part").agg(number("shares")), "part"), "sizes")
    by_part = F.broadcast(sizes)  # a row for each partition; a block of candidates meets a share of queries in a task
    candidates = indexed.join(by_part, "part").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    spread = asked.join(by_part, "part").withColumn("share", F.pmod(F.xxhash64("id", F.lit(9)), "shares").cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def best(left, right):
        return _best(left, right, k)

    keys = ("part", "block", "share")
    near = spread.select(*keys, "id", "vector").groupBy(*keys).cogroup(candidates.select(*keys, "id", "vector").groupBy(*keys)).applyInArrow(
        best, f"query_id {kind}, top {kind}, score double")
    expanded = near.join(tops.select("top", "ids"), "top").select("query_id", F.explode("ids").alias("id"), "score").filter("query_id <> id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return expanded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_column), "score")


def _routed(rows: DataFrame, router: Router, probes: int, kind: str, held: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """Each row once for each of its ``probes`` most probable partitions, and for more of them until these have ``least`` vectors by ``held``."""

    def route(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ranked = router.ranked(_matrix(part.column(1)))
                take = np.arange(ranked.shape[1]) < np.full((len(ranked), 1), probes)
                if held is not None:
                    take |= held[ranked].cumsum(1) - held[ranked] < least
                at = pa.array(np.nonzero(take)[0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(ranked[take].astype(np.int32))], ["id", "vector", "part"])

    return rows.mapInArrow(route, f"id {kind}, vector array<double>, part int")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """Of one block of candidates the nearest ``k + 1`` of each query (which may be among them), with products summed alike everywhere."""
    schema = pa.schema([("query_id", queries.schema.field("id").type), ("top", candidates.schema.field("id").type), ("score", pa.float64())])
    if not queries.num_rows or not candidates.num_rows:
        return schema.empty_table()
    q, c = _matrix(queries["vector"]), _matrix(candidates["vector"])
    ids = candidates["id"].to_numpy()
    most, longest = min(k + 1, len(c)), np.sqrt((c**2).sum(1).max())
    rows, tops, scores = [], [], []
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        fast = part @ c.T
        # Both sums of a product are this near to each other; who may be among the nearest by exact sums stays, ties included.
        slack = 4 * c.shape[1] * np.finfo(float).eps * np.sqrt((part**2).sum(1)) * longest
        row, near = np.nonzero(~(fast < (np.partition(fast, -most, axis=1)[:, -most] - slack)[:, None]))
        exact = np.concatenate([(part[row[j : j + EXACT_ROWS]] * c[near[j : j + EXACT_ROWS]]).sum(1) for j in range(0, len(row), EXACT_ROWS)])
        order = np.lexsort((ids[near], -exact, row))
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < most]  # row is sorted, before and after
        rows.append(i + row[order])
        tops.append(near[order])
        scores.append(exact[order])
    return pa.Table.from_arrays(
        [queries["id"].take(pa.array(np.concatenate(rows))), candidates["id"].take(pa.array(np.concatenate(tops))), pa.array(np.concatenate(scores))],
        schema=schema)
