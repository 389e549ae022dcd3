"""Mixing sources to target weights by capped water-filling, in built-in expressions.

Targets share a total by weight; a source stops at ``most`` times its size and its excess goes to the others by weight, until none
is above. A source is then repeated whole as often as its target holds, and the rest is drawn from its documents in the order of
a seeded hash. The draw needs no order of whole sources: sizes are summed for 4,096 slices of the hash, and only the slice in
which a source's rest ends is put in order. One more document, the one whose size comes closest to what is still missing, is added
if that brings the source nearer to its target. What is decided is a row for each source; documents only look it up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, SLICE_BITS = 52, 12


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def drawing_hash(doc_id: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to a table of sources (``source``, ``source_size``). Its rows are sources, so one task may order them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    every = Window.partitionBy(F.lit(0))
    filled = sizes.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size")).withColumn(
        "_all", share * F.sum("source_size").over(every))
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    held = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("_all") - held) / F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    leveled = filled.withColumn("_level", level).withColumn("_open", F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.col("_level")))
    water = F.first("_open", ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("target", F.when(F.col("_open").isNull(), F.col("_cap")).otherwise(F.col("_w") * water)).select(
        "source", "source_size", "target")


def decisions(docs: DataFrame, *, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """A row for each source: ``source_size``, ``target``, ``whole`` repetitions, the last (``last_h``, ``last_size``) of the
    documents drawn once more in the order of (hash, size), and the one added (``extra_h``, ``extra_size``, null if none)."""
    rows = stored(docs.select("source", words_in(F.col("text")).alias("size"), drawing_hash(F.col("doc_id"), seed).alias("h")), "sizes")
    slice_ = F.shiftright("h", HASH_BITS - SLICE_BITS)
    slices = stored(rows.groupBy("source", slice_.alias("slice")).agg(F.sum("size").alias("n")), "slices")
    sizes = slices.groupBy("source").agg(F.sum("n").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    aims = stored(targets(sizes, weights, share, most).withColumn("whole", whole).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")), "aims")
    upto = slices.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("slice")))
    beyond = _with(upto, aims).filter("upto > rest")
    ends = stored(beyond.groupBy("source").agg(F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select(
        "source", F.col("e.slice").alias("end_slice"), F.col("e.before").alias("before")), "ends")
    aims = _with(aims, ends, "left")
    edge = _with(rows, aims).filter(slice_ == F.col("end_slice")).groupBy("source", "h", "size", "rest", "before").agg(
        (F.count("*") * F.col("size")).alias("n"))
    edge = edge.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("h", "size"))).filter("upto <= rest")
    last = stored(edge.groupBy("source").agg(F.max(F.struct("h", "size", "upto")).alias("l")), "last")
    nothing = F.coalesce(F.shiftleft(F.col("end_slice").cast("bigint"), HASH_BITS - SLICE_BITS) - 1, F.lit(1 << HASH_BITS))
    drawn = stored(_with(aims, last, "left").select(
        "source", "source_size", "target", "whole",
        F.coalesce("l.h", nothing).alias("last_h"), F.coalesce("l.size", F.lit((1 << 63) - 1)).alias("last_size"),
        (F.col("rest") - F.coalesce("l.upto", "before", F.col("source_size"))).alias("missing")), "drawn")
    left = _with(rows, drawn).filter(~_drawn() & (F.col("size") > 0))
    off = F.abs(F.col("size") - F.col("missing"))
    best = left.filter(off < F.col("missing")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "h", "size")).alias("x"))
    return stored(_with(drawn, best, "left").select(
        "source", "source_size", "target", "whole", "last_h", "last_size", F.col("x.h").alias("extra_h"), F.col("x.size").alias("extra_size")), "mix")


def _with(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """Joins a row for each source, null being one; Spark picks the join by the stored table's size and splits a hot source."""
    other = by_source.withColumnRenamed("source", "_source")
    return rows.join(other, rows["source"].eqNullSafe(other["_source"]), how).drop("_source")


def _drawn() -> Column:
    return (F.col("h") < F.col("last_h")) | ((F.col("h") == F.col("last_h")) & (F.col("size") <= F.col("last_size")))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` and the struct ``_mix``: ``size`` in words (null text: 0), ``source_size``, ``target``, ``taken`` (words the
    mix takes, repeats counted) and ``times`` (how often it takes the row).

    Sources in code point order (null is a source, the last) get ``weights`` in turn. Rows of one id and size are drawn together.
    No document is taken more than ``most`` times rounded up; reruns agree. Sources without words have target 0.
    """
    chosen = decisions(docs, weights=weights, share=share, most=most, seed=seed)
    own = docs.select("source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
                      words_in(F.col("text")).alias("size"), drawing_hash(F.col("doc_id"), seed).alias("h"))
    extra = F.coalesce((F.col("h") == F.col("extra_h")) & (F.col("size") == F.col("extra_size")), F.lit(False))
    times = F.col("whole") + (_drawn() | extra).cast("bigint")
    return _with(own, chosen).select("_row.*", F.struct(
        "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times")).alias("_mix"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    rows = mix(docs, **options).filter("_mix.times > 0")
    return rows.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "_mix.times"))).select(*docs.columns)
