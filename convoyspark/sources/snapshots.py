"""Which file or partition of a set of snapshots is the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def latest_snapshot(df: DataFrame, name: str) -> DataFrame:
    """Rows of the snapshot whose name sorts last.

    The maximum is a scalar subquery; on a partition column it prunes the
    other partitions at run time.
    """
    newest = df.agg(F.max(name)).scalar()
    return df.where(F.col(name) == newest)


def latest_file(spark: SparkSession, folder: str, pattern: str, preferred: str | None = None) -> str | None:
    """Path of the newest CSV whose name contains ``pattern``; ``preferred`` wins if it is there.

    Only the listing is read: the content column of the binary source is pruned.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select(
        "path", F.substring_index("path", "/", -1).alias("name"))
    wanted = files.where(F.col("name").contains(pattern) | (F.col("name") == F.lit(preferred or "")))
    row = wanted.orderBy((F.col("name") == F.lit(preferred or "")).desc(), F.desc("name")).select("path").head()
    return row.path if row else None
