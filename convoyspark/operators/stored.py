"""Tables written to the folder that driver and executors share, so that their size is known before they are joined."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A table of up to this many rows and bytes is broadcast.
FEW_ROWS, FEW_BYTES = 1 << 18, 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the cluster's own setting, or one in the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_work")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet and read back."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(table: DataFrame, size: Column) -> bool:
    """Whether a stored table is small enough to be broadcast; ``size`` is a row's share of bytes."""
    rows, size_ = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).head()
    return rows <= FEW_ROWS and size_ <= FEW_BYTES
