"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or below the warehouse (which is shared too) where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet and read back: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that is no longer used back to the machine; a worker goes on to other tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def lean(apply: Callable) -> Callable:
    """``apply`` for ``mapInArrow``, with what its task has used released at the end."""

    def run(batches):
        try:
            yield from apply(batches)
        finally:
            release()

    return run


_shipped: set[str] = set()
_SCRATCH = tempfile.TemporaryDirectory()  # the driver's own; Spark reads the file from here as long as it runs


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the workers, once in an application; Spark serves the file from the driver."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(_SCRATCH.name, f"{os.path.basename(package)}-{application}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)
