"""Continuous ingest: newly arrived plan files replace the current snapshot once they validate."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from convoyspark.operators import derive, validate
from convoyspark.operators.stored import shared_folder
from convoyspark.plans import schema as s
from convoyspark.sinks import snapshots
from convoyspark.sources import files


def _publish(rows: DataFrame, target: str, load: int) -> None:
    """A repeated batch overwrites a folder only before its load is recorded, when nobody reads it."""
    derive.canonical_plans(rows).write.mode("overwrite").parquet(os.path.join(target, f"load_seq={load}"))
    snapshots.record(rows.sparkSession, target, f"load_seq={load}", load)


def _replace(batch: DataFrame, number: int, target: str) -> None:
    """Publish the newest valid load of a batch of rows if it is newer than the current snapshot.

    A load is valid if no numeric cell holds text; what is wrong with the others is kept as findings.
    """
    spark = batch.sparkSession
    if s.ROW not in batch.columns:
        batch = batch.withColumn(s.ROW, F.monotonically_increasing_id())
    loads = batch.groupBy("load_seq").agg(F.max(validate.has_numeric_violation(batch)).alias("bad")).agg(
        F.max(F.when(~F.col("bad"), F.col("load_seq"))).alias("newest"), F.bool_or("bad").alias("any_bad")).head()
    if loads.any_bad:
        _report(validate.numeric_violations(batch, carry=("load_seq",)), target, number)
    if loads.newest is not None and _current_load(spark, target) < loads.newest:
        _publish(batch.where(F.col("load_seq") == loads.newest), target, loads.newest)


def _replace_from_files(batch: DataFrame, number: int, target: str, required: tuple[str, ...]) -> None:
    """Publish the newest valid file of a batch of paths if it is newer than the current snapshot.

    Files are read by the names in their own headers. A file is valid if it has a number, all required columns and some
    rows, all of the header's width and with numbers in numeric cells; what is wrong with the others is kept as findings.
    """
    spark = batch.sparkSession
    arrived = sorted(batch.select("path", "load_seq").collect(), key=lambda r: (r.load_seq is None, -(r.load_seq or 0), r.path))
    published, findings = _current_load(spark, target), []
    for r in arrived:
        if r.load_seq is None:
            found = spark.createDataFrame([("no load number", None, None, None)], validate.FINDING)
        else:
            raw = files.read_csv(spark, r.path, corrupt=True)
            parts = [files.header_report(spark, r.path, required), validate.no_rows(raw.drop(files.CORRUPT)),
                     validate.numeric_violations(raw), validate.width_violations(raw, files.CORRUPT)]
            found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        if not found.isEmpty():
            findings.append(found.withColumns({"load_seq": F.lit(r.load_seq).cast("bigint"), "path": F.lit(r.path)}))
        elif r.load_seq > published:
            _publish(raw.drop(files.CORRUPT), target, r.load_seq)
            published = r.load_seq
    if findings:
        whole = findings[0]
        for f in findings[1:]:
            whole = whole.unionByName(f)
        _report(whole, target, number)


def _report(findings: DataFrame, target: str, number: int) -> None:
    """Each batch has a folder of its own, so a repeated batch writes the same findings again."""
    findings.write.mode("overwrite").parquet(os.path.join(target, "_findings", f"batch={number}"))


def findings(spark: SparkSession, target: str) -> DataFrame:
    """What was wrong with loads that were not published."""
    return spark.read.option("basePath", os.path.join(target, "_findings")).parquet(os.path.join(target, "_findings", "batch=*"))


def _current_load(spark: SparkSession, target: str) -> int:
    last = snapshots.recorded(spark, target)
    return -1 if last is None else last[0]


def current_snapshot(spark: SparkSession, target: str) -> DataFrame:
    """The newest valid load; older ones stay on disk but are not read."""
    newest = _current_load(spark, target)
    return spark.read.parquet(os.path.join(target, f"load_seq={newest}")).withColumn("load_seq", F.lit(newest).cast("bigint"))


def start_ingest(loads: DataFrame, target: str, checkpoint: str, required: tuple[str, ...] = ()) -> StreamingQuery:
    """Run over everything that has arrived, then stop.

    ``loads`` is a streaming DataFrame of plan rows with a ``load_seq``, or of file paths as ``read_plan_stream`` gives
    them. Rows that lack a required column are refused at once; files that do are findings. Each load goes to a folder of its
    own and is only ever published whole, so a repeated batch after a failure writes the same folder again.
    """
    from_files = "path" in loads.columns
    absent = [] if from_files else [c for c in required if c not in loads.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")

    def take(batch: DataFrame, number: int) -> None:
        if from_files:
            _replace_from_files(batch, number, target, required)
        else:
            _replace(batch, number, target)

    return loads.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_plan_stream(spark: SparkSession, folder: str, number: str = r"(\d+)\.csv$") -> DataFrame:
    """Paths of plan CSV files as they arrive; the load number is what ``number`` finds in the path, by default the digits
    that end the file name, null if there are none."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    arrived = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.csv").load(folder)
    return arrived.select("path", F.regexp_extract("path", number, 1).try_cast("bigint").alias("load_seq"))
