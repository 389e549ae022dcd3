"""Readers of plan, camp and residence CSV, point JSON and GeoJSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.errors import AnalysisException

from convoyspark.functions import text as t
from convoyspark.operators import derive
from convoyspark.plans import schema as s

#: Column that holds the text of a row whose width differs from the header's.
CORRUPT = "_corrupt"

CAMERA_SCHEMA = ("name string, latitude double, longitude double, altitude double, "
                 "direction string, type string, location string, shortName string")
GATE_SCHEMA = ("camp_label string, gate_number string, type string, transport_mode string, nationality string, "
               "piligrim_type string, capacity bigint, source string, latitude double, longitude double")

PLAN_SCHEMA = ", ".join(f"{c} {'double' if c in s.DOUBLE_COLUMNS else 'string'}" for c in s.REQUIRED_COLUMNS) + f", {s.ROW} bigint"
CAMP_SCHEMA = ("camp_label string, service_company_name string, office_number string, nationality string, "
               "service_center_name string, piligrim_type string, transport_mode string, platform_name string, "
               f"number_of_piligrim double, {s.ROW} bigint")
RESIDENCE_SCHEMA = ("license_number string, residence_name string, pilgrims_count double, service_company string, "
                    "service_center_name string, service_center_number string, tarwiyah_count double, "
                    f"taseed_count double, {s.ROW} bigint")
FEATURE_SCHEMA = f"properties map<string,string>, geom_text string, {s.ROW} bigint"


def _or_empty(spark: SparkSession, read, schema: str, strict: bool) -> DataFrame:
    """The table, or an empty one when the path is missing and ``strict`` is off."""
    try:
        return read()
    except AnalysisException as e:
        if strict or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# Possessive repeats, as others take stack for each step of a long cell.
_FIRST_RECORD = r"""^\uFEFF?((?:"[^"]*+(?:""[^"]*+)*+"|[^"\r\n]++)*+)"""
_CELLS = r"""(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^,]*)"""


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: ``file`` and the cells of its header in order, white space tidied.

    Only lines of a file's first block are looked at, and no more than its header's are shuffled. A first line with an open quote goes
    on to the next line that has an odd number of quotes.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.where("at = 0").withColumn("i", F.monotonically_increasing_id())
    odd = lines.where((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1)
    odd = odd.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("i"))).where("nth <= 2")
    odd = odd.groupBy("file").agg(F.min("i").alias("opens"), F.max("i").alias("closes"))
    ends = lines.groupBy("file").agg(F.min("i").alias("start")).join(odd, "file", "left")
    ends = ends.select("file", F.when(F.col("opens") == F.col("start"), F.col("closes")).otherwise(F.col("start")).alias("end"))
    first = lines.join(F.broadcast(ends), "file").where("i <= end")  # a row for each file
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]), "\n")
    record = F.regexp_extract(text, _FIRST_RECORD, 1)
    bare = lambda c: F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')), r"\s+", " "))
    return first.groupBy("file").agg(F.transform(F.regexp_extract_all(record, F.lit(_CELLS), F.lit(1)), bare).alias("cells"))


def header_report(spark: SparkSession, path: str, required: tuple[str, ...] = s.REQUIRED_COLUMNS) -> DataFrame:
    """Required columns that a file's header lacks, in any order and also under their human headings; a row per file and column."""
    has = lambda c: F.array_contains("cells", c) | F.array_contains("cells", s.PLAN_ALIASES.get(c, c))
    absent = F.array_compact(F.array(*[F.when(~has(c), F.lit(c)) for c in required]))
    return headers(spark, path).select(
        F.lit("missing column").alias("check"), F.lit(None).cast("bigint").alias("row"), F.explode(absent).alias("column"),
        F.element_at(F.split("file", "/"), -1).alias("value"))


def _with_row(df: DataFrame, ranks: DataFrame | None) -> DataFrame:
    """Add ``_row``: position in the source, files in order of their names.

    A multi-line file is never split, so the position within a partition grows
    along each file; the file's rank goes in front of it.
    """
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    if ranks is None:
        return df.withColumn(s.ROW, within)
    placed = df.withColumns({"file_": F.col("_metadata.file_path"), "within_": within})
    joined = placed.join(ranks, "file_", "left")
    rank = F.coalesce("rank_", F.raise_error(F.concat(F.lit("no rank for file "), "file_")).cast("bigint"))
    return joined.withColumn(s.ROW, rank * F.lit(1 << 33) + F.col("within_")).drop("file_", "rank_", "within_")


def read_csv(spark: SparkSession, path: str | list[str], corrupt: bool = False) -> DataFrame:
    """All-text CSV: quoted cells may hold line breaks, blank cells are null.

    Columns go by the name in each file's own header, in any order; files with the same header are read together.
    With ``corrupt``, rows of the wrong width keep their text in a column of that name.  ``multiLine`` makes
    one task per file, so large inputs should come as many files.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    if not corrupt and len(spark.read.text(path).inputFiles()) <= 1:
        return _with_row(spark.read.options(**options).csv(path), None)
    found = headers(spark, path).groupBy("cells").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    if not found:  # files without a line
        return _with_row(spark.read.options(**options).csv(path), None)
    names = sorted(f for row in found for f in row.files)
    ranks = spark.createDataFrame([(f, i) for i, f in enumerate(names)], "file_ string, rank_ bigint")
    parts = []
    for row in sorted(found, key=lambda r: r.files[0]):
        plain = spark.read.options(**options).csv(row.files)
        if corrupt:
            fields = [StructField(c, StringType()) for c in plain.columns] + [StructField(CORRUPT, StringType())]
            plain = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).schema(StructType(fields)).csv(row.files)
        parts.append(_with_row(plain, ranks if len(names) > 1 else None))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def read_plans(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Canonical plans of one snapshot."""
    return _or_empty(spark, lambda: derive.canonical_plans(read_csv(spark, path), fill=True), PLAN_SCHEMA, strict)


def _tidy_header(df: DataFrame) -> DataFrame:
    """Header cells may hold line breaks and trailing blanks; unnamed columns are dropped."""
    named = df.toDF(*[" ".join(c.split()) for c in df.columns])
    return named.drop(*[c for c in named.columns if c.startswith("_c") and c[2:].isdigit()])


def read_camps(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Camp assignments."""
    return _or_empty(spark, lambda: derive.canonical_camps(_tidy_header(read_csv(spark, path))), CAMP_SCHEMA, strict)


def read_residences(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Residence assignments (the byte-order mark and the unnamed columns disappear)."""
    return _or_empty(spark, lambda: derive.canonical_residences(_tidy_header(read_csv(spark, path))), RESIDENCE_SCHEMA, strict)


def _read_points(spark: SparkSession, path: str, schema: str, strict: bool) -> DataFrame:
    return _or_empty(spark, lambda: spark.read.schema(schema).option("multiLine", True).json(path), schema, strict)


def read_cameras(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return _read_points(spark, path, CAMERA_SCHEMA, strict)


def read_gates(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Gates of both kinds; columns a kind does not have are null."""
    return _read_points(spark, path, GATE_SCHEMA, strict)


def read_features(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Features of GeoJSON collections: properties as a map and the geometry as text.

    ``_row`` numbers a file's features from 0 and goes on over files in the order of their paths, a step of 2^33 a file, so
    that first-row-wins rules hold over several files.  A collection is one JSON value and read by one task, which suits
    files of up to some hundred MB; larger layers should come as several files.
    """

    def read() -> DataFrame:
        schema = "features array<struct<properties:map<string,string>,geometry:string>>"
        whole = spark.read.schema(schema).option("multiLine", True).json(path).select("features", F.col("_metadata.file_path").alias("file"))
        listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))  # no content is read
        places = listed.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("bigint").alias("place"))
        features = whole.join(places, "file").select("place", F.posexplode_outer("features").alias("pos", "f")).where("pos is not null")
        return features.select(F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geom_text"),
                               (F.shiftleft("place", 33) + F.col("pos")).alias(s.ROW))

    return _or_empty(spark, read, FEATURE_SCHEMA, strict)


def _property(*names: str):
    return t.first_filled(*[F.col("properties").getItem(n) for n in names])


def districts(features: DataFrame) -> DataFrame:
    """Districts by the first non-empty of three name properties."""
    return features.select(
        F.coalesce(_property("Discription_AR", "discription", "Name"), F.lit("")).alias("district_name"), "geom_text", s.ROW)


def exit_routes(features: DataFrame) -> DataFrame:
    return features.select(s.ROW, _property("camp_label").alias("camp_label"), _property("ASMCODE").alias("exit_code"),
                           _property("MINASM").alias("route_name"), "geom_text")


def exit_points(features: DataFrame) -> DataFrame:
    return features.select(s.ROW, _property("MINASM_Code").alias("exit_code"), _property("MINASM_Name").alias("exit_name"), "geom_text")


def camp_paths(features: DataFrame) -> DataFrame:
    return features.select(s.ROW, _property("camp_label").alias("camp_label"), _property("ASM_CODE").alias("entrance_code"),
                           _property("MAKARF").alias("path_code"), "geom_text")
