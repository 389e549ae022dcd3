"""Data-quality reports over plan tables; one row per finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from convoyspark.functions import geo, text as t
from convoyspark.operators import geometry as g
from convoyspark.plans import schema as s

FINDING = "check string, row bigint, column string, value string"


def missing_columns(df: DataFrame, required: tuple[str, ...] = s.REQUIRED_COLUMNS) -> DataFrame:
    """Required columns the table lacks, in any order."""
    absent = [(c,) for c in required if c not in df.columns]
    names = df.sparkSession.createDataFrame(absent, "column string")
    return names.select(F.lit("missing column").alias("check"), F.lit(None).cast("bigint").alias("row"), "column",
                        F.lit(None).cast("string").alias("value"))


def no_rows(df: DataFrame) -> DataFrame:
    """One finding if the table has a header but no data."""
    counted = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n = 0").selectExpr(
        "'no data' as check", "cast(null as bigint) as row", "cast(null as string) as column", "cast(null as string) as value")


def has_numeric_violation(df: DataFrame, columns: tuple[str, ...] = s.NUMERIC_COLUMNS) -> Column:
    """True for a row with a non-blank cell that is not a number in any numeric column."""
    tests = [t.is_not_numeric(F.col(c).cast("string")) for c in columns if c in df.columns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def numeric_violations(df: DataFrame, columns: tuple[str, ...] = s.NUMERIC_COLUMNS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every non-blank cell of a numeric column that is not a plain number, with the carried columns.

    The cells are tested before they are unpivoted, so only offending ones are
    ever turned into rows.
    """
    present = [c for c in columns if c in df.columns]
    row = F.col(s.ROW) if s.ROW in df.columns else F.lit(None).cast("bigint")
    bad = F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(t.is_not_numeric(F.col(c).cast("string")), F.col(c).cast("string")).alias("value"))
        for c in present])
    return df.select(*carry, row.alias("row"), F.inline(F.filter(bad, lambda x: x["value"].isNotNull()))).select(
        *carry, F.lit("not numeric").alias("check"), "row", "column", "value")


def has_wrong_width(raw: DataFrame, corrupt: str = "_corrupt") -> Column:
    """True for a row whose cell count differs from the header's, as the reader recorded it.

    The reader only notices in columns it parses, so the test mentions all of them.
    """
    cells = F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in raw.columns if c not in (corrupt, s.ROW)])
    return F.when(F.length(cells) >= 0, F.col(corrupt).isNotNull())


def width_violations(raw: DataFrame, corrupt: str = "_corrupt") -> DataFrame:
    """Rows whose cell count differs from the header's."""
    row = F.col(s.ROW) if s.ROW in raw.columns else F.lit(None).cast("bigint")
    return raw.where(has_wrong_width(raw, corrupt)).select(
        F.lit("row width").alias("check"), row.alias("row"), F.lit(None).cast("string").alias("column"),
        F.col(corrupt).alias("value"))


def all_findings(raw: DataFrame, corrupt: str = "_corrupt") -> DataFrame:
    """Every check over one freshly read file."""
    reports = [missing_columns(raw), no_rows(raw.drop(corrupt)), numeric_violations(raw)]
    if corrupt in raw.columns:
        reports.append(width_violations(raw, corrupt))
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def route_checks(plans: DataFrame, near_metres: float = 50.0) -> DataFrame:
    """Endpoint quality of internal paths per plan.

    ``verdict``: missing, unparsable, reversed (its ends fit the plan's ends
    better the other way round), start off, end off, or ok.
    """
    parsed = plans.select(
        *[c for c in (s.ROW, s.SUB, "plan_id") if c in plans.columns],
        t.present(F.col("internal_path")).alias("given"),
        geo.parse_geometry(F.col("internal_path")).alias("path"),
        g.anchor("start").alias("start"), g.anchor("end").alias("end"),
    )
    line = geo.line_points(F.col("path"))
    ends = parsed.withColumn("line", line).withColumns({
        "head": F.try_element_at("line", F.lit(1)), "tail": F.try_element_at("line", F.lit(-1))})
    metres = ends.withColumns({
        "start_gap": geo.distance_m(F.col("head"), F.col("start")),
        "end_gap": geo.distance_m(F.col("tail"), F.col("end")),
        "crossed": geo.distance_m(F.col("tail"), F.col("start")) + geo.distance_m(F.col("head"), F.col("end")),
    })
    verdict = (
        F.when(~F.col("given"), "missing")
        .when(F.col("head").isNull(), "unparsable")
        .when(F.col("crossed") < F.col("start_gap") + F.col("end_gap"), "reversed")
        .when(F.coalesce(F.col("start_gap") > near_metres, F.lit(False)), "start off")
        .when(F.coalesce(F.col("end_gap") > near_metres, F.lit(False)), "end off")
        .otherwise("ok")
    )
    return metres.withColumn("verdict", verdict).drop("line", "path", "given", "crossed")


def route_quality(plans: DataFrame, near_metres: float = 50.0) -> DataFrame:
    """Number of plans per verdict."""
    return route_checks(plans, near_metres).groupBy("verdict").agg(F.count(F.lit(1)).alias("plans"))
