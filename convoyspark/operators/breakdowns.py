"""Breakdowns of pilgrims, buses and trips by period, transport, path, district and entrance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoyspark.functions import text as t
from convoyspark.operators import derive as d
from convoyspark.plans import schema as s

MEASURES = ("pilgrims", "buses", "trips")


def _by(filtered: DataFrame, label: Column, name: str) -> DataFrame:
    df = d.with_measures(filtered).withColumn(name, label)
    aggs = [F.sum(m).alias(m) for m in MEASURES if m in df.columns]
    first = [F.min(s.ROW).alias("first_row")] if s.ROW in df.columns else []
    return df.groupBy(name).agg(*aggs, F.count(F.lit(1)).alias("plans"), *first)


def by_period(filtered: DataFrame) -> DataFrame:
    """All measures by period, in code-unit order of the period text."""
    return _by(filtered, d.period_label(), "period").drop("first_row").orderBy("period")


def by_path(filtered: DataFrame, metric: str = "pilgrims") -> DataFrame:
    """All measures by path, largest first; ties keep the source order."""
    return _by(filtered, d.path_label(), "path").orderBy(F.desc(d.metric_column(metric)), "first_row").drop("first_row")


def by_district(filtered: DataFrame, metric: str = "pilgrims") -> DataFrame:
    """All measures by start district as written, largest first; ties keep the source order."""
    return _by(filtered, d.district_label(), "district").orderBy(
        F.desc(d.metric_column(metric)), "first_row").drop("first_row")


def transport_options(plans: DataFrame) -> DataFrame:
    """Transport types on offer: the fixed menu and whatever the plans contain."""
    menu = plans.sparkSession.createDataFrame([(x,) for x in s.TRANSPORT_TRIPS], "transport string")
    seen = plans.select(F.nullif("transport_type_name", F.lit("")).alias("transport")).where("transport is not null").distinct()
    return menu.union(seen).distinct()


def by_transport(filtered: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Buses by transport type, zero-filled for every option, with the share of all buses."""
    counted = _by(filtered, t.first_filled(F.col("transport_type_name"), s.UNKNOWN), "transport").select("transport", "buses")
    options = transport_options(filtered if plans is None else plans)
    every = Window.partitionBy(F.lit(0))  # a row for each transport type
    counted = counted.withColumn("total", F.sum("buses").over(every))
    return options.join(counted, "transport", "left").withColumn("total", F.max("total").over(every)).select(
        "transport", F.coalesce("buses", F.lit(0.0)).alias("buses"),
        d.share_percent(F.coalesce("buses", F.lit(0.0)), F.col("total")).alias("share_percent"))


def entrance_period(filtered: DataFrame, metric: str = "pilgrims") -> DataFrame:
    """Entrance by period in long form, zero-filled, with a short display label.

    The grid is built from the labels that occur, so the result has
    (entrances x periods) rows whatever the number of plans.
    """
    cells = (
        d.with_measures(filtered)
        .groupBy(d.entrance_label().alias("entrance"), d.period_label().alias("period"))
        .agg(F.sum(d.metric_column(metric)).alias("value"))
    )
    return _zero_filled(cells)


def _zero_filled(cells: DataFrame) -> DataFrame:
    periods = cells.select("period").distinct()
    # Each entrance is paired with the array of all periods (a few dozen labels).
    all_periods = periods.agg(F.array_sort(F.collect_list("period"))).scalar()
    grid = cells.select("entrance").distinct().withColumn("period", F.explode(all_periods))
    return (
        grid.join(cells, ["entrance", "period"], "left")
        .select(
            "entrance", F.regexp_replace("entrance", r"^مدخل\s+", "").alias("short_label"),
            "period", F.coalesce("value", F.lit(0.0)).alias("value"),
        )
        .orderBy("entrance", F.expr("try_cast(period as double)").asc_nulls_last(), "period")
    )


def entrance_period_matrix(filtered: DataFrame, periods: list[str], metric: str = "pilgrims") -> DataFrame:
    """The same figures as one column per given period."""
    df = d.with_measures(filtered).select(
        d.entrance_label().alias("entrance"), d.period_label().alias("period"), F.col(d.metric_column(metric)).alias("value"))
    return df.groupBy("entrance").pivot("period", periods).sum("value").na.fill(0.0, periods).orderBy("entrance")


def breakdowns(filtered: DataFrame, metric: str = "pilgrims") -> DataFrame:
    """Period, path, district and entrance-by-period breakdowns in one pass.

    Rows are first summed on the combined labels (a bounded number of
    combinations, combined map-side), and only those sums go through the
    grouping sets, so the plans themselves are not multiplied.
    """
    fine = (
        d.with_measures(filtered)
        .groupBy(d.period_label().alias("period"), d.path_label().alias("path"),
                 d.district_label().alias("district"), d.entrance_label().alias("entrance"))
        .agg(F.sum(d.metric_column(metric)).alias("value"))
    )
    sets = fine.groupingSets(
        [[F.col("period")], [F.col("path")], [F.col("district")], [F.col("entrance"), F.col("period")]],
        F.col("period"), F.col("path"), F.col("district"), F.col("entrance"),
    ).agg(F.grouping_id("period", "path", "district", "entrance").alias("gid"), F.sum("value").alias("value"))
    kind = (
        F.when(F.col("gid") == 0b0111, "period").when(F.col("gid") == 0b1011, "path")
        .when(F.col("gid") == 0b1101, "district").otherwise("entrance")
    )
    label = F.coalesce("path", "district", "entrance", "period")
    return sets.select(
        kind.alias("dimension"), label.alias("label"),
        F.when(kind == "entrance", F.col("period")).alias("period"), "value",
    )


def share_of_total(counted: DataFrame, label: str, value: str) -> DataFrame:
    """Whole-percent share of the overall total, and share of the overall maximum."""
    total, top = counted.agg(F.sum(value)).scalar(), counted.agg(F.max(value)).scalar()
    return counted.select(
        label, value,
        d.share_percent(F.col(value), total).alias("share_percent"),
        F.when(top > 0, F.least(F.lit(1.0), F.col(value) / top)).otherwise(F.lit(0.0)).alias("share_of_max"),
    )
