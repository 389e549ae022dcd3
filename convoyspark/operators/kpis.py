"""Headline figures over plans and camp assignments.

Distinct counts over several columns are computed by stacking the values as
``(kind, value)`` rows and grouping them: partial aggregation removes repeats
before the only large shuffle, and no set is ever held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convoyspark.functions import text as t
from convoyspark.operators import derive as d
from convoyspark.operators.filters import PlanFilter, entity_condition, filter_layers, without_domestic


def _stacked(kinds: list[tuple[str, Column]]) -> Column:
    """Array of (kind, value) structs, without the null values."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds])
    return F.filter(rows, lambda r: r["value"].isNotNull())


def distinct_by_kind(df: DataFrame, kinds: list[tuple[str, Column]], sums: tuple[str, ...] = (),
                     maxima: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ``(kind, value)`` pairs, and one row of kind ``total``.

    ``sums`` are added up under ``total`` only, ``maxima`` are taken per pair;
    so one scan gives the plain sums and every distinct count.  A kind may be
    listed twice: its columns then count as one set.
    """
    total = F.array(F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("value")))
    stacked = df.select(*sums, *maxima, F.explode(F.concat(total, _stacked(kinds))).alias("r"))
    is_total = F.col("r.kind") == "total"
    return stacked.groupBy(F.col("r.kind").alias("kind"), F.col("r.value").alias("value")).agg(
        F.count(F.when(is_total, F.lit(1))).alias("rows"),
        *[F.sum(F.when(is_total, F.col(c))).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in maxima],
    )


def _count(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def headline_kpis(filtered: DataFrame) -> DataFrame:
    """Pilgrims, buses, trips, plans and distinct camps, residences and centers."""
    at = lambda end: F.when(
        F.col(f"{end}_point_type") == "residence", F.nullif(f"{end}_point_name", F.lit("")))
    pairs = distinct_by_kind(
        d.with_measures(d.with_entity_keys(filtered)),
        [
            ("camp", F.when(t.truthy(F.col("camp_label")), F.col("camp_label"))),
            ("residence", at("start")),
            ("residence", at("end")),
            ("center", F.when(t.truthy(F.col("owner_office_number")), F.col("center_key"))),
        ],
        sums=("pilgrims", "buses", "trips"),
    )
    return pairs.agg(
        *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in ("pilgrims", "buses", "trips")],
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("plans"),
        _count("camp").alias("camps"), _count("residence").alias("residences"), _count("center").alias("centers"),
    )


def _camp_grain(df: DataFrame) -> DataFrame:
    """Rows reduced to one per (label, center, assignment) with the largest allocation."""
    keyed = d.with_allocated(d.with_assignment_key(df))
    number = F.coalesce(*[F.col(c) for c in ("office_number", "owner_office_number") if c in df.columns])
    company = F.coalesce(*[F.col(c) for c in ("service_company_name", "owner_company_name") if c in df.columns], F.lit(""))
    has_center = t.trim_ws(number) != ""
    return keyed.groupBy(
        F.when(t.truthy(F.col("camp_label")), t.trim_ws(F.col("camp_label"))).alias("label"),
        F.when(has_center, d.center_key(company, number)).alias("center"),
        "assignment_key",
    ).agg(F.count(F.lit(1)).alias("rows"), F.max("allocated").alias("allocated"))


def camp_label_parts(df: DataFrame) -> DataFrame:
    """Distinct numerators and denominators of the camp labels, as a sorted ``(kind, value)`` table."""
    parts = df.select(d.camp_label_parts(F.col("camp_label")).alias("p")).where(
        (F.col("p.numerator") != "") & (F.col("p.denominator") != ""))
    kinds = [("numerator", F.col("p.numerator")), ("denominator", F.col("p.denominator"))]
    return parts.select(F.explode(_stacked(kinds)).alias("r")).select("r.kind", "r.value").distinct().orderBy("kind", "value")


def camp_stats(df: DataFrame) -> DataFrame:
    """Distinct label parts, labels and centers, assignments, and the deduplicated allocation.

    The allocation of an assignment is the largest of its rows (never below 0);
    assignments whose key ends in the separator, i.e. without a camp, are left out.
    """
    grain = _camp_grain(df)
    parts = d.camp_label_parts(F.col("label"))
    complete = (parts["numerator"] != "") & (parts["denominator"] != "")
    keep = ~F.col("assignment_key").endswith("|")
    pairs = distinct_by_kind(
        grain.withColumn("complete_rows", F.when(complete, F.col("rows")).otherwise(F.lit(0))).drop("rows"),
        [
            ("numerator", F.when(complete, parts["numerator"])),
            ("denominator", F.when(complete, parts["denominator"])),
            ("label", F.col("label")),
            ("center", F.col("center")),
            ("assignment", F.when(keep, F.col("assignment_key"))),
        ],
        sums=("complete_rows",), maxima=("allocated",),
    )
    best = F.when(F.col("kind") == "assignment", F.greatest(F.lit(0.0), "allocated"))
    return pairs.agg(
        _count("numerator").alias("numerators"),
        _count("denominator").alias("denominators"),
        F.coalesce(F.sum("complete_rows"), F.lit(0)).cast("bigint").alias("assignments"),
        _count("label").alias("labels"),
        _count("center").alias("centers"),
        F.coalesce(F.sum(best), F.lit(0.0)).alias("allocated"),
    )


def _entity_camps(camps: DataFrame, flt: PlanFilter) -> DataFrame:
    keyed = d.with_entity_keys(without_domestic(camps), "service_company_name", "office_number")
    return keyed.where(entity_condition(flt))


def camp_count(camps: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Distinct camps of the camp table (without domestic rows)."""
    label = t.trim_ws(F.col("camp_label"))
    return _entity_camps(camps, flt).agg(F.count_distinct(F.when(label != "", label)).alias("camps"))


def center_count(camps: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Distinct (company, center) pairs of the camp table (without domestic rows)."""
    given = t.trim_ws(F.col("office_number")) != ""
    return _entity_camps(camps, flt).agg(F.count_distinct(F.when(given, F.col("center_key"))).alias("centers"))


def kpi_denominators(base: DataFrame, camps: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Camp statistics and pilgrims of the headline plan types over the *base* layer.

    Centers come from the camp table.  The entity filter applies throughout.
    """
    rows = d.with_measures(d.with_entity_keys(base)).where(d.is_denominator_type(flt.plan_types) & entity_condition(flt))
    pilgrims = rows.agg(F.coalesce(F.sum("pilgrims"), F.lit(0.0)).alias("pilgrims"))
    return camp_stats(rows).drop("centers", "allocated").withColumns({
        "centers": center_count(camps, flt).scalar(),
        "pilgrims": pilgrims.scalar(),
    })


def kpi_card(plans: DataFrame, camps: DataFrame, residence_counts: DataFrame, flt: PlanFilter = PlanFilter(),
             mix: DataFrame | None = None) -> DataFrame:
    """One row with every planned/total figure of the headline card: an aggregate for each layer and table, each evaluated once."""
    layers = filter_layers(plans, flt, mix)
    rows = d.with_measures(d.with_entity_keys(layers.base)).where(d.is_denominator_type(flt.plan_types) & entity_condition(flt))
    parts = d.camp_label_parts(F.when(t.truthy(F.col("camp_label")), t.trim_ws(F.col("camp_label"))))
    totals = rows.agg(F.struct(
        F.coalesce(F.sum("pilgrims"), F.lit(0.0)).alias("pilgrims"),
        F.count_if((parts["numerator"] != "") & (parts["denominator"] != "")).alias("assignments"))).scalar()
    label, given = t.trim_ws(F.col("camp_label")), t.trim_ws(F.col("office_number")) != ""
    table = _entity_camps(camps, flt).agg(F.struct(
        F.count_distinct(F.when(label != "", label)).alias("camps"),
        F.count_distinct(F.when(given, F.col("center_key"))).alias("centers"))).scalar()
    homes = residence_counts.select(F.struct("planned", "assigned")).scalar()
    card = headline_kpis(layers.filtered).select(
        F.col("pilgrims").alias("pilgrims_planned"), "buses", "plans", "trips",
        F.col("centers").alias("centers_planned"), F.col("camps").alias("camps_planned"),
    )
    return card.withColumns({
        "pilgrims_total": totals["pilgrims"],
        "centers_total": table["centers"],
        "camps_total": table["camps"],
        "camp_assignments": totals["assignments"],
        "residences_planned": homes["planned"],
        "residences_assigned": homes["assigned"],
    })
