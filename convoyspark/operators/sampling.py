"""Facet lists, the stratified map sample and the plan-list limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from convoyspark.functions import text as t
from convoyspark.operators import derive as d
from convoyspark.operators.entities import entity_catalog
from convoyspark.plans import schema as s


def _order(df: DataFrame) -> list[str]:
    return [c for c in (s.ROW, s.SUB) if c in df.columns]


def facets(plans: DataFrame) -> DataFrame:
    """Distinct options of every facet as one long ``(facet, value, label)`` table.

    All facets are stacked in one pass; repeats disappear in the map-side part
    of the ``distinct``.  Each facet's options come in Arabic collation of their labels.
    """
    return _all_facets(plans).orderBy("facet", F.collate("label", "ar"), "value")


def _all_facets(plans: DataFrame) -> DataFrame:
    keyed = d.with_entity_keys(plans)
    facet = lambda name, value: F.struct(
        F.lit(name).alias("facet"), value.alias("value"))
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    stacked = keyed.select(F.explode(F.filter(F.array(
        facet("period", named("period")),
        facet("transport", named("transport_type_name")),
        facet("plan_type", named("plan_type_name")),
        facet("district", named("start_point_district")),
        facet("camp", F.nullif(t.text_or_blank(F.col("camp_label")), F.lit(""))),
        facet("center", F.col("center_key")),
    ), lambda r: r["value"].isNotNull())).alias("r")).select("r.facet", "r.value").distinct()
    options = F.array(*[F.struct(F.lit("transport").alias("facet"), F.lit(x).alias("value")) for x in s.TRANSPORT_TRIPS])
    menu = plans.sparkSession.range(1).select(F.inline(options))
    labelled = stacked.union(menu).distinct().select("facet", "value", _facet_label().alias("label"))
    companies = entity_catalog(plans).where("level = 'company'").select(
        F.lit("company").alias("facet"), F.col("key").alias("value"), F.col("name").alias("label"))
    return labelled.unionByName(companies)


def _facet_label():
    """Centers show "number - name", with the number standing in for the name."""
    number = F.substring_index("value", "|", -1)
    center = F.when(number != "", F.concat(number, F.lit(" - "), number)).otherwise(F.lit(s.NO_CENTER))
    return F.when(F.col("facet") == "center", center).otherwise(F.col("value"))


def center_options(plans: DataFrame, company: str | None = None) -> DataFrame:
    """Center options whose company key starts with the chosen one."""
    centers = _all_facets(plans).where("facet = 'center'").select("value", "label")
    chosen = centers.where(F.col("value").startswith(company)) if company else centers
    return chosen.orderBy(F.collate("label", "ar"), "value")


def stratified_sample(df: DataFrame, limit: int) -> DataFrame:
    """First rows of every plan type, ``limit`` in all; everything if there are no more than that.

    Each type gets ``limit // types`` rows and the types met first share the
    remainder; quota a type cannot fill is not passed on.  The row-number filter
    has a constant bound, so Spark trims each task to ``limit`` rows per type
    before the shuffle; a type with a third of all rows moves no more than any other.
    """
    order = _order(df)
    typed = df.withColumn("type_", t.first_filled(F.col("plan_type_code"), s.UNKNOWN_CODE))
    types = typed.groupBy("type_").agg(F.min(s.ROW).alias("first_row"), F.count(F.lit(1)).alias("rows"))
    sizes = types.agg(F.count(F.lit(1)).alias("types"), F.sum("rows").alias("rows"))
    # At most ``limit`` types can have a quota, so ranking never sees more rows than that.
    ranked = types.orderBy("first_row", "type_").limit(limit).withColumn(
        "rank_", F.row_number().over(Window.orderBy("first_row", "type_")))
    n_types, n_rows = sizes.select("types").scalar(), sizes.select("rows").scalar()
    each = F.floor(F.lit(limit) / n_types)
    quota = ranked.select("type_", (each + F.when(F.col("rank_") <= F.lit(limit) - each * n_types, 1).otherwise(0)).alias("quota_"))
    numbered = typed.withColumn("number_", F.row_number().over(Window.partitionBy("type_").orderBy(*order)))
    sample = numbered.where(F.col("number_") <= limit).join(quota, "type_").where(
        (F.col("number_") <= F.col("quota_")) | (n_rows <= limit))
    return sample.drop("type_", "number_", "quota_")


def first_plans(filtered: DataFrame, rows: int) -> DataFrame:
    """First plans in source order, for the plan list (a distributed top-k)."""
    return d.plan_list(filtered).orderBy(*_order(filtered)).limit(rows)


def plans_beyond_list(filtered: DataFrame, rows: int) -> DataFrame:
    """How many plans the list leaves out."""
    return filtered.agg(F.greatest(F.count(F.lit(1)) - rows, F.lit(0)).alias("more"))
