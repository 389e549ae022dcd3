"""Max-deduplicated allocations, the target lookup and completion against target.

An assignment (company, center, camp) repeats its allocation on many plans; it
counts once, with its largest value.  So totals are two-level aggregates: the
maximum per assignment, then the sum of those maxima.  Both levels combine
map-side, which is what keeps a center with a third of all plans harmless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from convoyspark.functions import text as t
from convoyspark.operators import derive as d
from convoyspark.operators.filters import PlanFilter, entity_condition
from convoyspark.plans import schema as s


def assignment_totals(plans: DataFrame) -> DataFrame:
    """Deduplicated allocation per center and per center number, overall and by plan type.

    Rows: ``level`` (center or number), ``key``, ``plan_type`` (null for the
    overall total, which is not the sum of the typed ones) and ``total``.
    """
    keyed = d.with_allocated(d.with_keys(plans)).where(F.col("center_number") != "")
    fine = keyed.groupBy(
        "center_key", "center_number_key", F.nullif(d.plan_type_code_or_name(), F.lit("")).alias("plan_type"), "assignment_key",
    ).agg(F.max("allocated").alias("allocated"))

    def level(name: str, key: str, *kind: str) -> DataFrame:
        """Totals by one key: a table of assignments is held for each level on its own, not four times the rows in one."""
        tops = fine.groupBy(key, *kind, "assignment_key").agg(F.max("allocated").alias("allocated"))
        # Rows without a type are left out at the end, and no key can be null: filters on keys would move below ``fine``,
        # which all levels share.
        typed = F.max(F.col("plan_type").isNotNull()) if kind else F.lit(True)
        return tops.groupBy(key, *kind).agg(F.sum(F.greatest(F.lit(0.0), "allocated")).alias("total"), typed.alias("typed_")).where("typed_").select(
            F.lit(name).alias("level"), F.coalesce(key, F.lit("")).alias("key"), (F.col("plan_type") if kind else F.lit(None).cast("string")).alias("plan_type"), "total")

    return reduce(DataFrame.unionAll, [level(*x, *kind) for kind in ((), ("plan_type",)) for x in (
        ("center", "center_key"), ("number", "center_number_key"))])


def running_max_totals(plans: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """Center totals as the sum of the increases of each assignment's running maximum.

    Row by row in source order; equals the deduplicated totals and serves as
    their cross-check.  The order is cut into blocks: each block knows the best
    value before it, so a huge assignment is worked on in parallel.
    """
    order = [c for c in (s.ROW, s.SUB) if c in plans.columns]
    rows = d.with_allocated(d.with_keys(plans)).where(F.col("center_number") != "").select(
        "center_key", "assignment_key", "allocated", *order, F.floor(F.col(s.ROW) / block_rows).alias("block"))
    per_block = rows.groupBy("assignment_key", "block").agg(F.max("allocated").alias("top"))
    over_blocks = Window.partitionBy("assignment_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select("assignment_key", "block", F.max("top").over(over_blocks).alias("carried"))
    within = Window.partitionBy("assignment_key", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stepped = rows.join(carried, ["assignment_key", "block"]).withColumn(
        "previous", F.greatest(F.lit(0.0), "carried", F.max("allocated").over(within)))
    return stepped.groupBy("center_key").agg(
        F.sum(F.greatest(F.lit(0.0), F.col("allocated") - F.col("previous"))).alias("total"))


def with_target(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach ``target`` by center, falling back to the center number alone.

    ``rows`` needs ``center_key``, ``center_number_key`` and ``type_code``.  The
    typed total counts if it is there and not zero, else the overall total.
    The totals are reshaped to a row per key and looked up once for each distinct triple of keys, so a
    center with a third of all rows is one lookup.
    """
    triple = ["center_key", "center_number_key", "type_code"]
    typed = F.collect_list(F.when(F.col("plan_type").isNotNull(), F.struct("plan_type", "total")))  # a handful of plan types
    table = totals.groupBy("level", "key").agg(
        F.max(F.when(F.col("plan_type").isNull(), F.col("total"))).alias("overall"), F.map_from_entries(typed).alias("typed"))
    ways = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(level).alias("level"), F.col(key).alias("key"))
                     for i, (level, key) in enumerate((("center", "center_key"), ("number", "center_number_key")))])
    wanted = rows.select(*triple).distinct().select(*triple, F.inline(ways))
    target = F.coalesce(F.nullif(F.try_element_at("typed", F.col("type_code")), F.lit(0.0)), F.col("overall"))
    found = wanted.join(table, ["level", "key"]).where("overall is not null").groupBy(*triple).agg(
        F.min_by(target, F.col("turn")).alias("target"))
    return rows.join(found, triple, "left").withColumn("target", F.coalesce("target", F.lit(0.0)))


def target_lookup(plans: DataFrame, totals: DataFrame) -> DataFrame:
    """Every plan with the allocation target of its center and plan type."""
    typed = d.with_entity_keys(plans).withColumn("type_code", t.first_filled(F.col("plan_type_code"), s.UNKNOWN_CODE))
    return with_target(typed, totals)


def _by_type_and_center(base: DataFrame) -> DataFrame:
    """Rows summed per (type, label, center), with the first row of each."""
    code = t.first_filled(F.col("plan_type_code"), s.UNKNOWN_CODE)
    return d.with_measures(d.with_entity_keys(base)).groupBy(
        code.alias("type_code"),
        t.first_filled(F.col("plan_type_name"), code).alias("label"),
        "center_key", "center_number_key",
    ).agg(F.sum("pilgrims").alias("planned"), F.min(s.ROW).alias("first_row"))


def completion(base: DataFrame, totals: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Planned pilgrims against target per plan type."""
    return _completion(base, totals, flt).drop("first_row")


def _completion(base: DataFrame, totals: DataFrame, flt: PlanFilter) -> DataFrame:
    """Completion per plan type with the first row of each.

    The target is looked up once per distinct (type, center), after the plans
    have been summed to that grain, so the lookup never meets single plans.
    """
    rows = d.with_entity_keys(base).where(entity_condition(flt))
    fine = _by_type_and_center(rows)
    centers = fine.groupBy("type_code", "center_key", "center_number_key").agg(
        F.sum("planned").alias("planned"),
        F.min_by("label", F.struct("first_row", "label")).alias("label"), F.min("first_row").alias("first_row"))
    return with_target(centers, totals).groupBy("type_code").agg(
        F.min_by("label", F.struct("first_row", "label")).alias("label"),
        F.sum("planned").alias("planned"), F.sum("target").alias("target"), F.min("first_row").alias("first_row"))


def completion_by_center(base: DataFrame, totals: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Planned pilgrims against target per (plan type, center)."""
    rows = d.with_entity_keys(base).where(entity_condition(flt))
    code = t.first_filled(F.col("plan_type_code"), s.UNKNOWN_CODE)
    shown = F.concat_ws(" - ", t.first_filled(F.col("owner_office_number"), s.NO_CENTER),
                        t.first_filled(F.col("owner_company_name"), s.UNKNOWN))
    fine = d.with_measures(rows).groupBy(
        code.alias("type_code"), "center_key", "center_number_key", shown.alias("label"),
    ).agg(F.sum("pilgrims").alias("planned"), F.min(s.ROW).alias("first_row"))
    centers = fine.groupBy("type_code", "center_key", "center_number_key").agg(
        F.min_by("label", F.struct("first_row", "label")).alias("label"), F.sum("planned").alias("planned"))
    return with_target(centers, totals).drop("center_number_key")


def available_labels(base: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Plan-type labels of the base layer plus the selected ones, with code and display rank."""
    label = t.text_or_blank(F.col("plan_type_name"))
    seen = (
        base.where(label != "").groupBy(label.alias("label"), "plan_type_code").agg(F.min(s.ROW).alias("first_row"))
        .groupBy("label").agg(F.min_by("plan_type_code", F.struct("first_row", "plan_type_code")).alias("code"))
    )
    if flt.plan_types:
        chosen = base.sparkSession.createDataFrame([(x,) for x in sorted(flt.plan_types)], "label string")
        missing = chosen.join(seen, "label", "left_anti").select("label", d.plan_type_class(F.col("label")).alias("code"))
        seen = seen.unionByName(missing)
    return seen.select("label", "code", d.plan_type_rank(t.first_filled(F.col("code"), F.col("label"))).alias("rank"))


def completion_ring(base: DataFrame, totals: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """One row per available plan-type label, zero where the base layer has no completion for it.

    Shares relate to the target of the two headline types, or of all types if that is 0.
    """
    # Several codes can carry one label; the code first met last owns it.
    by_label = _completion(base, totals, flt).groupBy("label").agg(
        F.max_by(F.struct("type_code", "planned", "target"), F.struct("first_row", "type_code")).alias("c"))
    rows = available_labels(base, flt).select("label").join(by_label, "label", "left").select(
        F.coalesce("c.type_code", d.plan_type_class(F.col("label"))).alias("type_code"), "label",
        F.coalesce("c.planned", F.lit(0.0)).alias("planned"), F.coalesce("c.target", F.lit(0.0)).alias("target"),
    )
    headline = d.plan_type_class(F.col("type_code")).isin(*s.HEADLINE_TYPE_CODES)
    every = Window.partitionBy(F.lit(0))  # a row for each label
    denominator = F.coalesce(F.nullif(F.sum(F.when(headline, F.col("target")).otherwise(F.lit(0.0))).over(every), F.lit(0.0)),
                             F.sum("target").over(every), F.lit(0.0))
    tenths = F.floor(F.col("planned") / F.col("target") * 1000 + 0.5) / 10
    return rows.select(
        "type_code", "label", "planned", "target",
        d.share_percent(F.col("target"), denominator).alias("share_percent"),
        F.when(F.col("target") > 0, F.least(F.greatest(tenths, F.lit(0.0)), F.lit(100.0))).otherwise(F.lit(0.0)).alias("completion"),
        d.plan_type_rank(F.col("type_code")).alias("rank"),
    ).orderBy("rank", F.desc("target"), "label")
