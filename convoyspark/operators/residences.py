"""Residence facts, the tarwia/taseed mix, coverage and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convoyspark.functions import geo, text as t
from convoyspark.operators import derive as d
from convoyspark.operators.entities import residence_file_key
from convoyspark.operators.filters import PlanFilter, entity_condition
from convoyspark.plans import schema as s


def residence_facts(plans: DataFrame) -> DataFrame:
    """Pilgrims per (center, residence), overall and of tarwia and taseed plans.

    A plan type naming both counts on both sides.  The display name is the one
    given first; finding it costs no second pass because rows are first reduced
    to (center, residence, name).
    """
    # A key is blank where its name is; a filter on the key would fold every name twice.
    rows = d.with_residence(d.with_measures(d.with_entity_keys(plans))).where(
        t.truthy(F.col("owner_office_number")) & (F.col("residence_name") != ""))
    kind = t.text_key(F.concat_ws(" ", F.coalesce("plan_type_code", F.lit("")), F.coalesce("plan_type_name", F.lit(""))))
    # Bound and worked out once; written out for each test, it makes a generated method too long to be compiled.
    rows = rows.withColumn("kinds_", geo.let(kind, lambda k: F.struct(
        (k.contains("tarwia") | k.contains("تروية")).alias("tarwia"), (k.contains("taseed") | k.contains("تصعيد")).alias("taseed"))))
    of = lambda test: F.sum(F.when(test, F.col("pilgrims")).otherwise(F.lit(0.0)))
    named = rows.groupBy("company_key", "center_key", "residence_key", "residence_name").agg(
        F.sum("pilgrims").alias("pilgrims"),
        of(F.col("kinds_.tarwia")).alias("tarwia"),
        of(F.col("kinds_.taseed")).alias("taseed"),
        F.min(s.ROW).alias("first_row"),
    )
    # A residence has a row for each spelling: nothing to combine before the shuffle, so the one sort comes after it.
    whole = ["company_key", "center_key", "residence_key"]
    return named.repartition(*whole).groupBy(*whole).agg(
        F.min_by("residence_name", F.struct("first_row", "residence_name")).alias("residence_name"),
        *[F.sum(c).alias(c) for c in ("pilgrims", "tarwia", "taseed")],
    )


def residence_classes(facts: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Mix class of every residence over its centers; null when it has neither kind."""
    tarwia, taseed = F.col("tarwia") > 0, F.col("taseed") > 0
    return (
        facts.where(entity_condition(flt)).groupBy("residence_key")
        .agg(F.sum("tarwia").alias("tarwia"), F.sum("taseed").alias("taseed"))
        .select("residence_key",
                F.when(tarwia & taseed, "mixed").when(tarwia, "tarwiyah").when(taseed, "direct").alias("mix"))
    )


def residence_mix(facts: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Residences by mix class; the total includes those with neither kind."""
    of = lambda name: F.count_if(F.col("mix") == name)
    return residence_classes(facts, flt).agg(
        F.count(F.lit(1)).alias("total"), of("tarwiyah").alias("tarwia_only"),
        of("direct").alias("direct_only"), of("mixed").alias("mixed"))


def residence_mix_ring(facts: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """The three mix classes as labelled ring segments with their share of all residences."""
    mix = residence_mix(facts, flt)
    # Segment labels in display order.
    segments = (("تروية", "tarwia_only"), ("تصعيد مباشر", "direct_only"), ("مختلط", "mixed"))
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).alias("residences")) for label, c in segments])
    return mix.select("total", F.inline(rows)).select(
        "label", "residences", d.share_percent(F.col("residences"), F.col("total")).alias("share_percent"))


def residence_coverage(plans: DataFrame, facts: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Centers with plans, split into those that also have a residence and those that lack one."""
    centers = d.with_entity_keys(plans).where(t.truthy(F.col("owner_office_number")) & entity_condition(flt)).select(
        "center_key").distinct()
    housed = facts.where(entity_condition(flt)).select("center_key").distinct().withColumn("housed", F.lit(1))
    joined = centers.join(housed, "center_key", "left")
    return joined.agg(
        F.count("housed").alias("assigned"),
        F.count_if(F.col("housed").isNull()).alias("missing"),
        F.count(F.lit(1)).alias("total"))


def residence_counts(facts: DataFrame, residence_file: DataFrame, flt: PlanFilter = PlanFilter()) -> DataFrame:
    """Residences planned (names as written) against residences assigned (license and name)."""
    planned = facts.where(entity_condition(flt) & (F.col("residence_name") != "")).agg(
        F.count_distinct("residence_name").alias("planned"))
    assigned = d.with_entity_keys(residence_file, "service_company", "service_center_number").where(entity_condition(flt)).agg(
        F.count_distinct(F.nullif(residence_file_key(), F.lit(""))).alias("assigned"))
    return planned.withColumn("assigned", assigned.scalar())
