"""Layered faceted filter over plans.

The three layers nest: *base* (single-value tests, search, residence mix),
*context* (plan types) and *filtered* (companies and centers).  They are
available as three lazy DataFrames, or as boolean columns on one DataFrame so
that metrics over different layers can share a single scan and shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from convoyspark.functions import text as t
from convoyspark.operators import derive as d
from convoyspark.plans import schema as s

#: Selectable residence mixes -> class computed by :mod:`residences`.
RESIDENCE_MIXES = ("tarwiyah", "direct", "mixed")


@dataclass(frozen=True)
class PlanFilter:
    """One selection; None and empty sets mean "no restriction".

    Companies and centers are given as keys (see ``derive.with_entity_keys``).
    """

    plan_id: str | None = None
    entrance: str | None = None
    path: str | None = None
    district: str | None = None
    period: str | None = None
    transport: str | None = None
    camp_label: str | None = None
    search: str | None = None
    residence_mix: str | None = None
    plan_types: frozenset[str] = field(default_factory=frozenset)
    companies: frozenset[str] = field(default_factory=frozenset)
    centers: frozenset[str] = field(default_factory=frozenset)

    @property
    def selects_entities(self) -> bool:
        return bool(self.companies or self.centers)

    @property
    def narrows_map(self) -> bool:
        """True when any selection but the camp label is active."""
        single = (self.plan_id, self.entrance, self.path, self.district, self.period,
                  self.transport, self.residence_mix, (self.search or "").strip())
        return any(single) or bool(self.plan_types) or self.selects_entities


class Layers(NamedTuple):
    base: DataFrame
    context: DataFrame
    filtered: DataFrame


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def base_condition(flt: PlanFilter) -> Column:
    """Conjunction of the single-value tests that are set; plain and pushable."""
    tests: list[Column] = []
    if flt.plan_id:
        tests.append(F.col("plan_id") == flt.plan_id)
    if flt.entrance:
        tests.append(d.entrance_label(s.FILTER_NO_ENTRANCE) == flt.entrance)
    if flt.path:
        tests.append(d.path_label(s.FILTER_NO_PATH) == flt.path)
    if flt.district:
        tests.append(t.fold_arabic(d.district_label(s.FILTER_NO_DISTRICT)) == t.fold_arabic(F.lit(flt.district)))
    if flt.period:
        tests.append(t.trim_ws(F.col("period")) == flt.period.strip())
    if flt.transport:
        tests.append(F.col("transport_type_name") == flt.transport)
    if flt.camp_label:
        tests.append(t.text_or_blank(F.col("camp_label")) == flt.camp_label)
    if flt.search:
        tests.append(search_condition(flt.search))
    return F.coalesce(_all(tests), F.lit(False)) if tests else F.lit(True)


def search_condition(search: str) -> Column:
    """Case-insensitive substring over company, plan type and start point."""
    cells = [F.coalesce(c, F.lit("")) for c in ("owner_company_name", "plan_type_name", "start_point_name")]
    return F.lower(F.concat_ws(" ", *cells)).contains(search.lower())


def context_condition(flt: PlanFilter) -> Column:
    if not flt.plan_types:
        return F.lit(True)
    return F.coalesce(F.col("plan_type_name").isin(*sorted(flt.plan_types)), F.lit(False))


def entity_condition(flt: PlanFilter, company: Column | None = None, center: Column | None = None) -> Column:
    """Company and center key tests; long selections become a hash-set lookup."""
    company = F.col("company_key") if company is None else company
    center = F.col("center_key") if center is None else center
    tests = []
    if flt.companies:
        tests.append(company.isin(*sorted(flt.companies)))
    if flt.centers:
        tests.append(center.isin(*sorted(flt.centers)))
    return _all(tests)


def filter_base(df: DataFrame, flt: PlanFilter) -> DataFrame:
    return df.where(base_condition(flt))


def filter_context(df: DataFrame, flt: PlanFilter) -> DataFrame:
    return df.where(context_condition(flt))


def filter_entity(df: DataFrame, flt: PlanFilter) -> DataFrame:
    keyed = df if "center_key" in df.columns else d.with_entity_keys(df)
    return keyed.where(entity_condition(flt))


def keep_residence_mix(df: DataFrame, mix: DataFrame, flt: PlanFilter) -> DataFrame:
    """Plans whose residence falls in the selected mix class (left-semi join).

    ``mix`` has one row per ``residence_key`` with its ``mix`` class.  Plans
    without a residence are dropped before the join, so the blank key cannot
    gather in one task.
    """
    if not flt.residence_mix:
        return df
    chosen = mix.where(F.col("mix") == flt.residence_mix).select("residence_key")
    return d.with_residence(df).where(F.col("residence_key") != "").join(chosen, "residence_key", "left_semi")


def filter_layers(df: DataFrame, flt: PlanFilter, mix: DataFrame | None = None) -> Layers:
    """The three layers as chained lazy DataFrames."""
    base = filter_base(df, flt)
    if mix is not None:
        base = keep_residence_mix(base, mix, flt)
    context = filter_context(base, flt)
    return Layers(base, context, filter_entity(context, flt) if flt.selects_entities else context)


def with_layers(df: DataFrame, flt: PlanFilter, mix: DataFrame | None = None) -> DataFrame:
    """All rows, with ``in_base``, ``in_context`` and ``in_filtered`` flags.

    Metrics over several layers then need one pass: the flags turn into
    conditions inside the aggregates.
    """
    keyed = df if "center_key" in df.columns else d.with_entity_keys(df)
    in_base = base_condition(flt)
    if flt.residence_mix and mix is not None:
        chosen = mix.where(F.col("mix") == flt.residence_mix).select("residence_key", F.lit(True).alias("in_mix"))
        # Rows without a residence get a key of their own: none matches, and
        # they spread over all tasks instead of meeting in one.
        lonely = F.concat(F.lit("\u0000"), F.col(s.ROW).cast("string"))
        keyed = d.with_residence(keyed).withColumn(
            "residence_key", F.when(F.col("residence_key") == "", lonely).otherwise(F.col("residence_key")))
        keyed = keyed.join(chosen, "residence_key", "left")
        in_base = in_base & F.coalesce(F.col("in_mix"), F.lit(False))
    keyed = keyed.withColumn("in_base", in_base)
    keyed = keyed.withColumn("in_context", F.col("in_base") & context_condition(flt))
    return keyed.withColumn("in_filtered", F.col("in_context") & entity_condition(flt)).drop("in_mix")


def base_or_all(base: DataFrame, plans: DataFrame) -> DataFrame:
    """The base layer, or all plans when it is empty; for callers that want this fallback."""
    return base.unionByName(plans.where(base.limit(1).agg(F.count(F.lit(1))).scalar() == 0))


def is_domestic(company: Column, nationality: Column) -> Column:
    """Domestic pilgrims: the phrase within the company, or the whole nationality."""
    return t.text_key(company).contains(s.DOMESTIC) | (t.text_key(nationality) == s.DOMESTIC)


def without_domestic(camps: DataFrame) -> DataFrame:
    return camps.where(~is_domestic(F.col("service_company_name"), F.col("nationality")))


def residence_starts(df: DataFrame) -> DataFrame:
    return df.where(F.col("start_point_type") == "residence")


def facet_rows(df: DataFrame, company: str | None = None, center: str | None = None) -> DataFrame:
    """Rows that feed the camp list below a chosen company and center key."""
    chosen = PlanFilter(companies=frozenset([company] if company else []), centers=frozenset([center] if center else []))
    return filter_entity(df, chosen)


def search_entities(entities: DataFrame, search: str, key: str) -> DataFrame:
    """Folded substring search over everything an entity row shows, and its key."""
    wanted = " ".join(search.split())
    if not wanted:
        return entities
    whole = lambda c: F.col(c).cast("decimal(38,0)").cast("string")
    shown = [F.col(c) for c in ("label", "sublabel", "center_number") if c in entities.columns]
    shown += [whole("total_pilgrims"), whole("residences"), d.completion_text(F.col("completion")), F.col(key)]
    return entities.where(t.text_key(F.concat_ws(" ", *shown)).contains(t.text_key(F.lit(wanted))))
