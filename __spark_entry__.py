"""Registered queries: every operator over the star-schema test tables, with DuckDB oracles."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import oracles as o
from convoyspark.functions import geo, text as t
from convoyspark.operators import (
    assignments, breakdowns, derive, entities, filters, geometry, kpis, lookups, ordering, orient, proximity, residences, sampling,
    validate,
)
from convoyspark.operators.filters import PlanFilter
from convoyspark.plans import binding, schema as s
from convoyspark.sinks import snapshots as snapshots_sink
from convoyspark.sources import files, snapshots
from convoyspark.streaming import ingest

try:
    from convoyspark.llm import queries as llm
except ModuleNotFoundError as missing:  # the subpackage and the pipeline may have been removed
    if not (missing.name or "").startswith(("convoyspark.llm", "corpus_pipeline")):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

OWNER = ("owner_company_name", "owner_office_number")
TYPE = ("plan_type_code", "plan_type_name")
ENDS = ("start_point_type", "start_point_name", "end_point_type", "end_point_name")
HAJ, ALLOC = ("number_of_haj",), ("allocated_haj", "number_of_haj")
LOAD = ("number_of_haj", "number_of_buses", "transport_type_name")
LABELS = ("period", "path_name", "start_point_district", "entrance_name", "entrance_asm_code")
ENTRANCE = ("entrance_name", "entrance_asm_code")
SHAPES = s.GEOMETRY_COLUMNS
ROUTES = ("plan_id", *TYPE, "start_point_type", "end_point_type", *SHAPES)

SOME_TYPES = PlanFilter(plan_types=frozenset(["تروية", "إفاضة"]))
SOME_OWNERS = PlanFilter(companies=frozenset(["nation_3", "nation_11", "nation_15"]), centers=frozenset(
    f"nation_{n}|{c}" for n in (3, 11, 15) for c in range(0, 100, 2)))
LAYERED = PlanFilter(period="3", plan_types=SOME_TYPES.plan_types, companies=SOME_OWNERS.companies)


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def _plans(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return binding.plans(spark, sf_dir, *columns)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_IN_TYPES = "coalesce(plan_type_name IN ('تروية', 'إفاضة'), false)"
_IN_COMPANIES = "company_key IN ('nation_3', 'nation_11', 'nation_15')"
_IN_OWNERS = f"{_IN_COMPANIES} AND center_number <> '' AND TRY_CAST(center_number AS INT) % 2 = 0 AND TRY_CAST(center_number AS INT) < 100"
# A selected center '0' cannot match, because a zero number is blank.


# ---------------------------------------------------------------------------
# Projections
# ---------------------------------------------------------------------------


@query("canon_columns", o.PLANS + """SELECT plan_id, camp_label, number_of_haj, period, owner_company_name,
 CAST(CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0 ELSE allocated_haj END AS DOUBLE) AS allocated_haj FROM p""")
def canon_columns(spark, sf):
    raw = _plans(spark, sf, "plan_id", "camp_label", "number_of_haj", "period", "owner_company_name", "allocated_haj", "number_of_buses")
    odd = F.col(s.ROW) % 2 == 1
    split = raw.select(
        F.col("plan_id").alias("ID"),
        F.when(odd, F.col("camp_label")).alias("camp_label"), F.when(~odd, F.col("camp_label")).alias("End point name"),
        F.when(odd, F.col("number_of_haj").cast("string")).alias("number_of_haj"),
        F.col("number_of_haj").cast("string").alias("Number of haj"),
        F.col("period").alias("Period"), F.col("owner_company_name").alias("Company"),
        F.when(F.col("number_of_buses") == 6, F.lit("six")).otherwise(F.col("allocated_haj").cast("string")).alias("allocated_haj"),
    )
    return derive.canonical_plans(split).select(
        "plan_id", "camp_label", "number_of_haj", "period", "owner_company_name", "allocated_haj")


@query("entity_keys", o.PLANS + "SELECT plan_id, _sub, company_key, center_key, center_number_key, assignment_key FROM p")
def entity_keys(spark, sf):
    return derive.with_keys(_plans(spark, sf, "plan_id", *OWNER, "camp_label")).select(
        "plan_id", s.SUB, "company_key", "center_key", "center_number_key", "assignment_key")


@query("allocated_pilgrims", o.PLANS + "SELECT plan_id, _sub, allocated FROM p")
def allocated_pilgrims(spark, sf):
    return derive.with_allocated(_plans(spark, sf, "plan_id", *ALLOC)).select("plan_id", s.SUB, "allocated")


@query("plan_type_class", o.PLANS + f"""SELECT plan_type_code, plan_type_name, {o.plan_class("coalesce(plan_type_code, '')")} AS by_code,
 {o.plan_class("coalesce(plan_type_name, '')")} AS by_name, CAST({o.rank_of(o.plan_class(o.filled('plan_type_code', 'plan_type_name')))} AS INT) AS rank,
 headline, count(*) AS plans FROM p GROUP BY ALL""")
def plan_type_class(spark, sf):
    return _plans(spark, sf, *TYPE).select(
        *TYPE,
        derive.plan_type_class(F.col("plan_type_code")).alias("by_code"),
        derive.plan_type_class(F.col("plan_type_name")).alias("by_name"),
        derive.plan_type_rank(t.first_filled(F.col("plan_type_code"), F.col("plan_type_name"))).alias("rank"),
        derive.is_headline_type(F.col("plan_type_code"), F.col("plan_type_name")).alias("headline"),
    ).groupBy(*TYPE, "by_code", "by_name", "rank", "headline").agg(F.count(F.lit(1)).alias("plans"))


@query("trips", o.PLANS + "SELECT plan_id, _sub, buses, trips, pilgrims FROM p")
def trips(spark, sf):
    return derive.with_measures(_plans(spark, sf, "plan_id", *LOAD)).select("plan_id", s.SUB, "buses", "trips", "pilgrims")


@query("camp_label_split", o.PLANS + """SELECT plan_id, _sub, camp_label,
 CASE WHEN contains(camp_label, '/') THEN trim(split_part(camp_label, '/', 1)) END AS numerator,
 CASE WHEN contains(camp_label, '/') THEN trim(split_part(camp_label, '/', 2)) END AS denominator FROM p""")
def camp_label_split(spark, sf):
    parts = derive.camp_label_parts(F.col("camp_label"))
    return _plans(spark, sf, "plan_id", "camp_label").select(
        "plan_id", s.SUB, "camp_label", parts["numerator"].alias("numerator"), parts["denominator"].alias("denominator"))


@query("plan_residence", o.PLANS + "SELECT plan_id, _sub, residence_name, residence_key FROM p")
def plan_residence(spark, sf):
    return derive.with_residence(_plans(spark, sf, "plan_id", *ENDS)).select("plan_id", s.SUB, "residence_name", "residence_key")


@query("plan_list", o.PLANS + f"""SELECT plan_id, coalesce(nullif(owner_company_name, ''), '{s.UNKNOWN}') AS company, timing_start_at AS starts_at,
 timing_end_at AS ends_at, number_of_buses AS buses, trips, coalesce({o.filled('plan_type_name', 'plan_type_code')}, '{s.UNKNOWN}') AS plan_type,
 coalesce(nullif(transport_type_name, ''), '{s.UNKNOWN}') AS transport, number_of_haj AS pilgrims, coalesce(period, '') AS period,
 coalesce(nullif(start_point_name, ''), '{s.NOT_AVAILABLE}') AS from_point, coalesce(nullif(end_point_name, ''), '{s.NOT_AVAILABLE}') AS to_point,
 coalesce(owner_office_number, '') AS center, _row, _sub FROM p""")
def plan_list(spark, sf):
    return derive.plan_list(_plans(
        spark, sf, "plan_id", *OWNER, *LOAD, *TYPE, "timing_start_at", "timing_end_at", "period", "start_point_name", "end_point_name"))


@query("plans_beyond_list", "SELECT greatest(count(*) - 50, 0) AS more FROM lineitem")
def plans_beyond_list(spark, sf):
    return sampling.plans_beyond_list(_plans(spark, sf), 50)


@query("camera_details", f"WITH {o._CAMERAS} " + """SELECT name, latitude, longitude, altitude,
 CASE WHEN s_suppkey % 25 = 24 THEN 'Gate' ELSE
  CASE s_suppkey % 6 WHEN 0 THEN 'عرفات' WHEN 1 THEN 'منى - نفق' WHEN 2 THEN 'مزدلفة - مواقف - الأمن' WHEN 3 THEN 'مكة'
   WHEN 4 THEN 'مواقف - طريق 26' ELSE '4TH - RNG - PRE' END || CASE WHEN s_suppkey % 4 = 0 THEN ' - جسر' ELSE '' END END AS location,
 CASE WHEN s_suppkey % 20 = 19 THEN 'both' ELSE CASE s_suppkey % 6 WHEN 0 THEN 'دخول' WHEN 1 THEN 'خروج' WHEN 3 THEN 'دخول وخروج' ELSE 'غير محدد' END END AS direction,
 CASE s_suppkey % 6 WHEN 0 THEN 'مشاة' WHEN 1 THEN 'نفق' WHEN 2 THEN 'مواقف' WHEN 4 THEN 'قطار' ELSE 'كاميرا مراقبة' END AS type FROM cameras""")
def camera_details(spark, sf):
    return lookups.camera_details(binding.cameras(spark, sf))


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------


def _ids(df: DataFrame) -> DataFrame:
    return df.select("plan_id", s.SUB)


@query("filter_base", o.PLANS + f"""SELECT plan_id, _sub FROM p WHERE coalesce(nullif(path_name, ''), 'No Path') = 'No Path'
 AND {o.fold("coalesce(start_point_district, 'No District')")} = 'حي BUILDING' AND trim(period) = '3' AND transport_type_name = 'ترددي'""")
def filter_base(spark, sf):
    df = _plans(spark, sf, "plan_id", "path_name", "start_point_district", "period", "transport_type_name")
    return _ids(filters.filter_base(df, PlanFilter(path="No Path", district="حى BUILDING", period="3", transport="ترددي")))


_BY_CODE, _BY_NAME = ('E0', '30/19'), ('مدخل Brand#12', '14/12')  # an entrance that has only its code, and one with a name; each with a camp


@query("filter_entrance_camp", o.PLANS + f"""SELECT plan_id, _sub FROM p
 WHERE (coalesce({o.filled('entrance_name', 'entrance_asm_code')}, 'No Entrance'), trim(camp_label)) IN ({_BY_CODE}, {_BY_NAME})""")
def filter_entrance_camp(spark, sf):
    df = _plans(spark, sf, "plan_id", *ENTRANCE, "camp_label")
    code, name = (filters.filter_base(df, PlanFilter(entrance=e, camp_label=c)) for e, c in (_BY_CODE, _BY_NAME))
    return _ids(code.unionByName(name))


@query("filter_search", o.PLANS + """SELECT plan_id, _sub FROM p WHERE contains(lower(coalesce(owner_company_name, '') || ' ' ||
 coalesce(plan_type_name, '') || ' ' || coalesce(start_point_name, '')), 'nation_1 تروية customer#0000000')""")
def filter_search(spark, sf):
    df = _plans(spark, sf, "plan_id", "owner_company_name", "plan_type_name", "start_point_name")
    return _ids(filters.filter_base(df, PlanFilter(search="Nation_1 تروية CUSTOMER#0000000")))


@query("filter_entity", o.PLANS + f"SELECT plan_id, _sub FROM p WHERE {_IN_OWNERS}")
def filter_entity(spark, sf):
    return _ids(filters.filter_entity(_plans(spark, sf, "plan_id", *OWNER), SOME_OWNERS))


@query("filter_layers", o.PLANS + f"""SELECT 'base' AS layer, count(*) AS plans FROM p WHERE trim(period) = '3'
 UNION ALL SELECT 'context', count(*) FROM p WHERE trim(period) = '3' AND {_IN_TYPES}
 UNION ALL SELECT 'filtered', count(*) FROM p WHERE trim(period) = '3' AND {_IN_TYPES} AND {_IN_COMPANIES}""")
def filter_layers(spark, sf):
    layers = filters.filter_layers(_plans(spark, sf, *OWNER, "plan_type_name", "period"), LAYERED)
    counted = [df.agg(F.count(F.lit(1)).alias("plans")).select(F.lit(name).alias("layer"), "plans")
               for name, df in layers._asdict().items()]
    return counted[0].union(counted[1]).union(counted[2])


@query("filter_layer_flags", o.PLANS + f"""SELECT coalesce(trim(period) = '3', false) AS in_base, coalesce(trim(period) = '3', false) AND {_IN_TYPES} AS in_context,
 coalesce(trim(period) = '3', false) AND {_IN_TYPES} AND {_IN_COMPANIES} AS in_filtered, count(*) AS plans, sum(pilgrims) AS pilgrims FROM p GROUP BY 1, 2, 3""")
def filter_layer_flags(spark, sf):
    df = derive.with_measures(_plans(spark, sf, *OWNER, "plan_type_name", "period", *HAJ))
    return filters.with_layers(df, LAYERED).groupBy("in_base", "in_context", "in_filtered").agg(
        F.count(F.lit(1)).alias("plans"), F.sum("pilgrims").alias("pilgrims"))


@query("domestic_excl", f"WITH {o._CAMPS} SELECT _row, camp_label, service_company_name, nationality FROM c WHERE NOT domestic")
def domestic_excl(spark, sf):
    return filters.without_domestic(binding.camps(spark, sf)).select("_row", "camp_label", "service_company_name", "nationality")


@query("residence_mix_filter", f"{o.PLANS}, {o._FACTS}, {o._MIX} SELECT plan_id, _sub FROM p WHERE residence_key IN (SELECT residence_key FROM mix WHERE mix = 'direct')")
def residence_mix_filter(spark, sf):
    df = _plans(spark, sf, "plan_id", *OWNER, *TYPE, *ENDS, *HAJ)
    mix = residences.residence_classes(residences.residence_facts(df))
    return _ids(filters.keep_residence_mix(df, mix, PlanFilter(residence_mix="direct")))


@query("residence_mix_layers", f"""{o.PLANS}, {o._FACTS}, {o._MIX} SELECT residence_key IN (SELECT residence_key FROM mix WHERE mix = 'mixed') AS in_base,
 count(*) AS plans FROM p GROUP BY 1""")
def residence_mix_layers(spark, sf):
    df = _plans(spark, sf, *OWNER, *TYPE, *ENDS, *HAJ)
    mix = residences.residence_classes(residences.residence_facts(df))
    return filters.with_layers(df, PlanFilter(residence_mix="mixed"), mix).groupBy("in_base").agg(F.count(F.lit(1)).alias("plans"))


@query("residence_starts", o.PLANS + "SELECT plan_id, _sub FROM p WHERE start_point_type = 'residence'")
def residence_starts(spark, sf):
    return _ids(filters.residence_starts(_plans(spark, sf, "plan_id", "start_point_type")))


@query("facet_rows", o.PLANS + "SELECT DISTINCT trim(camp_label) AS camp FROM p WHERE company_key = 'nation_3' AND trim(camp_label) <> ''")
def facet_rows(spark, sf):
    rows = filters.facet_rows(_plans(spark, sf, *OWNER, "camp_label"), company="nation_3")
    return rows.select(t.trim_ws(F.col("camp_label")).alias("camp")).where("camp <> ''").distinct()


# ---------------------------------------------------------------------------
# Headline figures and breakdowns
# ---------------------------------------------------------------------------


@query("kpis", o.PLANS + f"""SELECT sum(pilgrims) AS pilgrims, sum(buses) AS buses, sum(trips) AS trips, count(*) AS plans,
 count(DISTINCT nullif(camp_label, '')) AS camps,
 (SELECT count(DISTINCT x) FROM (SELECT start_point_name AS x FROM p WHERE start_point_type = 'residence' UNION SELECT end_point_name FROM p WHERE end_point_type = 'residence')) AS residences,
 count(DISTINCT CASE WHEN {o.truthy('owner_office_number')} THEN center_key END) AS centers FROM p""")
def kpi_query(spark, sf):
    return kpis.headline_kpis(_plans(spark, sf, *OWNER, *LOAD, *ENDS, "camp_label"))


def _measures(label: str, name: str) -> str:
    return o.PLANS + f"SELECT {label} AS {name}, sum(pilgrims) AS pilgrims, sum(buses) AS buses, sum(trips) AS trips, count(*) AS plans FROM p GROUP BY 1"


@query("by_period", _measures("period_l", "period"))
def by_period(spark, sf):
    return breakdowns.by_period(_plans(spark, sf, *LOAD, "period"))


@query("by_path", _measures("path_l", "path"))
def by_path(spark, sf):
    return breakdowns.by_path(_plans(spark, sf, *LOAD, "path_name"))


@query("by_district", _measures("district_l", "district"))
def by_district(spark, sf):
    return breakdowns.by_district(_plans(spark, sf, *LOAD, "start_point_district"))


@query("by_transport", o.PLANS + f"""SELECT t.transport, coalesce(b.buses, 0.0) AS buses, {o.share('coalesce(b.buses, 0.0)', '(SELECT sum(buses) FROM p)')} AS share_percent
 FROM (SELECT unnest(['ترددي', 'تقليدي رد', 'تقليدي ردين', 'قطار']) AS transport UNION SELECT transport_type_name FROM p WHERE transport_type_name <> '') t
 LEFT JOIN (SELECT coalesce(transport_type_name, '{s.UNKNOWN}') AS transport, sum(buses) AS buses FROM p GROUP BY 1) b USING (transport)""")
def by_transport(spark, sf):
    return breakdowns.by_transport(_plans(spark, sf, "number_of_buses", "transport_type_name"))


@query("transport_options", o.PLANS + """SELECT unnest(['ترددي', 'تقليدي رد', 'تقليدي ردين', 'قطار']) AS transport
 UNION SELECT transport_type_name FROM p WHERE transport_type_name <> ''""")
def transport_options(spark, sf):
    return breakdowns.transport_options(_plans(spark, sf, "transport_type_name"))


@query("entrance_period", o.PLANS + """SELECT e.entrance, CASE WHEN starts_with(e.entrance, 'مدخل ') THEN ltrim(substr(e.entrance, 6)) ELSE e.entrance END AS short_label,
 q.period, coalesce(sum(p.buses), 0.0) AS value FROM (SELECT DISTINCT entrance_l AS entrance FROM p) e CROSS JOIN (SELECT DISTINCT period_l AS period FROM p) q
 LEFT JOIN p ON p.entrance_l = e.entrance AND p.period_l = q.period GROUP BY 1, 2, 3""")
def entrance_period(spark, sf):
    return breakdowns.entrance_period(_plans(spark, sf, *LOAD, "period", *ENTRANCE), "buses")


_PERIODS = [*(str(m) for m in range(1, 13)), s.UNKNOWN]


@query("entrance_period_matrix", o.PLANS + "SELECT entrance_l AS entrance, " + ", ".join(
    f"coalesce(sum(pilgrims) FILTER (WHERE period_l = '{m}'), 0.0) AS \"{m}\"" for m in _PERIODS) + " FROM p GROUP BY 1")
def entrance_period_matrix(spark, sf):
    return breakdowns.entrance_period_matrix(_plans(spark, sf, *HAJ, "period", *ENTRANCE), _PERIODS)


@query("breakdowns_gs", o.PLANS + """SELECT 'period' AS dimension, period_l AS label, NULL AS period, sum(trips) AS value FROM p GROUP BY 2
 UNION ALL SELECT 'path', path_l, NULL, sum(trips) FROM p GROUP BY 2 UNION ALL SELECT 'district', district_l, NULL, sum(trips) FROM p GROUP BY 2
 UNION ALL SELECT 'entrance', entrance_l, period_l, sum(trips) FROM p GROUP BY 2, 3""")
def breakdowns_gs(spark, sf):
    return breakdowns.breakdowns(_plans(spark, sf, *LOAD, *LABELS), "trips")


@query("share_of_total", o.PLANS + f""", q AS (SELECT path_l AS path, sum(pilgrims) AS pilgrims FROM p GROUP BY 1)
 SELECT path, pilgrims, {o.share('pilgrims', '(SELECT sum(pilgrims) FROM q)')} AS share_percent,
 round(pilgrims / (SELECT max(pilgrims) FROM q), 6) AS share_of_max FROM q""")
def share_of_total(spark, sf):
    counted = breakdowns.by_path(_plans(spark, sf, *LOAD, "path_name"))
    return _rounded(breakdowns.share_of_total(counted, "path", "pilgrims"), "share_of_max")


def _camp_stats(where: str) -> str:
    q = f"(SELECT * FROM p WHERE {where})"
    part = "CASE WHEN contains(camp_label, '/') THEN trim(split_part(camp_label, '/', {})) END"
    return f"""count(DISTINCT {part.format(1)}) AS numerators, count(DISTINCT {part.format(2)}) AS denominators,
 count(*) FILTER (WHERE contains(camp_label, '/')) AS assignments, count(DISTINCT nullif(camp_label, '')) AS labels,
 count(DISTINCT CASE WHEN owner_office_number IS NOT NULL THEN center_key END) AS centers,
 (SELECT sum(greatest(m, 0)) FROM (SELECT assignment_key, max(allocated) AS m FROM {q} WHERE NOT suffix(assignment_key, '|') GROUP BY 1)) AS allocated
 FROM {q}"""


@query("camp_stats", o.PLANS + "SELECT " + _camp_stats("true"))
def camp_stats(spark, sf):
    return kpis.camp_stats(_plans(spark, sf, *OWNER, "camp_label", *ALLOC))


@query("camp_label_parts", o.PLANS + """SELECT DISTINCT 'numerator' AS kind, trim(split_part(camp_label, '/', 1)) AS value FROM p WHERE contains(camp_label, '/')
 UNION SELECT DISTINCT 'denominator', trim(split_part(camp_label, '/', 2)) FROM p WHERE contains(camp_label, '/')""")
def camp_label_parts(spark, sf):
    return kpis.camp_label_parts(_plans(spark, sf, "camp_label"))


_CENTERS_SQL = "(SELECT count(DISTINCT center_key) FROM c WHERE NOT domestic AND office_number <> '' AND {})"
_CAMPS_SQL = "(SELECT count(DISTINCT nullif(trim(camp_label), '')) FROM c WHERE NOT domestic AND {})"


@query("kpi_denominators", f"{o.PLANS}, {o._CAMPS} SELECT numerators, denominators, assignments, labels, "
       + _CENTERS_SQL.format(_IN_COMPANIES)
       + f" AS centers, (SELECT sum(pilgrims) FROM p WHERE headline AND {_IN_COMPANIES}) AS pilgrims FROM (SELECT "
       + _camp_stats(f"headline AND {_IN_COMPANIES}") + ")")
def kpi_denominators(spark, sf):
    base = _plans(spark, sf, *OWNER, "camp_label", *ALLOC, *TYPE)
    return kpis.kpi_denominators(base, binding.camps(spark, sf), PlanFilter(companies=SOME_OWNERS.companies))


@query("camp_count", f"WITH {o._CAMPS} SELECT " + _CAMPS_SQL.format("true") + " AS camps")
def camp_count(spark, sf):
    return kpis.camp_count(binding.camps(spark, sf))


@query("center_count", f"WITH {o._CAMPS} SELECT " + _CENTERS_SQL.format("true") + " AS centers")
def center_count(spark, sf):
    return kpis.center_count(binding.camps(spark, sf))


@query("kpi_card", f"""{o.PLANS}, {o._CAMPS}, {o._RESIDENCES}, {o._FACTS}, f AS (SELECT * FROM p WHERE {_IN_TYPES})
 SELECT sum(pilgrims) AS pilgrims_planned, sum(buses) AS buses, count(*) AS plans, sum(trips) AS trips,
 count(DISTINCT CASE WHEN {o.truthy('owner_office_number')} THEN center_key END) AS centers_planned, count(DISTINCT nullif(camp_label, '')) AS camps_planned,
 (SELECT sum(pilgrims) FROM f) AS pilgrims_total, {_CENTERS_SQL.format('true')} AS centers_total, {_CAMPS_SQL.format('true')} AS camps_total,
 (SELECT count(*) FROM f WHERE contains(camp_label, '/')) AS camp_assignments,
 (SELECT count(DISTINCT nullif(residence_name, '')) FROM facts) AS residences_planned, (SELECT count(DISTINCT file_key) FROM r) AS residences_assigned FROM f""")
def kpi_card(spark, sf):
    df = _plans(spark, sf, *OWNER, *LOAD, *ENDS, *TYPE, "camp_label", "allocated_haj")
    counts = residences.residence_counts(residences.residence_facts(df), binding.residences(spark, sf))
    return kpis.kpi_card(df, binding.camps(spark, sf), counts, SOME_TYPES)


# ---------------------------------------------------------------------------
# Assignments, completion, entities
# ---------------------------------------------------------------------------


@query("assignment_totals", f"{o.PLANS}, {o._TOTALS} SELECT level, key, plan_type, total FROM totals")
def assignment_totals(spark, sf):
    return assignments.assignment_totals(_plans(spark, sf, *OWNER, "camp_label", *ALLOC, *TYPE))


@query("running_max_delta", o.PLANS + """, steps AS (SELECT center_key, greatest(0, allocated - greatest(0, coalesce(max(allocated) OVER (
 PARTITION BY assignment_key ORDER BY _row, _sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS d FROM p WHERE center_number <> '')
 SELECT center_key, sum(d) AS total FROM steps GROUP BY 1""")
def running_max_delta(spark, sf):
    return assignments.running_max_totals(_plans(spark, sf, *OWNER, "camp_label", *ALLOC), block_rows=1 << 14)


@query("target_lookup", f"{o.PLANS}, {o._TOTALS}, g AS (SELECT DISTINCT center_key, center_number_key, type_code FROM p), "
       f"h AS (SELECT g.*, {o.target_of('g')} AS target FROM g) SELECT plan_id, _sub, h.target FROM p JOIN h USING (center_key, center_number_key, type_code)")
def target_lookup(spark, sf):
    df = _plans(spark, sf, "plan_id", *OWNER, "camp_label", *ALLOC, *TYPE)
    return assignments.target_lookup(df, assignments.assignment_totals(df)).select("plan_id", s.SUB, "target")


_COMPLETION_SQL = f"""{o.PLANS}, {o._TOTALS}, g AS (SELECT type_code, center_key, center_number_key, sum(pilgrims) AS planned FROM p GROUP BY 1, 2, 3),
 h AS (SELECT g.*, {o.target_of('g')} AS target FROM g),
 done AS (SELECT type_code, (SELECT first(type_label ORDER BY _row, type_label) FROM p WHERE p.type_code = h.type_code) AS label,
  (SELECT min(_row) FROM p WHERE p.type_code = h.type_code) AS first_row, sum(planned) AS planned, sum(target) AS target FROM h GROUP BY 1) """


@query("completion", _COMPLETION_SQL + "SELECT type_code, label, planned, target FROM done")
def completion(spark, sf):
    df = _plans(spark, sf, *OWNER, "camp_label", *ALLOC, *TYPE)
    return assignments.completion(df, assignments.assignment_totals(df))


@query("completion_by_center", f"""{o.PLANS}, {o._TOTALS}, g AS (SELECT type_code, center_key, center_number_key, sum(pilgrims) AS planned,
 first(coalesce(owner_office_number, '{s.NO_CENTER}') || ' - ' || coalesce(nullif(owner_company_name, ''), '{s.UNKNOWN}')
  ORDER BY _row, coalesce(owner_office_number, '{s.NO_CENTER}') || ' - ' || coalesce(nullif(owner_company_name, ''), '{s.UNKNOWN}')) AS label FROM p GROUP BY 1, 2, 3)
 SELECT type_code, center_key, label, planned, {o.target_of('g')} AS target FROM g""")
def completion_by_center(spark, sf):
    df = _plans(spark, sf, *OWNER, "camp_label", *ALLOC, *TYPE)
    return assignments.completion_by_center(df, assignments.assignment_totals(df))


@query("available_labels", o.PLANS + f""", l AS (SELECT plan_type_name AS label, first(plan_type_code ORDER BY _row, plan_type_code NULLS FIRST) AS code FROM p
 WHERE plan_type_name <> '' GROUP BY 1 UNION ALL SELECT 'نفرة', 'nafra')
 SELECT label, code, CAST({o.rank_of(o.plan_class(o.filled('code', 'label')))} AS INT) AS rank FROM l""")
def available_labels(spark, sf):
    return assignments.available_labels(_plans(spark, sf, *TYPE), PlanFilter(plan_types=frozenset(["نفرة", "إفاضة", "تروية"])))


@query("completion_ring", _COMPLETION_SQL + f""", l AS (SELECT DISTINCT plan_type_name AS label FROM p WHERE plan_type_name <> '' UNION SELECT 'نفرة'),
 k AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY label ORDER BY first_row DESC, type_code DESC) = 1),
 ring AS (SELECT coalesce(k.type_code, {o.plan_class('l.label')}) AS type_code, l.label, coalesce(k.planned, 0.0) AS planned, coalesce(k.target, 0.0) AS target FROM l LEFT JOIN k USING (label)),
 total AS (SELECT coalesce(nullif(sum(CASE WHEN {o.plan_class('type_code')} IN ('tarwia', 'direct_taseed') THEN target ELSE 0 END), 0), sum(target)) AS v FROM ring)
 SELECT type_code, label, planned, target, {o.share('target', '(SELECT v FROM total)')} AS share_percent,
 CASE WHEN target > 0 THEN least(floor(planned / target * 1000 + 0.5) / 10, 100.0) ELSE 0.0 END AS completion, CAST({o.rank_of(o.plan_class('type_code'))} AS INT) AS rank FROM ring""")
def completion_ring(spark, sf):
    df = _plans(spark, sf, *OWNER, "camp_label", *ALLOC, *TYPE)
    return assignments.completion_ring(df, assignments.assignment_totals(df), PlanFilter(plan_types=frozenset(["نفرة", "تروية"])))


@query("first_wins", o.PLANS + """SELECT center_key AS key, first(residence_name ORDER BY _row, residence_name) AS first_value,
 first(residence_name ORDER BY _row DESC, residence_name DESC) AS last_value FROM p GROUP BY 1""")
def first_wins(spark, sf):
    df = derive.with_residence(derive.with_entity_keys(_plans(spark, sf, *OWNER, *ENDS)))
    return entities.first_wins(df, F.col("center_key"), F.col("residence_name"))


@query("entity_catalog", o.PLANS + """SELECT 'company' AS level, company_key AS key, first(company_name ORDER BY _row, company_name) AS name FROM p
 WHERE owner_company_name <> '' GROUP BY 2
 UNION ALL SELECT DISTINCT 'center', center_key, center_number FROM p WHERE center_number <> ''""")
def entity_catalog(spark, sf):
    return entities.entity_catalog(_plans(spark, sf, *OWNER))


def _two_levels(source: str, where: str, aggs: str) -> str:
    return (f"SELECT 'company' AS level, company_key, NULL AS center_key, {aggs} FROM {source} WHERE {where} GROUP BY 2 "
            f"UNION ALL SELECT 'center', company_key, center_key, {aggs} FROM {source} WHERE {where} GROUP BY 2, 3")


@query("camp_totals", f"WITH {o._CAMPS} " + _two_levels(
    "c", "NOT domestic", f"sum(number_of_piligrim) AS pilgrims, count(DISTINCT nullif({o.key('nationality')}, '')) AS nationalities"))
def camp_totals(spark, sf):
    return entities.camp_totals(binding.camps(spark, sf))


@query("planned_metrics", o.PLANS + _two_levels(
    "p", _IN_TYPES, "sum(pilgrims) AS pilgrims, count(DISTINCT nullif(code_or_name, '')) AS plan_types, count(DISTINCT nullif(residence_key, '')) AS residences"))
def planned_metrics(spark, sf):
    return entities.planned_metrics(filters.filter_context(_plans(spark, sf, *OWNER, *HAJ, *TYPE, *ENDS), SOME_TYPES))


_ALLOCATED_SQL = """x AS (SELECT company_key, center_key, assignment_key, max(allocated) AS a FROM p {} GROUP BY 1, 2, 3),
 y AS (SELECT 'company' AS level, company_key, NULL AS center_key, sum(greatest(a, 0)) AS allocated FROM x GROUP BY 2
  UNION ALL SELECT 'center', company_key, center_key, sum(greatest(a, 0)) FROM x GROUP BY 2, 3),"""


@query("assignment_metrics", o.PLANS + ", " + _ALLOCATED_SQL.format("") + " z AS ("
       + _two_levels("p", "true", "count(DISTINCT nullif(residence_name, '')) AS residences")
       + ") SELECT y.level, y.company_key, y.center_key, y.allocated, z.residences FROM y JOIN z ON y.level = z.level AND y.company_key = z.company_key "
         "AND y.center_key IS NOT DISTINCT FROM z.center_key")
def assignment_metrics(spark, sf):
    return entities.assignment_metrics(_plans(spark, sf, *OWNER, "camp_label", *ALLOC, *ENDS))


@query("assignment_metrics_tables", f"{o.PLANS}, {o._FACTS}, {o._RESIDENCES}, " + _ALLOCATED_SQL.format(f"WHERE {o.truthy('owner_office_number')}")
       + " n AS (SELECT company_key, center_key, nullif(residence_name, '') AS name FROM facts UNION ALL SELECT company_key, center_key, file_key FROM r "
         "UNION ALL SELECT company_key, center_key, NULL FROM x), z AS ("
       + _two_levels("n", "true", "count(DISTINCT name) AS residences")
       + ") SELECT z.level, z.company_key, z.center_key, coalesce(y.allocated, 0.0) AS allocated, z.residences FROM z LEFT JOIN y ON y.level = z.level "
         "AND y.company_key = z.company_key AND y.center_key IS NOT DISTINCT FROM z.center_key")
def assignment_metrics_tables(spark, sf):
    df = _plans(spark, sf, *OWNER, "camp_label", *ALLOC, *ENDS, *TYPE)
    return entities.assignment_metrics_from_tables(df, residences.residence_facts(df), binding.residences(spark, sf))


@query("company_totals", o.PLANS + """SELECT company_key, first(company_name ORDER BY _row, company_name) AS name, sum(pilgrims) AS pilgrims FROM p
 WHERE headline AND company_key <> '' GROUP BY 1""")
def company_totals(spark, sf):
    return entities.company_totals(_plans(spark, sf, *OWNER, *TYPE, *HAJ))


def _company_sql(base: str, filtered: str) -> str:
    return o.PLANS + f""", planned AS (SELECT company_key, sum(pilgrims) AS v FROM p WHERE {filtered} GROUP BY 1),
 total AS (SELECT company_key, sum(pilgrims) AS v FROM p WHERE headline AND {base} AND company_key <> '' GROUP BY 1),
 homes AS (SELECT company_key, count(DISTINCT nullif(residence_name, '')) AS v FROM p WHERE {base} GROUP BY 1),
 catalog AS (SELECT company_key, first(company_name ORDER BY _row, company_name) AS name FROM p WHERE owner_company_name <> '' GROUP BY 1),
 k AS (SELECT company_key FROM catalog UNION SELECT company_key FROM planned UNION SELECT company_key FROM total)
 SELECT k.company_key, coalesce(catalog.name, '{s.UNKNOWN}') AS label, coalesce(total.v, 0.0) AS total_pilgrims, coalesce(homes.v, 0) AS residences,
 round({o.completion('coalesce(planned.v, 0.0)', 'total.v')}, 6) AS completion FROM k LEFT JOIN catalog USING (company_key)
 LEFT JOIN planned USING (company_key) LEFT JOIN total USING (company_key) LEFT JOIN homes USING (company_key)"""


_ENTITY_COLUMNS = (*OWNER, *HAJ, *TYPE, *ENDS)


@query("company_table", _company_sql("true", "true"))
def company_table(spark, sf):
    return _rounded(entities.company_table(_plans(spark, sf, *_ENTITY_COLUMNS)), "completion")


@query("company_table_filtered", _company_sql("coalesce(trim(period) = '3', false)", f"trim(period) = '3' AND {_IN_TYPES} AND {_IN_COMPANIES}"))
def company_table_filtered(spark, sf):
    return _rounded(entities.company_table(_plans(spark, sf, *_ENTITY_COLUMNS, "period"), LAYERED), "completion")


def _center_sql(base: str, filtered: str) -> str:
    return o.PLANS + f""", b AS (SELECT *, coalesce({filtered}, false) AS f FROM p WHERE {base}),
 total AS (SELECT center_key, sum(greatest(a, 0)) AS v FROM (SELECT center_key, assignment_key, max(allocated) AS a FROM b GROUP BY 1, 2) GROUP BY 1)
 SELECT company_key, center_key, center_number, coalesce(nullif(center_number, ''), '{s.NO_CENTER}') AS label,
 first(company_name ORDER BY NOT f, _row, company_name) AS sublabel, any_value(total.v) AS total_pilgrims,
 count(DISTINCT nullif(residence_name, '')) AS residences,
 round({o.completion('coalesce(sum(pilgrims) FILTER (WHERE f), 0.0)', 'any_value(total.v)')}, 6) AS completion
 FROM b JOIN total USING (center_key) GROUP BY 1, 2, 3"""


@query("center_table", _center_sql("true", "true"))
def center_table(spark, sf):
    return _rounded(entities.center_table(_plans(spark, sf, *_ENTITY_COLUMNS, "allocated_haj", "camp_label")), "completion")


@query("center_table_filtered", _center_sql(f"trim(period) = '3' AND {_IN_COMPANIES}", _IN_TYPES))
def center_table_filtered(spark, sf):
    df = _plans(spark, sf, *_ENTITY_COLUMNS, "allocated_haj", "camp_label", "period")
    return _rounded(entities.center_table(df, LAYERED), "completion")


@query("entity_sort", f"SELECT *, row_number() OVER (ORDER BY total_pilgrims DESC, label, center_key) AS position FROM ({_center_sql('true', 'true')})")
def entity_sort(spark, sf):
    table = entities.center_table(_plans(spark, sf, *_ENTITY_COLUMNS, "allocated_haj", "camp_label"))
    placed = ordering.with_position(entities.sort_entities(table, "total_pilgrims"), _folder(spark, "order"))
    return _rounded(placed, "completion")


@query("by_path_order", o.PLANS + """, q AS (SELECT path_l AS path, sum(pilgrims) AS pilgrims, min(_row) AS first_row FROM p GROUP BY 1)
 SELECT path, row_number() OVER (ORDER BY pilgrims DESC, first_row) AS position FROM q""")
def by_path_order(spark, sf):
    rows = breakdowns.by_path(_plans(spark, sf, *LOAD, "path_name"))
    return ordering.with_position(rows, _folder(spark, "order")).select("path", "position")


@query("by_period_order", o.PLANS + "SELECT period_l AS period, row_number() OVER (ORDER BY period_l) AS position FROM p GROUP BY 1")
def by_period_order(spark, sf):
    rows = breakdowns.by_period(_plans(spark, sf, *LOAD, "period"))
    return ordering.with_position(rows, _folder(spark, "order")).select("period", "position")


@query("entrance_period_order", o.PLANS + """SELECT e.entrance, q.period, row_number() OVER (ORDER BY e.entrance, TRY_CAST(q.period AS DOUBLE) NULLS LAST, q.period) AS position
 FROM (SELECT DISTINCT entrance_l AS entrance FROM p) e CROSS JOIN (SELECT DISTINCT period_l AS period FROM p) q""")
def entrance_period_order(spark, sf):
    rows = breakdowns.entrance_period(_plans(spark, sf, *LOAD, "period", *ENTRANCE), "buses")
    return ordering.with_position(rows, _folder(spark, "order")).select("entrance", "period", "position")


@query("entity_search", f"""SELECT center_key FROM ({_center_sql('true', 'true')}) WHERE contains({o.key(
    "label || ' ' || sublabel || ' ' || center_number || ' ' || CAST(CAST(total_pilgrims AS BIGINT) AS VARCHAR) || ' ' || residences || ' ' || "
    "CASE WHEN completion >= 100 THEN '100%' ELSE format('{:.1f}%', completion) END || ' ' || center_key")}, 'nation_1')""")
def entity_search(spark, sf):
    table = entities.center_table(_plans(spark, sf, *_ENTITY_COLUMNS, "allocated_haj", "camp_label"))
    return filters.search_entities(table, " Nation_1", "center_key").select("center_key")


@query("camp_center_names", f"""WITH {o._CAMPS} SELECT center_key, CASE WHEN first(service_center_name ORDER BY _row, service_center_name) <> ''
 THEN first(service_center_name ORDER BY _row, service_center_name) ELSE coalesce(nullif(split_part(center_key, '|', 2), ''), '{s.NO_CENTER}') END AS label FROM c GROUP BY 1""")
def camp_center_names(spark, sf):
    return entities.camp_names_of_centers(binding.camps(spark, sf), entities.entity_catalog(_plans(spark, sf, *OWNER)))


# ---------------------------------------------------------------------------
# Residences
# ---------------------------------------------------------------------------

_RES = (*OWNER, *TYPE, *ENDS, *HAJ)


@query("residence_facts", f"{o.PLANS}, {o._FACTS} SELECT company_key, center_key, residence_key, residence_name, pilgrims, tarwia, taseed FROM facts")
def residence_facts(spark, sf):
    return residences.residence_facts(_plans(spark, sf, *_RES))


@query("residence_mix", f"""{o.PLANS}, {o._FACTS}, {o._MIX} SELECT count(*) AS total, count(*) FILTER (WHERE mix = 'tarwiyah') AS tarwia_only,
 count(*) FILTER (WHERE mix = 'direct') AS direct_only, count(*) FILTER (WHERE mix = 'mixed') AS mixed FROM mix""")
def residence_mix(spark, sf):
    return residences.residence_mix(residences.residence_facts(_plans(spark, sf, *_RES)))


@query("residence_mix_ring", f"""{o.PLANS}, {o._FACTS}, {o._MIX}, q AS (SELECT CASE mix WHEN 'tarwiyah' THEN 'تروية' WHEN 'direct' THEN 'تصعيد مباشر' ELSE 'مختلط' END AS label,
 count(*) AS residences FROM mix WHERE mix IS NOT NULL GROUP BY 1) SELECT label, residences, {o.share('residences', '(SELECT count(*) FROM mix)')} AS share_percent FROM q""")
def residence_mix_ring(spark, sf):
    return residences.residence_mix_ring(residences.residence_facts(_plans(spark, sf, *_RES)))


@query("residence_coverage", f"""{o.PLANS}, {o._FACTS}, k AS (SELECT DISTINCT center_key FROM p WHERE {o.truthy('owner_office_number')} AND {_IN_COMPANIES})
 SELECT count(*) FILTER (WHERE center_key IN (SELECT center_key FROM facts)) AS assigned,
 count(*) FILTER (WHERE center_key NOT IN (SELECT center_key FROM facts)) AS missing, count(*) AS total FROM k""")
def residence_coverage(spark, sf):
    df = _plans(spark, sf, *_RES)
    return residences.residence_coverage(df, residences.residence_facts(df), PlanFilter(companies=SOME_OWNERS.companies))


@query("residence_counts", f"""{o.PLANS}, {o._FACTS}, {o._RESIDENCES} SELECT (SELECT count(DISTINCT residence_name) FROM facts) AS planned,
 (SELECT count(DISTINCT file_key) FROM r) AS assigned""")
def residence_counts(spark, sf):
    return residences.residence_counts(residences.residence_facts(_plans(spark, sf, *_RES)), binding.residences(spark, sf))


# ---------------------------------------------------------------------------
# Facets, samples, snapshots, validation
# ---------------------------------------------------------------------------


@query("facets", o.PLANS + f"""SELECT DISTINCT 'period' AS facet, period AS value, period AS label FROM p WHERE period <> ''
 UNION SELECT 'transport', transport_type_name, transport_type_name FROM p WHERE transport_type_name <> ''
 UNION SELECT 'transport', x, x FROM (SELECT unnest(['ترددي', 'تقليدي رد', 'تقليدي ردين', 'قطار']) AS x)
 UNION SELECT 'plan_type', plan_type_name, plan_type_name FROM p WHERE plan_type_name <> ''
 UNION SELECT 'district', start_point_district, start_point_district FROM p WHERE start_point_district <> ''
 UNION SELECT 'camp', trim(camp_label), trim(camp_label) FROM p WHERE trim(camp_label) <> ''
 UNION SELECT 'center', center_key, CASE WHEN center_number <> '' THEN center_number || ' - ' || center_number ELSE '{s.NO_CENTER}' END FROM p
 UNION ALL SELECT 'company', company_key, first(company_name ORDER BY _row, company_name) FROM p WHERE owner_company_name <> '' GROUP BY 2""")
def facets(spark, sf):
    return sampling.facets(_plans(spark, sf, *OWNER, "period", "transport_type_name", "plan_type_name", "start_point_district", "camp_label"))


@query("company_rank", f"SELECT company_key, label, row_number() OVER (ORDER BY completion DESC, total_pilgrims DESC, label COLLATE ar) AS position FROM ({_company_sql('true', 'true')})")
def company_rank(spark, sf):
    """The place of each row of the company table, as it is shown."""
    table = entities.company_table(_plans(spark, sf, *_ENTITY_COLUMNS))
    return ordering.with_position(table, _folder(spark, "order")).select("company_key", "label", "position")


@query("facet_order", f"SELECT facet, value, row_number() OVER (ORDER BY facet, label COLLATE ar, value) AS position FROM ({_ORACLES['facets']})")
def facet_order(spark, sf):
    return ordering.with_position(facets(spark, sf), _folder(spark, "order")).select("facet", "value", "position")


@query("center_options", o.PLANS + f"""SELECT DISTINCT center_key AS value, CASE WHEN center_number <> '' THEN center_number || ' - ' || center_number ELSE '{s.NO_CENTER}' END AS label
 FROM p WHERE starts_with(center_key, 'nation_1')""")
def center_options(spark, sf):
    df = _plans(spark, sf, *OWNER, "period", "transport_type_name", "plan_type_name", "start_point_district", "camp_label")
    return sampling.center_options(df, "nation_1")


@query("stratified_sample", o.PLANS + """, k AS (SELECT type_code, row_number() OVER (ORDER BY min(_row), type_code) AS rank, count(*) OVER () AS types FROM p GROUP BY 1),
 n AS (SELECT p.*, row_number() OVER (PARTITION BY type_code ORDER BY _row, _sub) AS number FROM p)
 SELECT plan_id, _sub, plan_type_code FROM n JOIN k USING (type_code)
 WHERE number <= 300 // types + CASE WHEN rank <= 300 - (300 // types) * types THEN 1 ELSE 0 END OR (SELECT count(*) FROM p) <= 300""")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(_plans(spark, sf, "plan_id", "plan_type_code"), 300).select("plan_id", s.SUB, "plan_type_code")


@query("dq_missing_columns", "SELECT 'missing column' AS \"check\", CAST(NULL AS BIGINT) AS \"row\", unnest(['path_name', 'timing_start_at_hijri', 'timing_end_at_hijri']) AS \"column\", CAST(NULL AS VARCHAR) AS value")
def dq_missing_columns(spark, sf):
    """Headers of the files that the plans are written to, without one of the required columns."""
    bound = [c for c in s.REQUIRED_COLUMNS if c in binding.PLAN_COLUMNS and c != "path_name"]
    path = _csv(_plans(spark, sf, *bound).drop(s.ROW, s.SUB), _folder(spark, "headers"), compression="gzip")
    return files.header_report(spark, path).select("check", "row", "column", F.lit(None).cast("string").alias("value")).distinct()


@query("dq_numeric", o.PLANS + """SELECT 'not numeric' AS "check", _row AS "row", 'number_of_buses' AS "column", path_name || ' ' || l_linenumber AS value FROM p WHERE l_linenumber = 6 AND path_name IS NOT NULL
 UNION ALL SELECT 'not numeric', _row, 'owner_office_number', 'NaN' FROM p WHERE l_suppkey % 10 = 3""")
def dq_numeric(spark, sf):
    df = _plans(spark, sf, "number_of_buses", "owner_office_number", *HAJ, "path_name")
    six = F.col("number_of_buses") == 6
    broken = df.withColumns({
        "number_of_buses": F.when(six, F.concat("path_name", F.lit(" 6"))).otherwise(
            F.col("number_of_buses").cast("string")),
        "owner_office_number": F.when(F.split(s.SUB, ":")[1].cast("bigint") % 10 == 3, F.lit("NaN")).otherwise(F.col("owner_office_number")),
    })
    return validate.numeric_violations(broken)


@query("latest_snapshot", """SELECT max(year(o_orderdate)) || '-' || lpad(CAST(max(month(o_orderdate)) FILTER (WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)) AS VARCHAR), 2, '0') AS snapshot,
 count(*) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)) AS rows FROM orders""")
def latest_snapshot(spark, sf):
    named = binding.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"))
    return snapshots.latest_snapshot(named, "snapshot").groupBy("snapshot").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------------------
# Lookups and districts
# ---------------------------------------------------------------------------

_CAMP_TRIM = "coalesce(trim(camp_label), '')"
_PART_LABEL = "concat(p_size, '/', regexp_extract(p_brand, '[0-9]+', 0))"


@query("exit_route_lookup", o.PLANS + f""", er AS (SELECT CASE WHEN p_size % 17 = 0 THEN '' ELSE {_PART_LABEL} END AS camp, 'X' || (p_partkey % 40) AS code,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'route ' || (p_partkey % 60) END AS route_name, p_partkey FROM part WHERE p_partkey % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY camp ORDER BY p_partkey) = 1),
 ep AS (SELECT 'X' || (s_suppkey % 35) AS code, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'exit ' || s_suppkey END AS point_name FROM supplier WHERE s_suppkey % 4 <> 3
  QUALIFY row_number() OVER (PARTITION BY s_suppkey % 35 ORDER BY s_suppkey) = 1)
 SELECT plan_id, _sub, er.code AS exit_code, CASE WHEN er.code IS NOT NULL THEN coalesce(ep.point_name, er.route_name, er.code) END AS exit_name
 FROM p LEFT JOIN er ON er.camp = {_CAMP_TRIM} AND er.camp <> '' AND {o.plan_class(o.filled('plan_type_code', 'plan_type_name'))} = 'tarwia' LEFT JOIN ep ON ep.code = er.code""")
def exit_route_lookup(spark, sf):
    df = lookups.with_exit_route(
        _plans(spark, sf, "plan_id", "camp_label", *TYPE), binding.exit_routes(spark, sf), binding.exit_points(spark, sf))
    return df.select("plan_id", s.SUB, "exit_code", "exit_name")


@query("wildcard_lookup", o.PLANS + f""", w AS (SELECT p.plan_id, p._sub, camp_label, entrance_asm_code, {o.plan_class(o.filled('plan_type_code', 'plan_type_name'))} = 'direct_taseed'
   AND coalesce(internal_path, '') = '' AS applies FROM p),
 paths AS (SELECT p_partkey, {_PART_LABEL} AS camp, 'E' || (p_partkey % 5) AS code FROM part WHERE p_partkey % 5 <> 0),
 pairs AS (SELECT DISTINCT {_CAMP_TRIM} AS camp, coalesce(entrance_asm_code, '') AS code FROM w WHERE applies),
 m AS (SELECT pairs.camp, pairs.code, min(paths.p_partkey) AS pk FROM pairs JOIN paths ON paths.camp = pairs.camp AND (pairs.code = '' OR paths.code = pairs.code) GROUP BY 1, 2)
 SELECT plan_id, _sub, CASE WHEN pk IS NOT NULL THEN 'path ' || pk END AS path_code FROM w LEFT JOIN m ON applies AND m.camp = {_CAMP_TRIM} AND m.code = coalesce(entrance_asm_code, '')""")
def wildcard_lookup(spark, sf):
    df = _plans(spark, sf, "plan_id", "camp_label", "entrance_asm_code", "internal_path", *TYPE)
    return lookups.with_camp_path(df, binding.camp_paths(spark, sf)).select("plan_id", s.SUB, "path_code")


@query("active_paths", o.PLANS + f"""SELECT 'path ' || p_partkey AS path_code, {_PART_LABEL} AS camp FROM part WHERE p_partkey % 5 <> 0
 AND {_PART_LABEL} IN (SELECT trim(camp_label) FROM p WHERE plan_type_code = 'direct_taseed' AND trim(period) = '3')""")
def active_paths(spark, sf):
    df = filters.filter_base(_plans(spark, sf, "camp_label", "plan_type_code", "period"), PlanFilter(period="3"))
    return lookups.active_paths(df, binding.camp_paths(spark, sf)).select("path_code", "camp")


@query("camera_zone", f"WITH {o._CAMERAS}, z AS (SELECT unnest(['ARF', 'MNA', 'MZD', 'MKZ']) AS zone, unnest([39.9848, 39.8903, 39.9362, 39.8262])::DOUBLE AS lon, "
       "unnest([21.3546, 21.4122, 21.3863, 21.4225])::DOUBLE AS lat) "
       f"SELECT name, zone FROM cameras, z QUALIFY row_number() OVER (PARTITION BY name ORDER BY split_part(name, '_', 1) <> zone, {o.metres('longitude', 'latitude', 'lon', 'lat')}) = 1")
def camera_zone(spark, sf):
    return lookups.with_zone(binding.cameras(spark, sf)).select("name", "zone")


_INTENSITY = f""", q AS (SELECT {o.fold('start_point_district')} AS district_key, first(start_point_district ORDER BY _row, start_point_district) AS name,
 sum(pilgrims) AS pilgrims, count(*) AS plans FROM p WHERE start_point_district <> '' AND start_point_type = 'residence' GROUP BY 1),
 shade AS (SELECT *, pilgrims / (SELECT max(pilgrims) FROM q) AS intensity FROM q),
 ramp AS (SELECT *, CASE WHEN intensity <= 0.25 THEN 1 WHEN intensity <= 0.5 THEN 2 WHEN intensity <= 0.75 THEN 3 ELSE 4 END AS k FROM shade),
 mixed AS (SELECT *, [255, 254, 253, 227, 128] AS r, [255, 217, 141, 26, 0] AS g, [204, 118, 60, 28, 38] AS b, (intensity - (k - 1) * 0.25) / 0.25 AS t FROM ramp),
 colored AS (SELECT district_key, name, pilgrims, plans, round(intensity, 6) AS intensity, 'rgb(' || CAST(floor(r[k] + t * (r[k + 1] - r[k]) + 0.5) AS INT) || ',' ||
  CAST(floor(g[k] + t * (g[k + 1] - g[k]) + 0.5) AS INT) || ',' || CAST(floor(b[k] + t * (b[k + 1] - b[k]) + 0.5) AS INT) || ')' AS color FROM mixed)"""


@query("district_intensity", o.PLANS + _INTENSITY + " SELECT * FROM colored")
def district_intensity(spark, sf):
    df = filters.residence_starts(_plans(spark, sf, *HAJ, "start_point_district", "start_point_type"))
    return _rounded(lookups.district_intensity(df), "intensity")


@query("district_choropleth", o.PLANS + _INTENSITY + f""", d AS (SELECT ' حى ' || c_mktsegment AS district_name, min(c_custkey) AS district_code FROM customer GROUP BY 1)
 SELECT {o.fold('district_name')} AS district_key, district_name, district_code, pilgrims, plans, intensity, color FROM d JOIN colored ON colored.district_key = {o.fold('district_name')}""")
def district_choropleth(spark, sf):
    df = filters.residence_starts(_plans(spark, sf, *HAJ, "start_point_district", "start_point_type"))
    return _rounded(lookups.district_choropleth(df, binding.districts(spark, sf)), "intensity")


# ---------------------------------------------------------------------------
# Geometry
# ---------------------------------------------------------------------------


@query("geom_parse", o.PLANS + """, q AS (
 SELECT 'path_geom' AS "column", 'LineString' AS type, 3 AS n FROM p WHERE l_linenumber % 4 <> 0
 UNION ALL SELECT 'internal_path', 'LineString', 2 FROM p WHERE l_linenumber % 3 <> 0
 UNION ALL SELECT 'entrance_polygon', 'Polygon', 5 FROM p WHERE l_linenumber <> 5
 UNION ALL SELECT 'entrance_point_geom', 'Point', 1 FROM p WHERE l_linenumber = 2
 UNION ALL SELECT 'start_geom', 'Point', 1 FROM p WHERE l_linenumber <> 6
 UNION ALL SELECT 'start_point_geom', 'Point', 1 FROM p
 UNION ALL SELECT 'end_point_geom', CASE WHEN l_linenumber = 4 THEN NULL ELSE 'Point' END, CASE WHEN l_linenumber = 4 THEN 0 ELSE 1 END FROM p
 UNION ALL SELECT 'get_parking_geom', 'Point', 1 FROM p WHERE l_linenumber = 3 UNION ALL SELECT 'set_parking_geom', 'Point', 1 FROM p WHERE l_linenumber = 3)
 SELECT "column", type, count(*) AS given, count(type) AS parsed, count(*) - count(type) AS rejected, CAST(sum(n) AS BIGINT) AS vertices FROM q GROUP BY 1, 2""")
def geom_parse(spark, sf):
    return geometry.parse_report(_plans(spark, sf, *SHAPES))


_LABELLED = ("plan_id", *TYPE, *SHAPES, *ENDS, *ENTRANCE, "path_name", "camp_label",
             "get_type_parking", "get_parking_name", "set_type_parking", "set_parking_name")


@query("plan_geometries", f"""{o.PLANS}, {o._SHAPES} SELECT plan_id, _sub, CAST(row_number() OVER (PARTITION BY _row, _sub ORDER BY ord) - 1 AS INT) AS ord, role, label,
 kind AS type, CAST(len(pts) AS INT) AS vertices, pts[1].lon AS lon, pts[1].lat AS lat FROM shapes""")
def plan_geometries(spark, sf):
    first = F.col("geom.parts")[0]
    return geometry.explode_geometries(_plans(spark, sf, *_LABELLED)).select(
        "plan_id", s.SUB, "ord", "role", "label", F.col("geom.type").alias("type"), F.size(first).alias("vertices"),
        first[0]["lon"].alias("lon"), first[0]["lat"].alias("lat"))


# Anchors of the test plans, from the keys: mean of the square's five ring vertices, or the gate itself.
_mean = lambda axis: "(" + " + ".join(["0.0"] + [f"{c}.{axis}" for c in (
    o._corner(-60, -60), o._corner(60, -60), o._corner(60, 60), o._corner(-60, 60), o._corner(-60, -60))]) + ") / 5"
_NONE = "CAST(NULL AS STRUCT(lon DOUBLE, lat DOUBLE))"
_ANCHORS = f"""anchors AS (SELECT *, CASE WHEN start_point_type = 'residence' THEN sa WHEN end_point_type = 'residence' THEN ea END AS ra,
 coalesce(na, CASE WHEN start_point_type <> 'residence' THEN sa END, CASE WHEN end_point_type <> 'residence' THEN ea END) AS da
 FROM (SELECT *, {o._S} AS sa, CASE WHEN l_linenumber <> 4 THEN {o._E} ELSE {_NONE} END AS ea,
  CASE WHEN l_linenumber = 2 THEN {o._G} WHEN l_linenumber <> 5 THEN {{'lon': {_mean('lon')}, 'lat': {_mean('lat')}}} ELSE {_NONE} END AS na FROM p))"""


@query("anchors", f"""{o.PLANS}, {_ANCHORS} SELECT plan_id, _sub, {', '.join(f'round({a}.{x}, 9) AS {n}_{x}' for n, a in
    (('start', 'sa'), ('end', 'ea'), ('entrance', 'na'), ('residence', 'ra'), ('destination', 'da')) for x in ('lon', 'lat'))} FROM anchors""")
def anchors(spark, sf):
    names = ("start", "end", "entrance", "residence", "destination")
    return geometry.with_anchors(_plans(spark, sf, *ROUTES)).select(
        "plan_id", s.SUB, *[F.round(F.col(f"{n}_anchor.{x}"), 9).alias(f"{n}_{x}") for n in names for x in ("lon", "lat")])


def _gap(a: str, b: str) -> str:
    return f"coalesce({o.metres(f'{a}.lon', f'{a}.lat', f'{b}.lon', f'{b}.lat')}, 'inf'::DOUBLE)"


def _leg(a: str, b: str) -> str:
    """Whole micrometres, so that sums of the same legs are equal in any order."""
    return f"round({_gap(a, b)} * 1e6)"


@query("haversine", f"{o.PLANS}, {_ANCHORS} SELECT plan_id, _sub, round({_gap('sa', 'ea')}, 3) AS metres FROM anchors")
def haversine(spark, sf):
    ends = geometry.with_anchors(_plans(spark, sf, *ROUTES))
    return ends.select("plan_id", s.SUB, F.round(
        geo.distance_m(F.col("start_anchor"), F.col("end_anchor")), 3).alias("metres"))


def _reverse(role: str, h: str, t_: str) -> str:
    margin = f"CASE WHEN {role} = 'internal' THEN 10 ELSE 6 END"
    pair = lambda a, b: f"{_gap(t_, a)} + {_gap(h, b)} + {margin} < {_gap(h, a)} + {_gap(t_, b)}"
    return (f"CASE WHEN {role} = 'internal' AND na IS NOT NULL THEN {_gap(t_, 'na')} < {_gap(h, 'na')} "
            f"WHEN ra IS NOT NULL AND da IS NOT NULL THEN {pair('ra', 'da')} "
            f"WHEN ra IS NOT NULL THEN {_gap(t_, 'ra')} + {margin} < {_gap(h, 'ra')} "
            f"WHEN sa IS NOT NULL AND ea IS NOT NULL THEN {pair('sa', 'ea')} "
            f"WHEN sa IS NOT NULL THEN {_gap(t_, 'sa')} + {margin} < {_gap(h, 'sa')} "
            f"WHEN ea IS NOT NULL THEN {_gap(h, 'ea')} + {margin} < {_gap(t_, 'ea')} ELSE false END")


_LINES = f"""lines AS (SELECT s.*, pts[1] AS h, pts[-1] AS t, a.sa, a.ea, a.na, a.ra, a.da FROM shapes s JOIN anchors a USING (_row, _sub) WHERE kind = 'LineString'),
 turned AS (SELECT *, {_reverse('role', 'h', 't')} AS rev FROM lines)"""


@query("route_orientation", f"""{o.PLANS}, {o._SHAPES}, {_ANCHORS}, {_LINES} SELECT plan_id, _sub, role, rev AS reversed,
 CASE WHEN rev THEN t.lon ELSE h.lon END AS head_lon, CASE WHEN rev THEN t.lat ELSE h.lat END AS head_lat,
 CASE WHEN rev THEN h.lon ELSE t.lon END AS tail_lon, CASE WHEN rev THEN h.lat ELSE t.lat END AS tail_lat FROM turned""")
def route_orientation(spark, sf):
    return _flat_ends(orient.route_orientation(_plans(spark, sf, *ROUTES)), "role", "reversed")


def _flat_ends(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("plan_id", s.SUB, *columns, *[
        F.col(f"{end}.{x}").alias(f"{end}_{x}") for end in ("head", "tail") for x in ("lon", "lat")])


# Two lines at most without lookups: internal then external. Eight candidates:
# order (0: as listed, 1: swapped) times direction mask.
_CHAINED = f"""pairs AS (SELECT i._row, i._sub, i.plan_id, i.h AS ih, i.t AS it, e.h AS eh, e.t AS et, i.sa, i.ea, i.na, i.ra, i.da,
  coalesce(i.ra, i.sa) AS src, coalesce(i.da, i.ea) AS dst FROM lines i JOIN lines e USING (_row, _sub) WHERE i.role = 'internal' AND e.role = 'external'),
 tries AS (SELECT *, unnest(range(0, 8)) AS c FROM pairs WHERE src IS NOT NULL AND dst IS NOT NULL),
 laid AS (SELECT *, CASE WHEN c < 4 THEN CASE WHEN c & 1 = 1 THEN it ELSE ih END ELSE CASE WHEN c & 1 = 1 THEN et ELSE eh END END AS h1,
  CASE WHEN c < 4 THEN CASE WHEN c & 1 = 1 THEN ih ELSE it END ELSE CASE WHEN c & 1 = 1 THEN eh ELSE et END END AS t1,
  CASE WHEN c < 4 THEN CASE WHEN c & 2 = 2 THEN et ELSE eh END ELSE CASE WHEN c & 2 = 2 THEN it ELSE ih END END AS h2,
  CASE WHEN c < 4 THEN CASE WHEN c & 2 = 2 THEN eh ELSE et END ELSE CASE WHEN c & 2 = 2 THEN ih ELSE it END END AS t2 FROM tries),
 best AS MATERIALIZED (SELECT * FROM laid QUALIFY row_number() OVER (PARTITION BY _row, _sub ORDER BY {_leg('src', 'h1')} + {_leg('t1', 'h2')} + {_leg('t2', 'dst')}, c) = 1),
 single AS (SELECT *, row_number() OVER (PARTITION BY _row, _sub ORDER BY ord) - 1 AS position,
   CASE WHEN rev THEN t ELSE h END AS h1, CASE WHEN rev THEN h ELSE t END AS t1 FROM turned ANTI JOIN best USING (_row, _sub)),
 chained AS MATERIALIZED (SELECT _row, _sub, plan_id, 0 AS position, CASE WHEN c < 4 THEN 'internal' ELSE 'external' END AS role, h1 AS h, t1 AS t, sa, ea, na, ra, da FROM best
  UNION ALL SELECT _row, _sub, plan_id, 1, CASE WHEN c < 4 THEN 'external' ELSE 'internal' END, h2, t2, sa, ea, na, ra, da FROM best
  UNION ALL SELECT _row, _sub, plan_id, position, role, h1, t1, sa, ea, na, ra, da FROM single)"""


@query("connected_routes", f"""{o.PLANS}, {o._SHAPES}, {_ANCHORS}, {_LINES}, {_CHAINED},
 last AS (SELECT *, CASE WHEN role = 'internal' THEN {_reverse('role', 'h', 't')} ELSE false END AS again FROM chained)
 SELECT plan_id, _sub, CAST(position AS INT) AS position, role, CASE WHEN again THEN t.lon ELSE h.lon END AS head_lon, CASE WHEN again THEN t.lat ELSE h.lat END AS head_lat,
 CASE WHEN again THEN h.lon ELSE t.lon END AS tail_lon, CASE WHEN again THEN h.lat ELSE t.lat END AS tail_lat FROM last""")
def connected_routes(spark, sf):
    return _flat_ends(orient.connected_routes(_plans(spark, sf, *ROUTES)), "position", "role")


_EXIT_LINES = f"""k AS MATERIALIZED (SELECT _row, _sub, plan_id, {o.plan_class(o.filled('plan_type_code', 'plan_type_name'))} AS class, {_CAMP_TRIM} AS camp,
   coalesce(entrance_asm_code, '') AS code, coalesce(internal_path, '') = '' AS bare FROM p),
 er AS (SELECT CASE WHEN p_size % 17 = 0 THEN '' ELSE {_PART_LABEL} END AS camp, 'X' || (p_partkey % 40) AS xcode, p_partkey AS xk FROM part WHERE p_partkey % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY camp ORDER BY p_partkey) = 1),
 ep AS (SELECT 'X' || (s_suppkey % 35) AS xcode, {o._pt(o._deg('3991000 + (s_suppkey % 50) * 30'), o._deg('2141000'))} AS xp FROM supplier WHERE s_suppkey % 4 <> 3
  QUALIFY row_number() OVER (PARTITION BY s_suppkey % 35 ORDER BY s_suppkey) = 1),
 paths AS (SELECT p_partkey, {_PART_LABEL} AS camp, 'E' || (p_partkey % 5) AS code FROM part WHERE p_partkey % 5 <> 0),
 pairs AS (SELECT DISTINCT camp, code FROM k WHERE class = 'direct_taseed' AND bare),
 m AS (SELECT pairs.camp, pairs.code, min(paths.p_partkey) AS pk FROM pairs JOIN paths ON paths.camp = pairs.camp AND (pairs.code = '' OR paths.code = pairs.code) GROUP BY 1, 2),
 every_line AS (SELECT _row, _sub, ord, role, pts[1] AS h, pts[-1] AS t, {_NONE} AS xp FROM shapes WHERE kind = 'LineString'
  UNION ALL SELECT _row, _sub, 0, 'internal', {o._pt(o._deg('3993000 + (pk % 50) * 30'), o._deg('2143000'))}, {o._pt(o._deg('3994000'), o._deg('2144000 + (pk % 20) * 30'))}, {_NONE}
   FROM k JOIN m USING (camp, code) WHERE class = 'direct_taseed' AND bare
  UNION ALL SELECT _row, _sub, 1, 'tarwia_exit', {o._pt(o._deg('3991000 + (xk % 50) * 30'), o._deg('2141000'))}, {o._pt(o._deg('3992000'), o._deg('2142000 + (xk % 20) * 30'))}, xp
   FROM k JOIN er USING (camp) LEFT JOIN ep USING (xcode) WHERE class = 'tarwia' AND camp <> ''),
 plan_lines AS MATERIALIZED (SELECT _row, _sub, list({{'role': role, 'h': h, 't': t, 'xp': xp}} ORDER BY ord) AS ls FROM every_line GROUP BY 1, 2),
 legs AS MATERIALIZED (SELECT a._row, a._sub, a.plan_id, ls, len(ls) AS n, sa, ea, na, ra, da, coalesce(ra, sa) AS src, coalesce(da, ea) AS dst FROM plan_lines JOIN anchors a USING (_row, _sub)),
 tries AS (SELECT *, unnest(range(0, CASE WHEN n = 2 THEN 8 ELSE CAST(pow(2, n) AS BIGINT) END)) AS c FROM legs WHERE n >= 2 AND src IS NOT NULL AND dst IS NOT NULL),
 laid AS (SELECT _row, _sub, c, src, dst, n, list_transform(range(0, n), lambda i: CASE WHEN (c >> i) & 1 = 1
   THEN {{'role': s[i + 1].role, 'h': s[i + 1].t, 't': s[i + 1].h, 'xp': s[i + 1].xp}} ELSE s[i + 1] END) AS way
  FROM (SELECT *, CASE WHEN n = 2 AND c >= 4 THEN list_reverse(ls) ELSE ls END AS s FROM tries)),
 best AS (SELECT _row, _sub, arg_min(way, ({_leg('src', 'way[1].h')} + CASE WHEN n > 1 THEN {_leg('way[1].t', 'way[2].h')} ELSE 0 END
   + CASE WHEN n > 2 THEN {_leg('way[2].t', 'way[3].h')} ELSE 0 END + {_leg('way[n].t', 'dst')}, c)) AS way FROM laid GROUP BY 1, 2),
 placed AS (SELECT l._row, l._sub, l.plan_id, best.way IS NULL AS alone, sa, ea, na, ra, da, unnest(coalesce(best.way, ls)) AS x, unnest(range(0, n)) AS position
  FROM legs l LEFT JOIN best USING (_row, _sub)),
 flat AS (SELECT *, x.role AS role, x.h AS h, x.t AS t, x.xp AS xp FROM placed),
 first_turn AS (SELECT * REPLACE (CASE WHEN r THEN t ELSE h END AS h, CASE WHEN r THEN h ELSE t END AS t) FROM (SELECT *, alone AND {_reverse('role', 'h', 't')} AS r FROM flat)),
 last AS (SELECT *, CASE WHEN role = 'internal' THEN {_reverse('role', 'h', 't')} WHEN role = 'tarwia_exit' AND xp IS NOT NULL THEN {_gap('h', 'xp')} < {_gap('t', 'xp')} ELSE false END AS again FROM first_turn)"""


@query("connected_routes_exits", f"""{o.PLANS}, {o._SHAPES}, {_ANCHORS}, {_EXIT_LINES}
 SELECT plan_id, _sub, CAST(position AS INT) AS position, role, CASE WHEN again THEN t.lon ELSE h.lon END AS head_lon, CASE WHEN again THEN t.lat ELSE h.lat END AS head_lat,
 CASE WHEN again THEN h.lon ELSE t.lon END AS tail_lon, CASE WHEN again THEN h.lat ELSE t.lat END AS tail_lat FROM last""")
def connected_routes_exits(spark, sf):
    df = lookups.with_camp_path(_plans(spark, sf, *ROUTES, "camp_label", "entrance_asm_code"), binding.camp_paths(spark, sf))
    df = lookups.with_exit_route(df, binding.exit_routes(spark, sf), binding.exit_points(spark, sf))
    return _flat_ends(orient.connected_routes(df), "position", "role")


def _gaps_sql(shapes: str) -> str:
    """Only direct plans are chained, and the next line comes by ``lead``."""
    direct = f"{o.plan_class(o.filled('plan_type_code', 'plan_type_name'))} = 'direct_taseed'"
    return f"""{o.plans_where(direct)}, {shapes}, {_ANCHORS}, {_LINES}, {_CHAINED},
 successors AS (SELECT plan_id, _sub, position, t, lead(h) OVER (PARTITION BY _row, _sub ORDER BY position) AS next FROM chained)
 SELECT plan_id, _sub, CAST(position AS INT) AS position, round({_gap('t', 'next')}, 3) AS metres FROM successors WHERE next IS NOT NULL AND {_gap('t', 'next')} BETWEEN 12 AND 5000"""


def _gaps(plans: DataFrame) -> DataFrame:
    return orient.route_gaps(plans).select("plan_id", s.SUB, "position", F.round("metres", 3).alias("metres"))


@query("route_gaps", _gaps_sql(o._SHAPES))
def route_gaps(spark, sf):
    return _gaps(_plans(spark, sf, *ROUTES))


@query("route_gaps_shifted", _gaps_sql(o.SHIFTED_SHAPES))
def route_gaps_shifted(spark, sf):
    """External lines that stop beside the internal ones, at distances on all sides of the two limits."""
    corner = lambda end, k: F.regexp_extract(f"{end}_point_geom", r"\(([0-9.]+) ([0-9.]+)\)", k)
    shift = F.element_at(F.array(*map(F.lit, o.SHIFTS)), (F.col(s.ROW) % 4 + 1).cast("int"))
    lat = F.round(corner("end", 2).cast("double") + shift, 5).cast("string")
    shifted = F.concat(F.lit("LINESTRING ("), corner("start", 1), F.lit(" "), corner("start", 2), F.lit(", "), corner("end", 1), F.lit(" "), lat, F.lit(")"))
    return _gaps(_plans(spark, sf, *ROUTES).withColumn("path_geom", F.when(F.col("path_geom").isNotNull(), shifted)))


@query("geo_bounds", f"""{o.PLANS}, {o._SHAPES}, v AS (SELECT unnest(pts) AS q FROM shapes)
 SELECT min(q.lon) AS min_lon, min(q.lat) AS min_lat, max(q.lon) AS max_lon, max(q.lat) AS max_lat, (SELECT count(*) FROM shapes) AS geometries FROM v""")
def geo_bounds(spark, sf):
    return geometry.geometry_bounds(_plans(spark, sf, "plan_id", *TYPE, *SHAPES))


@query("dq_routes", f"""{o.PLANS}, {o._SHAPES}, {_ANCHORS}, i AS (SELECT a.l_linenumber, s.pts[1] AS h, s.pts[-1] AS t, a.sa, a.ea FROM anchors a
  LEFT JOIN (SELECT * FROM shapes WHERE role = 'internal') s USING (_row, _sub)),
 v AS (SELECT CASE WHEN h IS NULL THEN 'missing' WHEN {_gap('t', 'sa')} + {_gap('h', 'ea')} < {_gap('h', 'sa')} + {_gap('t', 'ea')} THEN 'reversed'
  WHEN {_gap('h', 'sa')} > 50 THEN 'start off' WHEN {_gap('t', 'ea')} > 50 THEN 'end off' ELSE 'ok' END AS verdict FROM i)
 SELECT verdict, count(*) AS plans FROM v GROUP BY 1""")
def dq_routes(spark, sf):
    return validate.route_quality(_plans(spark, sf, *ROUTES))


# ---------------------------------------------------------------------------
# Proximity
# ---------------------------------------------------------------------------

_NEAR_CAMERAS = f"{o.PLANS}, {o._SHAPES}, {o._CAMERAS}, {o._near('cameras', 'name')}"
_PASSING = """passing AS (SELECT _row, _sub, plan_id, pid AS camera FROM shape_edges JOIN close USING (x1, y1, x2, y2)
 UNION SELECT _row, _sub, plan_id, pid FROM shapes JOIN inside ON kind = 'Polygon' AND pts[1].lon = west AND pts[1].lat = south)"""


@query("camera_plan_join", f"{_NEAR_CAMERAS}, {_PASSING} SELECT plan_id, _sub, camera FROM passing")
def camera_plan_join(spark, sf):
    return proximity.camera_plan_pairs(_plans(spark, sf, "plan_id", *TYPE, *SHAPES), binding.cameras(spark, sf)).select(
        "plan_id", s.SUB, "camera")


@query("camera_stats", f"""{_NEAR_CAMERAS}, {_PASSING}, w AS (SELECT camera, coalesce({o.filled('plan_type_name', 'plan_type_code')}, '{s.NOT_GIVEN}') AS plan_type,
 coalesce(nullif(transport_type_name, ''), '{s.NOT_GIVEN}') AS transport, coalesce(nullif(owner_company_name, ''), '{s.NOT_GIVEN}') AS company,
 CASE WHEN {o.truthy('owner_office_number')} THEN owner_office_number ELSE '{s.NOT_GIVEN}' END AS center, buses, trips FROM passing JOIN p USING (_row, _sub))
 SELECT 'group' AS level, camera, plan_type, transport, company, center, sum(buses) AS buses, sum(trips) AS trips FROM w GROUP BY ALL
 UNION ALL SELECT 'camera', camera, NULL, NULL, NULL, NULL, sum(buses), sum(trips) FROM w GROUP BY 2""")
def camera_stats(spark, sf):
    return proximity.camera_stats(_plans(spark, sf, "plan_id", *OWNER, *LOAD, *TYPE, *SHAPES), binding.cameras(spark, sf))


@query("gates_near_plans", f"{o.PLANS}, {o._SHAPES}, {o._GATES}, {o._near('gates', 'gate_id')} "
       "SELECT gate_id, source, capacity, longitude, latitude FROM gates WHERE gate_id IN (SELECT pid FROM near)")
def gates_near_plans(spark, sf):
    return proximity.points_near_plans(_plans(spark, sf, "plan_id", *TYPE, *SHAPES), binding.gates(spark, sf), "gate_id", all_without_geometry=False)


@query("cameras_near_plans", f"{_NEAR_CAMERAS} SELECT name FROM cameras WHERE name IN (SELECT pid FROM near)")
def cameras_near_plans(spark, sf):
    return proximity.points_near_plans(_plans(spark, sf, "plan_id", *TYPE, *SHAPES), binding.cameras(spark, sf), "name", all_without_geometry=True).select("name")


@query("gates_without_geometry", f"WITH {o._GATES} SELECT gate_id FROM gates")
def gates_without_geometry(spark, sf):
    broken = _plans(spark, sf, "plan_id", *TYPE, *SHAPES).withColumns({c: F.concat(F.lit("{"), c) for c in SHAPES})
    return proximity.points_near_plans(broken, binding.gates(spark, sf), "gate_id", all_without_geometry=True).select("gate_id")


@query("camera_direction", f"""{_NEAR_CAMERAS}, {_PASSING},
 firsts AS (SELECT _row, _sub, pts FROM shapes WHERE kind = 'LineString' QUALIFY row_number() OVER (PARTITION BY _row, _sub ORDER BY ord) = 1),
 duos AS (SELECT DISTINCT f.pts, p2.camera FROM passing p2 JOIN firsts f USING (_row, _sub)),
 legs AS (SELECT pts, camera, unnest(range(1, len(pts))) AS i FROM duos),
 flat AS (SELECT legs.*, longitude AS x, latitude AS y, (pts[i].lon - longitude) * cos(radians(latitude)) * {o._M_PER_DEG} AS ax, (pts[i].lat - latitude) * {o._M_PER_DEG} AS ay,
  (pts[i + 1].lon - longitude) * cos(radians(latitude)) * {o._M_PER_DEG} AS bx, (pts[i + 1].lat - latitude) * {o._M_PER_DEG} AS by_ FROM legs JOIN cameras ON cameras.name = legs.camera),
 foot AS (SELECT *, least(greatest(-(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0.0), 1.0) AS t FROM flat),
 nearest AS (SELECT * FROM foot QUALIFY row_number() OVER (PARTITION BY pts, camera ORDER BY sqrt((ax + t * (bx - ax)) * (ax + t * (bx - ax)) + (ay + t * (by_ - ay)) * (ay + t * (by_ - ay))), i) = 1),
 z AS (SELECT unnest(['ARF', 'MNA', 'MZD', 'MKZ']) AS zone, unnest([39.9848, 39.8903, 39.9362, 39.8262])::DOUBLE AS lon, unnest([21.3546, 21.4122, 21.3863, 21.4225])::DOUBLE AS lat),
 zoned AS (SELECT name, lon, lat FROM cameras, z QUALIFY row_number() OVER (PARTITION BY name ORDER BY split_part(name, '_', 1) <> zone, {o.metres('longitude', 'latitude', 'lon', 'lat')}) = 1),
 aimed AS (SELECT pts, camera, least(i + CASE WHEN t >= 1 THEN 1 ELSE 0 END, len(pts) - 1) AS k, x, y, lon, lat FROM nearest JOIN zoned ON zoned.name = nearest.camera),
 turns AS (SELECT pts, camera, abs({o.bearing('pts[k].lon', 'pts[k].lat', 'pts[k + 1].lon', 'pts[k + 1].lat')} - {o.bearing('x', 'y', 'lon', 'lat')}) AS d FROM aimed)
 SELECT passing.plan_id, passing._sub, passing.camera, CASE WHEN d IS NULL THEN 'unknown' WHEN CASE WHEN d > 180 THEN 360 - d ELSE d END <= 90 THEN 'entry' ELSE 'exit' END AS direction
 FROM passing LEFT JOIN firsts USING (_row, _sub) LEFT JOIN turns ON turns.pts = firsts.pts AND turns.camera = passing.camera""")
def camera_direction(spark, sf):
    return proximity.camera_directions(_plans(spark, sf, "plan_id", *TYPE, *SHAPES), binding.cameras(spark, sf)).select(
        "plan_id", s.SUB, "camera", "direction")


# ---------------------------------------------------------------------------
# Files and streams: the tables are written to the shared folder and read back
# ---------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(ingest.shared_folder(spark), f"{name}-{uuid.uuid4().hex[:8]}")


_CSV_COLUMNS = ("plan_id", *OWNER, "camp_label", *ALLOC, "number_of_buses", *TYPE, "period", "path_name", "internal_path")


@query("plans_csv", o.PLANS + """SELECT plan_id, owner_company_name, owner_office_number, camp_label, CAST(allocated_haj AS DOUBLE) AS allocated_haj,
 number_of_haj, number_of_buses, period, internal_path FROM (SELECT * REPLACE (nullif(camp_label, '') AS camp_label) FROM p)""")
def plans_csv(spark, sf):
    path = _csv(_plans(spark, sf, *_CSV_COLUMNS).drop(s.ROW, s.SUB), _folder(spark, "plans"))
    return files.read_plans(spark, path).select(
        "plan_id", *OWNER, "camp_label", *ALLOC, "number_of_buses", "period", "internal_path")


@query("camera_stats_csv", f"""SELECT camera, plan_type, transport, company, center, CASE WHEN buses = floor(buses) THEN CAST(CAST(buses AS BIGINT) AS VARCHAR)
 ELSE CAST(buses AS VARCHAR) END AS buses, CASE WHEN trips = floor(trips) THEN CAST(CAST(trips AS BIGINT) AS VARCHAR) ELSE CAST(trips AS VARCHAR) END AS trips
 FROM ({_ORACLES['camera_stats']}) WHERE level = 'group'""")
def camera_stats_csv(spark, sf):
    path = _folder(spark, "camera-stats")
    stats = proximity.camera_stats(_plans(spark, sf, "plan_id", *OWNER, *LOAD, *TYPE, *SHAPES), binding.cameras(spark, sf))
    snapshots_sink.write_camera_stats(stats, path, compression="gzip")
    return spark.read.options(header=True, escape='"').csv(path).toDF(*snapshots_sink.CAMERA_HEADER)


def _csv(df: DataFrame, path: str, **options) -> str:
    df.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(path)
    return path


def _json_arrays(df: DataFrame, path: str) -> str:
    """Writes rows as files that hold one JSON array each."""
    row = F.struct(*df.columns)
    files_ = df.groupBy(F.pmod(F.xxhash64(row), F.lit(64)).alias("k")).agg(F.to_json(F.collect_list(row)).alias("value"))
    files_.repartition(64, "k").select("k", "value").write.partitionBy("k").text(path)
    return path


@query("camps_csv", f"WITH {o._CAMPS} SELECT camp_label, service_company_name, office_number, nationality, service_center_name, number_of_piligrim FROM c")
def camps_csv(spark, sf):
    """Two sets of files with columns in different order, and a heading with a line break."""
    camps, path = binding.camps(spark, sf), _folder(spark, "camps-csv")
    names = ["camp_label", "service_company_name", "office_number", "nationality", "service_center_name", "number_of_piligrim"]
    mode = F.lit("bus").alias("transport_mode\n")
    _csv(camps.where(F.col(s.ROW) % 2 == 0).select(*names, mode), f"{path}/part=0")
    _csv(camps.where(F.col(s.ROW) % 2 == 1).select(mode, *reversed(names)), f"{path}/part=1")
    return files.read_camps(spark, path, strict=True).select(*names)


@query("residences_csv", f"WITH {o._RESIDENCES} SELECT license_number, trim(residence_name) AS residence_name, service_company, service_center_number FROM residences")
def residences_csv(spark, sf):
    """Human headings after a byte-order mark, and a column without a name."""
    homes = binding.residences(spark, sf).select(
        F.col("license_number").alias("\ufeffLicense Number"), F.concat(F.lit(" "), "residence_name", F.lit(" ")).alias("Name"),
        F.col("service_company").alias("Service_company"), F.col("service_center_number").alias("Service_center_number"), F.lit("x").alias(" "))
    return files.read_residences(spark, _csv(homes, _folder(spark, "homes-csv")), strict=True).select(
        "license_number", "residence_name", "service_company", "service_center_number")


@query("cameras_json", f"WITH {o._CAMERAS} SELECT name, longitude, latitude, altitude FROM cameras")
def cameras_json(spark, sf):
    path = _json_arrays(binding.cameras(spark, sf), _folder(spark, "cameras"))
    return files.read_cameras(spark, path, strict=True).select("name", "longitude", "latitude", "altitude")


@query("gates_json", f"WITH {o._GATES} SELECT source, capacity, longitude, latitude FROM gates")
def gates_json(spark, sf):
    path = _json_arrays(binding.gates(spark, sf), _folder(spark, "gates"))
    return files.read_gates(spark, path, strict=True).select("source", "capacity", "longitude", "latitude")


@query("dq_row_width", """SELECT 'row width' AS "check", event_id || ',' || event_type AS value FROM events WHERE event_id % 7 = 3
 UNION ALL SELECT 'row width', event_id || ',' || event_type || ',' || user_id || ',more' FROM events WHERE event_id % 7 = 5""")
def dq_row_width(spark, sf):
    """Events as text lines, some with a cell too few or too many."""
    path, left = _folder(spark, "widths"), F.col("event_id") % 7
    cells = F.when(left == 3, F.concat_ws(",", "event_id", "event_type")).when(
        left == 5, F.concat_ws(",", "event_id", "event_type", "user_id", F.lit("more"))).otherwise(F.concat_ws(",", "event_id", "event_type", "user_id"))
    lines = binding.table(spark, sf, "events").select(cells.alias("event_id,event_type,user_id"))
    lines.write.options(header=True, sep="\u0001").csv(path)
    return validate.width_violations(files.read_csv(spark, path, corrupt=True)).select("check", "value")


@query("published_snapshot", f"WITH {o._CAMPS} SELECT _row, camp_label, service_company_name, number_of_piligrim FROM c")
def published_snapshot(spark, sf):
    stored = snapshots_sink.publish(binding.camps(spark, sf), _folder(spark, "camps"), source="part")
    return stored.select(s.ROW, "camp_label", "service_company_name", "number_of_piligrim")


_BLOCK_BITS = 16  # row numbers of a block, of which a file holds one remainder


def _collections(df: DataFrame, path: str, properties: dict, coordinates: str, files_: int) -> str:
    """Writes rows as GeoJSON collections, folders by the remainder of the row number, in which features are in the order of their rows.

    A collection is read by one task, so a file holds the rows of one block of row numbers; paths are in the order of blocks.
    """
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*[c.alias(n) for n, c in properties.items()])), F.lit(',"geometry":'),
        F.to_json(F.struct(F.lit(coordinates).alias("type"), F.col("shape").alias("coordinates"))), F.lit("}"))
    number = F.shiftright(F.col(s.ROW), _BLOCK_BITS) + (1 << 62 >> _BLOCK_BITS << 1)  # never negative
    block = F.lpad(number.cast("string"), 16, "0")
    grouped = df.groupBy((F.col(s.ROW) % files_).alias("part"), block.alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(s.ROW, feature.alias("f")))), lambda x: x["f"]), ",\n").alias("all"))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("all"), F.lit("]}"))
    grouped.select("part", "block", whole.alias("value")).write.partitionBy("part", "block").text(path)
    return path


def _vertices(geometry: Column, kind: str) -> Column:
    pairs = F.transform(F.get(geometry["parts"], F.lit(0)), lambda p: F.array(p["lon"], p["lat"]))
    return F.get(pairs, F.lit(0)) if kind == "Point" else pairs


@query("exit_routes_geojson", """WITH q AS (SELECT p_partkey, CASE WHEN p_size % 17 <> 0 THEN ' ' || p_size || '/' || regexp_extract(p_brand, '[0-9]+', 0) END AS camp_label,
  'X' || (p_partkey % 40) AS exit_code, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'route ' || (p_partkey % 60) END AS route_name FROM part WHERE p_partkey % 3 <> 0)
 SELECT camp_label, exit_code, route_name, row_number() OVER (ORDER BY p_partkey % 4, p_partkey) AS position,
 (3991000 + (p_partkey % 50) * 30) / 100000.0::DOUBLE AS head_lon, 21.41::DOUBLE AS head_lat, 39.92::DOUBLE AS tail_lon, (2142000 + (p_partkey % 20) * 30) / 100000.0::DOUBLE AS tail_lat FROM q""")
def exit_routes_geojson(spark, sf):
    raw = binding.exit_routes(spark, sf).withColumn("shape", _vertices(geo.parse_geometry(F.col("geom_text")), "LineString"))
    path = _collections(raw, _folder(spark, "exit-routes"), {"camp_label": F.col("camp_label"), "ASMCODE": F.col("exit_code"), "MINASM": F.col("route_name")},
                        "LineString", 4)
    points = geo.line_points(geo.parse_geometry(F.col("geom_text")))
    rows = files.exit_routes(files.read_features(spark, f"{path}/part=*/block=*")).select(
        s.ROW, "camp_label", "exit_code", F.nullif("route_name", F.lit("")).alias("route_name"), F.get(points, F.lit(0)).alias("head"), F.try_element_at(points, F.lit(-1)).alias("tail"))
    placed = ordering.with_position(rows.orderBy(s.ROW), _folder(spark, "order"))
    return placed.select("camp_label", "exit_code", "route_name", "position", *[F.col(f"{e}.{x}").alias(f"{e}_{x}") for e in ("head", "tail") for x in ("lon", "lat")])


@query("exit_points_geojson", """SELECT 'X' || (s_suppkey % 35) || ' ' AS exit_code, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'exit ' || s_suppkey END AS exit_name,
 row_number() OVER (ORDER BY s_suppkey % 3, s_suppkey) AS position, (3991000 + (s_suppkey % 50) * 30) / 100000.0::DOUBLE AS lon, 21.41::DOUBLE AS lat
 FROM supplier WHERE s_suppkey % 4 <> 3""")
def exit_points_geojson(spark, sf):
    raw = binding.exit_points(spark, sf).withColumn("shape", _vertices(geo.parse_geometry(F.col("geom_text")), "Point"))
    path = _collections(raw, _folder(spark, "exit-points"), {"MINASM_Code": F.col("exit_code"), "MINASM_Name": F.col("exit_name")}, "Point", 3)
    spot = geo.representative_point(geo.parse_geometry(F.col("geom_text")))
    rows = files.exit_points(files.read_features(spark, f"{path}/part=*/block=*")).select(s.ROW, "exit_code", F.nullif("exit_name", F.lit("")).alias("exit_name"), spot.alias("spot"))
    placed = ordering.with_position(rows.orderBy(s.ROW), _folder(spark, "order"))
    return placed.select("exit_code", "exit_name", "position", F.col("spot.lon").alias("lon"), F.col("spot.lat").alias("lat"))


@query("republished_snapshot", f"WITH {o._CAMPS} SELECT _row, camp_label, number_of_piligrim + 1 AS number_of_piligrim, 'second' AS source_file FROM c")
def republished_snapshot(spark, sf):
    """A table made from the current snapshot becomes the next; a newer folder that is not recorded is never read."""
    path = _folder(spark, "camps")
    snapshots_sink.publish(binding.camps(spark, sf), path, source="first")
    more = snapshots_sink.current(spark, path).drop("source_file", "saved_at").withColumn("number_of_piligrim", F.col("number_of_piligrim") + 1)
    snapshots_sink.publish(more, path, source="second")
    more.limit(1).write.parquet(f"{path}/version=9999-unfinished")
    return snapshots_sink.current(spark, path).select(s.ROW, "camp_label", "number_of_piligrim", "source_file")


@query("stream_ingest", """SELECT event_id AS plan_id, user_id % 24 AS period, value AS number_of_haj FROM events
 WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def stream_ingest(spark, sf):
    events = spark.readStream.schema(binding.table(spark, sf, "events").schema).parquet(os.path.join(sf, "events.parquet*"))
    loads = events.select(
        F.col("event_id").alias("plan_id"), (F.col("user_id") % 24).alias("period"), F.col("value").alias("number_of_haj"),
        F.date_diff(F.col("ts").cast("date"), F.lit("2000-01-01").cast("date")).cast("bigint").alias("load_seq"))
    root = _folder(spark, "stream")
    running = ingest.start_ingest(loads, os.path.join(root, "plans"), os.path.join(root, "checkpoint"))
    running.awaitTermination()
    return ingest.current_snapshot(spark, os.path.join(root, "plans")).select("plan_id", "period", "number_of_haj")


@query("stream_files", """SELECT event_id::VARCHAR AS plan_id, (user_id % 24)::VARCHAR AS period, value::DOUBLE AS number_of_haj FROM events WHERE event_id % 5 = 3""")
def stream_files(spark, sf):
    """Five plan files arrive; the newest has text for numbers and becomes a finding, so the one before is the current load."""
    root = _folder(spark, "arrivals")
    events = binding.table(spark, sf, "events").withColumn("load", F.col("event_id") % 5 + 1)
    cells = {"plan_id": F.col("event_id").cast("string"), "period": (F.col("user_id") % 24).cast("string"),
             "number_of_haj": F.when(F.col("load") == 5, F.lit("many")).otherwise(F.col("value").cast("string"))}
    named = events.select("load", *[cells.get(c, F.lit("")).alias(c) for c in s.REQUIRED_COLUMNS])
    named.repartition("load").write.option("header", True).partitionBy("load").csv(f"{root}/in")
    target = f"{root}/plans"
    arrivals = ingest.read_plan_stream(spark, f"{root}/in/load=*", number=r"load=(\d+)/")
    ingest.start_ingest(arrivals, target, f"{root}/checkpoint", s.REQUIRED_COLUMNS).awaitTermination()
    return ingest.current_snapshot(spark, target).select("plan_id", "period", "number_of_haj")


@query("dq_no_data", """SELECT 'no data' AS "check", t AS "value" FROM (SELECT 'camps' AS t, count(*) AS n FROM part WHERE p_size > 1000
 UNION ALL SELECT 'all camps', count(*) FROM part) WHERE n = 0""")
def dq_no_data(spark, sf):
    camps = binding.table(spark, sf, "part")
    named = lambda df, name: validate.no_rows(df).select("check", F.lit(name).alias("value"))
    return named(camps.where("p_size > 1000"), "camps").unionByName(named(camps, "all camps"))


# ---------------------------------------------------------------------------
# ---------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the ranked company table."""
    return _QUERIES["company_table"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return _QUERIES | (llm.QUERIES if llm else {})


def oracle_sql() -> dict[str, str]:
    return _ORACLES | (llm.ORACLES if llm else {})
