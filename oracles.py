"""DuckDB SQL for the registered queries, written on its own terms.

Only the plan-shaped views are shared with the Spark side: the same expressions
over the same tables, so that both engines start from equal rows.  Everything
after that (windows, distinct counts, brute-force joins) is plain SQL.
"""

from __future__ import annotations

import re

from convoyspark.plans import binding, schema as s


def _duck(expr: str) -> str:
    expr = re.sub(r"(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", expr)
    return expr.replace(" div ", " // ")


_FROM = """lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN customer ON o_custkey = c_custkey"""


# -- expressions -------------------------------------------------------------

def blank(x: str) -> str:
    return f"coalesce(trim({x}), '')"


def filled(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ")"


def fold(x: str) -> str:
    return f"translate(regexp_replace(trim(coalesce({x}, '')), 'ه(\\s|$)', 'ة\\1', 'g'), 'ىأإ', 'ياا')"


def key(x: str) -> str:
    return f"lower(trim(regexp_replace({fold(x)}, '\\s+', ' ', 'g')))"


def number_value(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' OR regexp_full_match(trim({x}), '0+') THEN '' ELSE trim({x}) END"


def truthy(x: str) -> str:
    return f"coalesce({x} <> '' AND NOT regexp_full_match(trim({x}), '0+'), false)"


def plan_class(x: str) -> str:
    k = key(x)
    return (f"CASE WHEN contains({k}, 'direct_taseed') OR contains({k}, 'تصعيد مباشر') THEN 'direct_taseed' "
            f"WHEN contains({k}, 'taseed_tarwia') OR contains({k}, 'تصعيد تروية') THEN 'taseed_tarwia' "
            f"WHEN contains({k}, 'tarwia') OR contains({k}, 'tarwiya') OR contains({k}, 'تروية') THEN 'tarwia' "
            f"WHEN contains({k}, 'efada') OR contains({k}, 'افاضة') THEN 'efada' "
            f"WHEN contains({k}, 'nafra') OR contains({k}, 'نفرة') THEN 'nafra' ELSE {k} END")


def rank_of(code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(s.PLAN_TYPE_ORDER)) + f" ELSE {len(s.PLAN_TYPE_ORDER)} END"


def share(v: str, total: str) -> str:
    return f"CAST(CASE WHEN coalesce({total}, 0) = 0 THEN 0 ELSE floor({v} / {total} * 100 + 0.5) END AS BIGINT)"


def completion(planned: str, total: str) -> str:
    return f"CASE WHEN coalesce({total}, 0) = 0 THEN 0.0 ELSE {planned} / {total} * 100 END"


# -- base views --------------------------------------------------------------

_PLANS = "plans AS (SELECT " + ", ".join(
    f"{_duck(e)} AS {n}" for n, (_, e) in binding.PLAN_COLUMNS.items()
) + f", l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM {_FROM})"

_P = f"""p AS (SELECT *, {key('owner_company_name')} AS company_key, {number_value('owner_office_number')} AS center_number,
 {key('owner_company_name')} || '|' || {number_value('owner_office_number')} AS center_key,
 '*|' || {number_value('owner_office_number')} AS center_number_key,
 {key('owner_company_name')} || '|' || {number_value('owner_office_number')} || '|' || {blank('camp_label')} AS assignment_key,
 CAST(coalesce(allocated_haj, number_of_haj, 0) AS DOUBLE) AS allocated,
 coalesce(number_of_haj, 0.0) AS pilgrims, coalesce(number_of_buses, 0.0) AS buses,
 coalesce(number_of_buses, 0.0) * CASE {blank('transport_type_name')} WHEN 'ترددي' THEN 3 WHEN 'قطار' THEN 3 WHEN 'تقليدي ردين' THEN 2 ELSE 1 END AS trips,
 {blank("CASE WHEN start_point_type = 'residence' AND start_point_name <> '' THEN start_point_name WHEN end_point_type = 'residence' THEN end_point_name END")} AS residence_name,
 {key("CASE WHEN start_point_type = 'residence' AND start_point_name <> '' THEN start_point_name WHEN end_point_type = 'residence' THEN end_point_name END")} AS residence_key,
 coalesce(nullif(trim(owner_company_name), ''), '{s.UNKNOWN}') AS company_name,
 coalesce({filled('plan_type_code', 'plan_type_name')}, '') AS code_or_name,
 coalesce(nullif(plan_type_code, ''), 'unknown') AS type_code,
 coalesce({filled('plan_type_name', 'plan_type_code')}, 'unknown') AS type_label,
 (coalesce(plan_type_code, '') IN ('tarwia', 'direct_taseed') OR coalesce(plan_type_name, '') IN ('تروية', 'تصعيد مباشر')) AS headline,
 coalesce(nullif(period, ''), '{s.UNKNOWN}') AS period_l,
 coalesce(nullif(path_name, ''), '{s.NO_PATH}') AS path_l,
 coalesce(nullif(start_point_district, ''), '{s.NO_DISTRICT}') AS district_l,
 coalesce({filled('entrance_name', 'entrance_asm_code')}, '{s.NO_ENTRANCE}') AS entrance_l
 FROM plans)"""

PLANS = f"WITH {_PLANS}, {_P} "


def plans_where(condition: str) -> str:
    """The same views over the plans that meet a condition on canonical columns."""
    return f"WITH {_PLANS}, {_P[:-1]} WHERE {condition}) "


_CAMPS = f"""camps AS (SELECT p_partkey AS _row,
 CASE WHEN p_size % 17 = 0 THEN '' ELSE concat(p_size, '/', regexp_extract(p_brand, '[0-9]+', 0)) END AS camp_label,
 CASE WHEN n_nationkey = 7 THEN 'شركة حجاج الداخل' ELSE coalesce(n_name, '') END AS service_company_name,
 CASE WHEN s_suppkey % 29 = 28 THEN '' ELSE coalesce(CAST(s_suppkey AS VARCHAR), '') END AS office_number,
 CASE WHEN p_size = 9 THEN 'حجاج الداخل ' ELSE p_brand END AS nationality,
 coalesce(CAST(s_suppkey AS VARCHAR), '') AS service_center_name,
 CAST(floor(p_retailprice) AS DOUBLE) AS number_of_piligrim
 FROM part LEFT JOIN supplier ON p_partkey % 100 = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey),
 c AS (SELECT *, {key('service_company_name')} AS company_key, {key('service_company_name')} || '|' || {number_value('office_number')} AS center_key,
 contains({key('service_company_name')}, 'حجاج الداخل') OR {key('nationality')} = 'حجاج الداخل' AS domestic FROM camps)"""

_RESIDENCES = f"""residences AS (SELECT c_custkey AS _row,
 CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(1000 + c_custkey % 700 AS VARCHAR) END AS license_number,
 CASE WHEN c_custkey % 97 = 0 THEN '' ELSE concat('Customer#', lpad(CAST(c_custkey % 900 AS VARCHAR), 9, '0')) END AS residence_name,
 coalesce(n_name, '') AS service_company, CAST(c_custkey % 100 AS VARCHAR) AS service_center_number
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
 r AS (SELECT *, {key('service_company')} AS company_key, {key('service_company')} || '|' || {number_value('service_center_number')} AS center_key,
 nullif(CASE WHEN license_number <> '' THEN license_number || '|' || residence_name ELSE residence_name END, '') AS file_key FROM residences)"""

_FACTS = f"""facts AS (SELECT company_key, center_key, residence_key,
 first(residence_name ORDER BY _row, residence_name) AS residence_name, sum(pilgrims) AS pilgrims,
 sum(CASE WHEN contains(kind, 'tarwia') OR contains(kind, 'تروية') THEN pilgrims ELSE 0 END) AS tarwia,
 sum(CASE WHEN contains(kind, 'taseed') OR contains(kind, 'تصعيد') THEN pilgrims ELSE 0 END) AS taseed
 FROM (SELECT *, {key("coalesce(plan_type_code, '') || ' ' || coalesce(plan_type_name, '')")} AS kind FROM p
       WHERE {truthy('owner_office_number')} AND residence_key <> '') GROUP BY 1, 2, 3)"""

_MIX = """mix AS (SELECT residence_key, CASE WHEN sum(tarwia) > 0 AND sum(taseed) > 0 THEN 'mixed'
 WHEN sum(tarwia) > 0 THEN 'tarwiyah' WHEN sum(taseed) > 0 THEN 'direct' END AS mix FROM facts GROUP BY 1)"""

_TOTALS = """best AS (SELECT center_key, center_number_key, nullif(code_or_name, '') AS plan_type, assignment_key, max(allocated) AS a FROM p
 WHERE center_number <> '' GROUP BY 1, 2, 3, 4),
 totals AS (
 SELECT 'center' AS level, center_key AS key, NULL AS plan_type, sum(greatest(a, 0)) AS total FROM (SELECT center_key, assignment_key, max(a) AS a FROM best GROUP BY 1, 2) GROUP BY 2
 UNION ALL SELECT 'center', center_key, plan_type, sum(greatest(a, 0)) FROM (SELECT center_key, plan_type, assignment_key, max(a) AS a FROM best WHERE plan_type IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 2, 3
 UNION ALL SELECT 'number', center_number_key, NULL, sum(greatest(a, 0)) FROM (SELECT center_number_key, assignment_key, max(a) AS a FROM best GROUP BY 1, 2) GROUP BY 2
 UNION ALL SELECT 'number', center_number_key, plan_type, sum(greatest(a, 0)) FROM (SELECT center_number_key, plan_type, assignment_key, max(a) AS a FROM best WHERE plan_type IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 2, 3)"""


def target_of(row: str) -> str:
    pick = lambda level, k, t: (f"(SELECT total FROM totals t WHERE t.level = '{level}' AND t.key = {row}.{k} "  # noqa: E731
                                f"AND t.plan_type IS NOT DISTINCT FROM {t})")
    c, ct = pick("center", "center_key", "NULL"), pick("center", "center_key", f"{row}.type_code")
    n, nt = pick("number", "center_number_key", "NULL"), pick("number", "center_number_key", f"{row}.type_code")
    return f"coalesce(CASE WHEN {c} IS NOT NULL THEN coalesce(nullif({ct}, 0), {c}) ELSE coalesce(nullif({nt}, 0), {n}) END, 0.0)"


# -- geometry views ----------------------------------------------------------
# Built from the table keys, not from the geometry texts, so parsing is tested too.

def _deg(units: str) -> str:
    return f"(({units}) / 100000.0::DOUBLE)"


_SLON, _SLAT = _deg(binding.START_LON), _deg(binding.START_LAT)
_ELON, _ELAT = _deg(binding.END_LON), _deg(binding.END_LAT)
_GLON, _GLAT = _deg(binding.GATE_LON), _deg(binding.GATE_LAT)
_MLON, _MLAT = _deg("3985000 + (o_custkey % 200) * 50"), _deg("2135000 + (l_suppkey % 20) * 50")


def _corner(dx: int, dy: int) -> str:
    return f"{{'lon': {_deg(f'{binding.GATE_LON} + {dx}')}, 'lat': {_deg(f'{binding.GATE_LAT} + {dy}')}}}"


_RING = "[" + ", ".join(_corner(*c) for c in ((-60, -60), (60, -60), (60, 60), (-60, 60), (-60, -60))) + "]"


def _pt(lon: str, lat: str) -> str:
    return f"{{'lon': {lon}, 'lat': {lat}}}"


_S, _E, _G, _M = _pt(_SLON, _SLAT), _pt(_ELON, _ELAT), _pt(_GLON, _GLAT), _pt(_MLON, _MLAT)

_SHAPES = f"""shapes AS (
 SELECT _row, _sub, plan_id, l_linenumber, 0 AS ord, 'internal' AS role, 'LineString' AS kind,
   CASE WHEN l_linenumber % 3 = 1 THEN [{_G}, {_E}] ELSE [{_E}, {_G}] END AS pts, {blank(filled('path_name', 'camp_label'))} AS label FROM p WHERE l_linenumber % 3 <> 0
 UNION ALL SELECT _row, _sub, plan_id, l_linenumber, 3, 'external', 'LineString',
   CASE WHEN l_linenumber % 2 = 1 THEN [{_S}, {_M}, {_E}] ELSE [{_E}, {_M}, {_S}] END, '' FROM p WHERE l_linenumber % 4 <> 0
 UNION ALL SELECT _row, _sub, plan_id, l_linenumber, 4, 'entrance', 'Polygon', {_RING}, {blank(filled('entrance_name', 'entrance_asm_code'))} FROM p WHERE l_linenumber <> 5
 UNION ALL SELECT _row, _sub, plan_id, l_linenumber, 5, 'start', 'Point', [{_S}], {blank('start_point_name')} FROM p
 UNION ALL SELECT _row, _sub, plan_id, l_linenumber, 6, 'end', 'Point', [{_E}], {blank('end_point_name')} FROM p WHERE l_linenumber <> 4
 UNION ALL SELECT _row, _sub, plan_id, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 7 ELSE 8 END, CASE WHEN l_partkey % 2 = 0 THEN 'parking_combined' ELSE 'get_parking' END, 'Point', [{_G}],
   CASE WHEN l_partkey % 2 = 0 THEN 'استلام و تسليم: ' ELSE 'استلام: ' END || CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'lot/' END || 'P' || (l_partkey % 7) FROM p WHERE l_linenumber = 3
 UNION ALL SELECT _row, _sub, plan_id, l_linenumber, 9, 'set_parking', 'Point', [{_E}], 'تسليم: ' || CASE WHEN l_partkey % 3 = 1 THEN '' ELSE 'bay/' END || 'Q' || (l_partkey % 5)
   FROM p WHERE l_linenumber = 3 AND l_partkey % 2 = 1)"""

# The external line ends beside the internal one: on it, less than 12 m, some 100 m, or over 5 km away.
SHIFTS = (0.0, 0.00008, 0.001, 0.05)
_SHIFT = "CASE _row % 4 " + " ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(SHIFTS)) + " END"
_SHIFTED = _pt(_ELON, f"round({_ELAT} + {_SHIFT}, 5)")
SHIFTED_SHAPES = _SHAPES.replace(f"CASE WHEN l_linenumber % 2 = 1 THEN [{_S}, {_M}, {_E}] ELSE [{_E}, {_M}, {_S}] END", f"[{_S}, {_SHIFTED}]")

_CAMERAS = f"""cameras AS (SELECT concat(CASE s_suppkey % 6 WHEN 0 THEN 'ARF_ENT_MSH_IN_' WHEN 1 THEN 'MNA_EXT_OUT_TNL_' WHEN 2 THEN 'MZD_PRK_SEC_'
 WHEN 3 THEN 'MKZ_ENT_EXT_' WHEN 4 THEN 'PKG_TRN_RD26_' ELSE '4TH_RNG_PRE_' END,
 CASE WHEN s_suppkey % 4 = 0 THEN 'BRG_BRG_' ELSE '' END, lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS name, s_suppkey,
 (CASE s_suppkey % 3 WHEN 0 THEN 3980000 + (s_suppkey % 200) * 100 WHEN 1 THEN 3990000 + (s_suppkey % 100) * 100 ELSE 3995000 + (s_suppkey % 50) * 40 END) / 100000.0::DOUBLE AS longitude,
 (CASE s_suppkey % 3 WHEN 0 THEN 2130000 + (s_suppkey % 40) * 100 WHEN 1 THEN 2140000 + (s_suppkey % 50) * 200 ELSE 2135000 + (s_suppkey % 30) * 40 END
  + CASE WHEN s_suppkey % 5 = 4 THEN 30 ELSE 9 END) / 100000.0::DOUBLE AS latitude,
 CAST(s_suppkey % 12 AS DOUBLE) AS altitude FROM supplier)"""

_GATES = """gates AS (SELECT concat(p_size, '/', p_partkey) AS gate_id, CASE WHEN p_partkey % 2 = 0 THEN 'ARF' ELSE 'MIN' END AS source,
 CAST(p_size AS BIGINT) AS capacity,
 (3995000 + (p_partkey % 50) * 40 + CASE WHEN p_partkey % 7 = 0 THEN 200 ELSE 5 END) / 100000.0::DOUBLE AS longitude,
 (2135000 + (p_partkey % 30) * 40 + CASE WHEN p_partkey % 3 = 0 THEN 75 ELSE 5 END) / 100000.0::DOUBLE AS latitude FROM part)"""

_M_PER_DEG = "(6371008.8::DOUBLE * 3.141592653589793::DOUBLE / 180)"


def _near(points: str, pid: str) -> str:
    """Every distinct edge against every point in its bounding box; squares by their corners."""
    margin = 0.0004
    return f"""shape_edges AS (SELECT _row, _sub, plan_id, pts[i].lon AS x1, pts[i].lat AS y1,
   pts[CASE WHEN i < len(pts) THEN i + 1 ELSE i END].lon AS x2, pts[CASE WHEN i < len(pts) THEN i + 1 ELSE i END].lat AS y2
   FROM (SELECT *, unnest(range(1, greatest(len(pts), 2))) AS i FROM shapes)),
 edges AS (SELECT DISTINCT x1, y1, x2, y2 FROM shape_edges),
 planar AS (SELECT {pid} AS pid, x1, y1, x2, y2,
   (x1 - longitude) * cos(radians(latitude)) * {_M_PER_DEG} AS ax, (y1 - latitude) * {_M_PER_DEG} AS ay,
   (x2 - longitude) * cos(radians(latitude)) * {_M_PER_DEG} AS bx, (y2 - latitude) * {_M_PER_DEG} AS by_
   FROM edges JOIN {points} ON longitude BETWEEN least(x1, x2) - {margin} AND greatest(x1, x2) + {margin}
   AND latitude BETWEEN least(y1, y2) - {margin} AND greatest(y1, y2) + {margin}),
 placed AS (SELECT *, CASE WHEN ax = bx AND ay = by_ THEN 0.0 ELSE
   least(greatest(-(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0.0), 1.0) END AS t FROM planar),
 close AS (SELECT DISTINCT pid, x1, y1, x2, y2 FROM placed
   WHERE sqrt((ax + t * (bx - ax)) * (ax + t * (bx - ax)) + (ay + t * (by_ - ay)) * (ay + t * (by_ - ay))) <= 20),
 squares AS (SELECT DISTINCT pts[1].lon AS west, pts[1].lat AS south, pts[3].lon AS east, pts[3].lat AS north FROM shapes WHERE kind = 'Polygon'),
 inside AS (SELECT {pid} AS pid, west, south FROM squares JOIN {points} ON longitude > west AND longitude < east AND latitude > south AND latitude < north),
 near AS (SELECT pid FROM close UNION SELECT pid FROM inside)"""


def metres(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (f"degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) "
            f"- sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))))")
