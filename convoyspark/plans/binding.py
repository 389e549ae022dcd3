"""Plan-shaped views of the star-schema test tables.

``plans`` builds the canonical plan table out of ``lineitem`` and its dimensions.
Only the tables that the asked-for columns need are joined, every join is a
left join on the dimension's primary key, and each table is pruned to the
columns in use, so a query over line items alone never touches ``orders``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoyspark.functions import geo
from convoyspark.plans import schema as s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _degrees(units: str) -> str:
    """SQL text of a decimal number from an integer count of 1e-5 degrees."""
    return f"concat(cast(({units}) div 100000 as string), '.', lpad(cast(({units}) % 100000 as string), 5, '0'))"


def _lon_lat(lon: str, lat: str, separator: str = " ") -> str:
    return f"concat({_degrees(lon)}, '{separator}', {_degrees(lat)})"


# Positions in units of 1e-5 degrees.
START_LON, START_LAT = "3980000 + (o_custkey % 200) * 100", "2130000 + (o_custkey % 40) * 100"
END_LON, END_LAT = "3990000 + (l_suppkey % 100) * 100", "2140000 + (l_suppkey % 50) * 200"
GATE_LON, GATE_LAT = "3995000 + (l_partkey % 50) * 40", "2135000 + (l_partkey % 30) * 40"

_MID = _lon_lat("3985000 + (o_custkey % 200) * 50", "2135000 + (l_suppkey % 20) * 50")
_START, _END, _GATE = (_lon_lat(START_LON, START_LAT), _lon_lat(END_LON, END_LAT), _lon_lat(GATE_LON, GATE_LAT))


def _square(lon: str, lat: str, half: int) -> str:
    corners = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
    return ", ', ', ".join(_lon_lat(f"{lon} + {dx}", f"{lat} + {dy}") for dx, dy in corners)


_NAMED_TYPE = ("case when l_returnflag = 'A' then '{0}' when l_returnflag = 'N' then '{1}' "
               "when l_linestatus = 'F' then '{2}' else '{3}' end")

# Canonical column -> (tables it needs besides lineitem, SQL expression).
PLAN_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "plan_id": ((), "cast(l_orderkey * 10 + l_linenumber as string)"),
    s.ROW: ((), "l_orderkey * 10 + l_linenumber"),
    s.SUB: ((), "concat(l_partkey, ':', l_suppkey, ':', cast(round(l_extendedprice * 100) as bigint))"),
    "owner_company_name": (("supplier", "nation"),
                           "case when l_suppkey % 37 = 36 then null when l_linenumber % 3 = 1 then concat(' ', lower(n_name)) "
                           "when l_linenumber % 3 = 2 then concat(n_name, '  ') else n_name end"),
    "owner_office_number": ((), "case when l_suppkey % 29 = 28 then null else cast(l_suppkey as string) end"),
    "camp_label": (("part",),
                   "case when p_size % 17 = 0 then '' when p_size % 13 = 0 then cast(p_size as string) "
                   "else concat(p_size, '/', regexp_extract(p_brand, '[0-9]+', 0)) end"),
    "allocated_haj": ((), "case when l_linenumber = 7 then null else floor(l_extendedprice) end"),
    "number_of_haj": ((), "l_quantity"),
    "number_of_buses": ((), "cast(l_linenumber as double)"),
    "plan_type_code": ((), "case when l_linenumber = 7 and l_quantity > 45 then null else "
                           + _NAMED_TYPE.format("tarwia", "direct_taseed", "efada", "taseed_tarwia") + " end"),
    "plan_type_name": ((), "case when l_linenumber = 6 and l_quantity > 45 then null else "
                           + _NAMED_TYPE.format("تروية", "تصعيد مباشر", "إفاضة", "تصعيد تروية") + " end"),
    "transport_type_name": (("orders",),
                            "case substring(o_orderpriority, 1, 1) when '1' then 'ترددي' when '2' then 'تقليدي رد' "
                            "when '3' then 'تقليدي ردين' when '4' then 'قطار ' else null end"),
    "period": ((), "case when day(l_shipdate) = 31 then null else cast(month(l_shipdate) as string) end"),
    "timing_start_at": ((), "cast(cast(l_shipdate as date) as string)"),
    "timing_end_at": ((), "cast(cast(l_shipdate as date) as string)"),
    "entrance_name": (("part",), "case when p_size % 10 = 0 then null else concat('مدخل ', p_brand) end"),
    "entrance_asm_code": (("part",), "case when p_size % 20 = 0 then null else concat('E', p_size % 5) end"),
    "path_name": (("part",), "case when p_type = 'SMALL' then null else p_type end"),
    "start_point_district": (("orders", "customer"),
                             "case when c_mktsegment = 'MACHINERY' then null "
                             "when l_linenumber % 2 = 0 then concat('حى ', c_mktsegment) else concat('حي ', c_mktsegment) end"),
    "start_point_type": (("orders",), "case when o_orderstatus = 'F' then 'residence' else 'camp' end"),
    "start_point_name": (("orders", "customer"), "c_name"),
    "end_point_type": (("orders",), "case when o_orderstatus = 'P' then 'residence' else 'camp' end"),
    "end_point_name": (("supplier",), "case when l_linenumber = 5 then concat(lower(s_name), ' ') else s_name end"),
    "path_geom": (("orders",),
                  "case when l_linenumber % 4 = 0 then null "
                  f"when l_linenumber % 2 = 1 then concat('LINESTRING (', {_START}, ', ', {_MID}, ', ', {_END}, ')') "
                  f"else concat('LINESTRING (', {_END}, ', ', {_MID}, ', x y, ', {_START}, ')') end"),
    "internal_path": ((), "case when l_linenumber % 3 = 0 then null when l_linenumber % 3 = 1 then "
                          f"concat('{{\"type\":\"LineString\",\"coordinates\":[[', {_lon_lat(GATE_LON, GATE_LAT, ',')}, '],[', "
                          f"{_lon_lat(END_LON, END_LAT, ',')}, ']]}}') else "
                          f"concat('{{\"type\":\"LineString\",\"coordinates\":[[', {_lon_lat(END_LON, END_LAT, ',')}, '],[', "
                          f"{_lon_lat(GATE_LON, GATE_LAT, ',')}, ']]}}') end"),
    "entrance_point_geom": ((), f"case when l_linenumber = 2 then concat('POINT (', {_GATE}, ')') else null end"),
    "entrance_polygon": ((), f"case when l_linenumber = 5 then null else concat('POLYGON ((', {_square(GATE_LON, GATE_LAT, 60)}, '))') end"),
    "start_geom": (("orders",), f"case when l_linenumber = 6 then null else concat('POINT (', {_START}, ')') end"),
    "start_point_geom": (("orders",), f"concat('POINT (', {_START}, ')')"),
    "end_geom": ((), "cast(null as string)"),
    "end_point_geom": ((), f"case when l_linenumber = 4 then '{{bad' else concat('POINT (', {_END}, ')') end"),
    "get_parking_geom": ((), f"case when l_linenumber = 3 then concat('POINT (', {_GATE}, ')') else null end"),
    "set_parking_geom": ((), "case when l_linenumber = 3 and l_partkey % 2 = 0 then "
                             f"concat('POINT (', {_GATE}, ')') when l_linenumber = 3 then concat('POINT (', {_END}, ')') else null end"),
    "get_type_parking": ((), "case when l_partkey % 3 = 0 then null else 'lot' end"),
    "set_type_parking": ((), "case when l_partkey % 3 = 1 then null else 'bay' end"),
    "get_parking_name": ((), "concat('P', l_partkey % 7)"),
    "set_parking_name": ((), "concat('Q', l_partkey % 5)"),
}

# Dimension -> (join key on the left, primary key, columns used, table the left key comes from).
_DIMENSIONS = {
    "orders": ("l_orderkey", "o_orderkey", ("o_orderstatus", "o_orderpriority", "o_custkey"), None),
    "part": ("l_partkey", "p_partkey", ("p_brand", "p_type", "p_size"), None),
    "supplier": ("l_suppkey", "s_suppkey", ("s_name", "s_nationkey"), None),
    "nation": ("s_nationkey", "n_nationkey", ("n_name",), "supplier"),
    "customer": ("o_custkey", "c_custkey", ("c_name", "c_mktsegment"), "orders"),
}


def plans(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Canonical plans with the asked-for columns (and the row identity)."""
    wanted = list(dict.fromkeys([*columns, s.ROW, s.SUB]))
    needed = {dim for name in wanted for dim in PLAN_COLUMNS[name][0]}
    joined = table(spark, sf_dir, "lineitem")
    if set(wanted) & set(s.GEOMETRY_COLUMNS):
        # Texts are far larger than the keys they are built from, and a row group is read by one task.  The join with
        # orders needs this partitioning anyway once orders are too large to broadcast.
        joined = joined.repartition("l_orderkey")
    for dim, (left, _, _, of) in _DIMENSIONS.items():
        if dim in needed and of is None:
            joined = _with_dimension(spark, sf_dir, joined, dim, needed)
    # Each geometry text is an operator of its own: all of them in one make a method too large to be compiled.
    texts = [name for name in wanted if name in s.GEOMETRY_COLUMNS]
    for name in texts:
        joined = geo.with_value(joined, f"{name}_", F.expr(PLAN_COLUMNS[name][1]))
    return joined.selectExpr(*[f"{f'{name}_' if name in texts else PLAN_COLUMNS[name][1]} as {name}" for name in wanted])


def _with_dimension(spark: SparkSession, sf_dir: str, df: DataFrame, dim: str, needed: set[str]) -> DataFrame:
    """``df`` with a dimension's columns and, joined to that first, as it has fewer rows, those of the dimensions it leads to."""
    left, right, used, _ = _DIMENSIONS[dim]
    side = table(spark, sf_dir, dim).select(right, *used)
    for further in needed:
        if _DIMENSIONS[further][3] == dim:
            side = _with_dimension(spark, sf_dir, side, further, needed)
    return df.join(side, df[left] == side[right], "left")


def camps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camp assignments: one row per part, owned by a supplier and its nation."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        part.join(suppliers, F.expr("p_partkey % 100 = s_suppkey"), "left")
        .join(nation, F.expr("s_nationkey = n_nationkey"), "left")
        .selectExpr(
            f"p_partkey as {s.ROW}",
            "case when p_size % 17 = 0 then '' else concat(p_size, '/', regexp_extract(p_brand, '[0-9]+', 0)) end as camp_label",
            "case when n_nationkey = 7 then 'شركة حجاج الداخل' else coalesce(n_name, '') end as service_company_name",
            "case when s_suppkey % 29 = 28 then '' else coalesce(cast(s_suppkey as string), '') end as office_number",
            "case when p_size = 9 then 'حجاج الداخل ' else p_brand end as nationality",
            "coalesce(cast(s_suppkey as string), '') as service_center_name",
            "floor(p_retailprice) * 1.0D as number_of_piligrim",
        )
    )


def residences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residence assignments: one row per customer."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return customer.join(nation, F.expr("c_nationkey = n_nationkey"), "left").selectExpr(
        f"c_custkey as {s.ROW}",
        "case when c_custkey % 11 = 0 then '' else cast(1000 + c_custkey % 700 as string) end as license_number",
        "case when c_custkey % 97 = 0 then '' else concat('Customer#', lpad(cast(c_custkey % 900 as string), 9, '0')) end as residence_name",
        "coalesce(n_name, '') as service_company",
        "concat('center ', c_custkey % 100) as service_center_name",
        "cast(c_custkey % 100 as string) as service_center_number",
        "floor(abs(c_acctbal)) * 1.0D as pilgrims_count",
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras: one per supplier, beside a start point, a route end or a gate."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat(case s_suppkey % 6 when 0 then 'ARF_ENT_MSH_IN_' when 1 then 'MNA_EXT_OUT_TNL_' when 2 then 'MZD_PRK_SEC_' "
        "when 3 then 'MKZ_ENT_EXT_' when 4 then 'PKG_TRN_RD26_' else '4TH_RNG_PRE_' end, "
        "case when s_suppkey % 4 = 0 then 'BRG_BRG_' else '' end, lpad(cast(s_suppkey as string), 9, '0')) as name",
        "(case s_suppkey % 3 when 0 then 3980000 + (s_suppkey % 200) * 100 when 1 then 3990000 + (s_suppkey % 100) * 100 "
        "else 3995000 + (s_suppkey % 50) * 40 end) / 100000.0D as longitude",
        "(case s_suppkey % 3 when 0 then 2130000 + (s_suppkey % 40) * 100 when 1 then 2140000 + (s_suppkey % 50) * 200 "
        "else 2135000 + (s_suppkey % 30) * 40 end + case when s_suppkey % 5 = 4 then 30 else 9 end) / 100000.0D as latitude",
        "cast(s_suppkey % 12 as double) as altitude",
        "case when s_suppkey % 20 = 19 then 'both' else cast(null as string) end as direction",
        "cast(null as string) as type",
        "case when s_suppkey % 25 = 24 then ' Gate ' else cast(null as string) end as location",
    )


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camp gates of both kinds: one per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat(p_size, '/', p_partkey) as gate_id",
        "case when p_partkey % 2 = 0 then 'ARF' else 'MIN' end as source",
        "cast(p_size as bigint) as capacity",
        "(3995000 + (p_partkey % 50) * 40 + case when p_partkey % 7 = 0 then 200 else 5 end) / 100000.0D as longitude",
        "(2135000 + (p_partkey % 30) * 40 + case when p_partkey % 3 = 0 then 75 else 5 end) / 100000.0D as latitude",
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District polygons: one per market segment, named in either spelling."""
    return (
        table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first_key"))
        .selectExpr("concat(' حى ', c_mktsegment) as district_name", "first_key as district_code")
    )


def exit_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit routes of camps: one per part, several per camp label."""
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr(
        f"p_partkey as {s.ROW}",
        "case when p_size % 17 = 0 then '' else concat(' ', p_size, '/', regexp_extract(p_brand, '[0-9]+', 0)) end as camp_label",
        "concat('X', p_partkey % 40) as exit_code",
        "case when p_partkey % 5 = 0 then '' else concat('route ', p_partkey % 60) end as route_name",
        f"concat('LINESTRING (', {_degrees('3991000 + (p_partkey % 50) * 30')}, ' ', {_degrees('2141000')}, ', ', "
        f"{_degrees('3992000')}, ' ', {_degrees('2142000 + (p_partkey % 20) * 30')}, ')') as geom_text",
    )


def exit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit points: one per supplier, several per code."""
    return table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 3").selectExpr(
        f"s_suppkey as {s.ROW}",
        "concat('X', s_suppkey % 35, ' ') as exit_code",
        "case when s_suppkey % 6 = 0 then null else concat('exit ', s_suppkey) end as exit_name",
        f"concat('POINT (', {_degrees('3991000 + (s_suppkey % 50) * 30')}, ' ', {_degrees('2141000')}, ')') as geom_text",
    )


def camp_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal paths of camps by camp label and entrance code."""
    return table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").selectExpr(
        f"p_partkey as {s.ROW}",
        "concat(p_size, '/', regexp_extract(p_brand, '[0-9]+', 0), ' ') as camp_label",
        "concat('E', p_partkey % 5) as entrance_code",
        "concat('path ', p_partkey) as path_code",
        f"concat('LINESTRING (', {_degrees('3993000 + (p_partkey % 50) * 30')}, ' ', {_degrees('2143000')}, ', ', "
        f"{_degrees('3994000')}, ' ', {_degrees('2144000 + (p_partkey % 20) * 30')}, ')') as geom_text",
    )

