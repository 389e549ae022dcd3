"""Geometry parsing, distances, orientation and the grid join against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from convoyspark.functions import geo
from convoyspark.operators import geometry, lookups, orient, proximity

LINE = '{"type":"LineString","coordinates":[[39.90,21.40],[39.91,21.40]]}'


@pytest.mark.parametrize("text, kind, sizes", [
    ("POINT (39.9 21.4)", "Point", [1]),
    ("LINESTRING (39.90 21.40, x y, 39.91 21.40)", "LineString", [2]),
    ("MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 6, 6 6, 5 5)))", "MultiPolygon", [8]),
    (LINE, "LineString", [2]),
    ('{"type":"MultiPolygon","coordinates":[[[[0,0],[0,1],[1,1]]],[[[5,5],[5,6]]]]}', "MultiPolygon", [3, 2]),
    ("LINESTRING (a b)", "LineString", [0]),
    ("MULTILINESTRING ((0 0, 1 1))", None, None),
    ("linestring(0 0,1 1)", None, None),
    ("POINT (1, 2)", None, None),
    ("LINESTRING ()", None, None),
    ("{bad", None, None),
    (None, None, None),
])
def test_parse(spark, text, kind, sizes):
    g = spark.createDataFrame([(text,)], "t string").select(geo.parse_geometry(F.col("t")).alias("g")).head().g
    if kind is None:
        assert g is None
    else:
        assert g.type == kind and [len(p) for p in g.parts] == sizes


@pytest.mark.parametrize("usual, odd", [
    ("POINT (+39.9 21.)", "POINT ( +39.9  21. )"),
    ("POINT(-.5 -0)", "POINT( -.5  -0)"),
    ("LINESTRING (" + ", ".join(f"{i}.5 {i}" for i in range(20_000)) + ")", "LINESTRING ( " + " , ".join(f"{i}.5  {i}" for i in range(20_000)) + ")"),
    ("POLYGON ((0 0,0 1,1 1,0 0))", "POLYGON  (( 0 0,0 1,1 1,0 0))"),
    (LINE, LINE.replace("[39.90,", "[ 39.90,  ")),
    ('{"type":"Point","coordinates":[39.9, -21]}', '{ "type":"Point","coordinates":[39.9,-21,7]}'),
    ('{"type": "Polygon", "coordinates": [[[0,0],[0.25,1],[1,1],[0,0]]]}', '{"coordinates": [[[0,0],[0.25,1],[1,1],[0,0]]], "type": "Polygon"}'),
])
def test_usual_texts_are_matched_for_their_numbers(spark, usual, odd):
    df = spark.createDataFrame([(usual, odd)], "usual string, odd string")
    row = df.select(F.col("usual").rlike(geo._PLAIN).alias("u"), F.col("odd").rlike(geo._PLAIN).alias("o"),
                    geo.parse_geometry(F.col("usual")).alias("a"), geo.parse_geometry(F.col("odd")).alias("b")).head()
    assert row.u and not row.o and row.a.type and row.a == row.b


def test_anchor_texts_share_one_parser(spark):
    found = geometry.with_anchors(plan(spark, start_geom="POINT (1 2)", end_point_geom="POINT (3 4)", entrance_polygon="POLYGON ((0 0, 0 2, 2 2, 2 0))"))
    row = found.select("start_anchor", "end_anchor", "entrance_anchor", "destination_anchor").head()
    assert [tuple(x) for x in row] == [(1, 2), (3, 4), (1, 1), (1, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 3


def plan(spark, **cells):
    base = dict(plan_id="p", plan_type_code="direct_taseed", plan_type_name=None, start_point_type="residence", end_point_type="camp")
    base |= cells
    fields = ", ".join(f"{k} string" for k in base)
    return spark.createDataFrame([tuple(base.values())], fields).withColumn("_row", F.lit(1).cast("bigint"))


def test_twenty_metres(spark):
    cameras = spark.createDataFrame([("near", 39.905, 21.40009), ("far", 39.905, 21.40027), ("in", 39.9005, 21.5005), ("out", 39.902, 21.5005)],
                                    "name string, longitude double, latitude double")
    df = plan(spark, internal_path=LINE, entrance_polygon="POLYGON ((39.90 21.50, 39.901 21.50, 39.901 21.501, 39.90 21.501))")
    assert {r.camera for r in proximity.camera_plan_pairs(df, cameras).collect()} == {"near", "in"}


def test_no_geometry_keeps_every_point(spark):
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0)], "name string, longitude double, latitude double")
    assert proximity.points_near_plans(plan(spark, internal_path="{bad"), points, "name", all_without_geometry=True).count() == 2


def _brute(line, lon, lat):
    best = math.inf
    m = geo.MEAN_RADIUS_M * math.pi / 180
    for (x1, y1), (x2, y2) in zip(line, line[1:]):
        ax, ay = (x1 - lon) * math.cos(math.radians(lat)) * m, (y1 - lat) * m
        dx, dy = (x2 - lon) * math.cos(math.radians(lat)) * m - ax, (y2 - lat) * m - ay
        length = dx * dx + dy * dy
        along = 0 if length == 0 else min(max(-(ax * dx + ay * dy) / length, 0), 1)
        best = min(best, math.hypot(ax + along * dx, ay + along * dy))
    return best


def test_grid_join_equals_brute_force(spark):
    lines = [[(39.8 + 0.013 * i % 0.2, 21.3 + 0.007 * j % 0.1), (39.8 + 0.031 * j % 0.3, 21.35 + 0.011 * i % 0.1), (39.81, 21.36)]
             for i in range(6) for j in range(6)] + [[(-10.0, -5.0), (60.0, 40.0)]]
    points = [(f"c{k}", 39.8 + (k * 0.00137) % 0.08, 21.3 + (k * 0.00091) % 0.09) for k in range(900)]
    geometries = spark.createDataFrame(
        [(str(i), "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in line) + ")") for i, line in enumerate(lines)],
        "geometry_id string, t string").select("geometry_id", geo.parse_geometry(F.col("t")).alias("geom"))
    cameras = spark.createDataFrame(points, "name string, longitude double, latitude double")
    for radius in (20.0, 150.0):
        got = {(r.geometry_id, r.name) for r in proximity.points_near(geometries, cameras, "name", radius).collect()}
        want = {(str(i), n) for i, line in enumerate(lines) for n, lon, lat in points if _brute(line, lon, lat) <= radius}
        assert got == want and want


def test_external_line_is_turned_towards_the_destination(spark):
    df = plan(spark, path_geom="LINESTRING (39.90 21.40, 39.91 21.40)", start_geom="POINT (39.91 21.40)", entrance_point_geom="POINT (39.90 21.40)")
    r = orient.route_orientation(df).head()
    assert r.reversed and (r["head"].lon, r["tail"].lon) == (39.91, 39.90)


def test_connected_lines_and_gap(spark):
    df = plan(spark, path_geom="LINESTRING (39.90 21.40, 39.89 21.40)", internal_path='{"type":"LineString","coordinates":[[39.92,21.40],[39.901,21.40]]}',
              start_geom="POINT (39.89 21.40)", end_geom="POINT (39.92 21.40)")
    got = [(r.role, r["head"].lon, r["tail"].lon) for r in orient.connected_routes(df).orderBy("position").collect()]
    assert got[0] == ("external", 39.89, 39.90) and got[1][0] == "internal"
    gaps = orient.route_gaps(df).collect()
    assert len(gaps) == 1 and 100 < gaps[0].metres < 110


def _metres(a, b):
    (x1, y1), (x2, y2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * geo.MAP_RADIUS_M * math.asin(math.sqrt(h))


def _all_ways(lines, start, end):
    """The first of all orders and direction masks with the least length; only two lines may change places."""
    tried = []
    for order, listed in enumerate([lines, lines[::-1]] if len(lines) == 2 else [lines]):
        for mask in range(1 << len(lines)):
            way = [line[::-1] if mask >> i & 1 else line for i, line in enumerate(listed)]
            legs = [(start, way[0][0]), *((a[-1], b[0]) for a, b in zip(way, way[1:])), (way[-1][-1], end)]
            tried.append((sum(round(_metres(*leg) * 1e6) for leg in legs), order, mask, way))
    return min(tried)[3]


def test_sequences_equal_enumeration(spark):
    """Two to five lines a plan; points on a coarse grid, so that ways tie and ends meet."""
    rng = random.Random(4)
    spot = lambda: (39.9 + rng.randrange(4) / 100, 21.4 + rng.randrange(4) / 100)
    text = lambda line: "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in line) + ")"
    columns = ("internal_path", "path_geom", "entrance_polygon", "get_parking_geom", "set_parking_geom")
    plans, want = [], {}
    for k in range(150):
        lines = [[spot() for _ in range(rng.randint(2, 4))] for _ in range(rng.randint(2, 5))]
        start, gate = spot(), spot()
        texts = [text(x) for x in lines] + [None] * (5 - len(lines))
        plans.append((k, str(k), "efada", "residence", "camp", f"POINT ({start[0]} {start[1]})", f"POINT ({gate[0]} {gate[1]})", *texts))
        if texts[3] == texts[4] and texts[3]:
            continue
        want[k] = _all_ways(lines, start, gate)
    schema = "_row bigint, plan_id string, plan_type_code string, start_point_type string, end_point_type string, start_geom string, entrance_point_geom string, "
    df = spark.createDataFrame(plans, schema + ", ".join(f"{c} string" for c in columns))
    got = {}
    for r in orient._with_sequence(orient._with_lines(df)).select("_row", F.transform("sequence_", lambda x: x["points"]).alias("lines")).collect():
        got[r._row] = [[(p.lon, p.lat) for p in line] for line in r.lines]
    assert {k: got[k] for k in want} == want and max(len(w) for w in want.values()) == 5


def test_gap_limits(spark):
    """Lines that meet, stop 9 m short, leave 111 m, and are 5.6 km apart: only the third gap is bridged."""
    for apart, bridged in ((0.0, 0), (0.00008, 0), (0.001, 1), (0.05, 0)):
        df = plan(spark, path_geom=f"LINESTRING (39.89 21.40, 39.90 {21.40 + apart})", internal_path="LINESTRING (39.90 21.40, 39.91 21.40)",
                  start_geom="POINT (39.89 21.40)", end_geom="POINT (39.91 21.40)")
        assert orient.route_gaps(df).count() == bridged
        assert orient.route_gaps(df.withColumn("plan_type_code", F.lit("tarwia"))).count() == 0


def test_camera_zone_and_details(spark):
    cameras = spark.createDataFrame([("MZD_ENT_BRG_01", 39.99, 21.35, 0.0, None), ("PKG_OUT_02", 39.98, 21.35, 0.0, " x ")],
                                    "name string, longitude double, latitude double, altitude double, location string")
    assert [r.zone for r in lookups.with_zone(cameras).orderBy("name").collect()] == ["MZD", "ARF"]
    got = {r.name: (r.location, r.direction, r.type) for r in lookups.camera_details(cameras).collect()}
    assert got["MZD_ENT_BRG_01"] == ("مزدلفة - جسر", "دخول", "كاميرا مراقبة") and got["PKG_OUT_02"] == ("x", "خروج", "مواقف")


def test_color_ramp(spark):
    df = spark.createDataFrame([(0.0,), (0.125,), (1.0,)], "x double").select(geo.density_color(F.col("x")).alias("c"))
    assert [r.c for r in df.collect()] == ["rgb(255,255,204)", "rgb(255,236,161)", "rgb(128,0,38)"]


def test_cameras_of_one_place_are_compared_once(spark):
    """Cameras at the same places share a stand-in; one listed twice or at two places passes a plan once."""
    rows = [("a", 39.905, 21.40009), ("b", 39.905, 21.40009), ("b", 39.905, 21.40009), ("c", 39.905, 21.40009), ("c", 39.906, 21.40009),
            ("far", 39.905, 21.41), (None, 39.905, 21.40009), ("nowhere", None, 21.4)]
    cameras = spark.createDataFrame(rows, "name string, longitude double, latitude double")
    places, members = proximity._stand_ins(cameras)
    assert sorted(tuple(r) for r in places.collect()) == [
        ("a", 39.905, 21.40009), ("c", 39.905, 21.40009), ("c", 39.906, 21.40009), ("far", 39.905, 21.41)]
    assert sorted(tuple(r) for r in members.collect()) == [("a", "a"), ("a", "b"), ("c", "c"), ("far", "far")]
    df = plan(spark, internal_path=LINE, plan_type_name="x", owner_company_name="co", owner_office_number="1", transport_type_name="x").withColumn(
        "number_of_buses", F.lit(2.0))
    assert sorted(r.camera for r in proximity.camera_plan_pairs(df, cameras).collect()) == ["a", "b", "c"]
    assert sorted(r.camera for r in proximity.camera_directions(df, cameras).collect()) == ["a", "b", "c"]
    stats = sorted((r.level, r.camera, r.buses) for r in proximity.camera_stats(df, cameras).collect())
    assert stats == [(level, c, 2.0) for level in ("camera", "group") for c in "abc"]


def test_segments_and_places_are_compared_once(spark):
    """Ten plans on one line, ten gates at one place: one segment a cell meets one place."""
    lines = plan(spark, internal_path=LINE).withColumn("end_geom", F.explode(F.array(*[F.lit(f"POINT (10.{i} 10)") for i in range(10)])))
    gates = spark.range(10).selectExpr("concat('g', id) as gate", "39.905D as longitude", "21.40009D as latitude")
    corridors = proximity._corridors(proximity.distinct_geometries(lines).select("geom"), 20.0).where("x1 <> x2")
    assert corridors.count() == corridors.distinct().count() > 0
    assert proximity.points_near_plans(lines, gates, "gate", all_without_geometry=False).count() == 10


def _varied_plans(spark, n=40):
    """Plans with every kind of text, some of them broken or alike; three rows come twice."""
    rng = random.Random(9)
    spot = lambda: f"{39.9 + rng.randrange(5) / 100} {21.4 + rng.randrange(5) / 100}"
    line = lambda: rng.choice([None, "", "{bad", f"LINESTRING ({spot()}, {spot()})", f" LINESTRING ({spot()}, x y, {spot()}, {spot()})"])
    point = lambda: rng.choice([None, f"POINT ({spot()})", f'{{"type":"Point","coordinates":[{spot().replace(" ", ",")}]}}'])
    rows = [(k, str(k), rng.choice(["tarwia", "efada"]), rng.choice([None, "residence"]), rng.choice(["camp", "residence"]), line(), line(), point(), point(), point(), point())
            for k in range(n)]
    schema = ("_row bigint, plan_id string, plan_type_code string, start_point_type string, end_point_type string, internal_path string, path_geom string, "
              "start_geom string, end_geom string, entrance_point_geom string, get_parking_geom string")
    return spark.createDataFrame(rows + rows[:3] + [(0, "0", "tarwia", None, "camp", "LINESTRING (1 2, 3 4)", None, None, None, None, None)], schema)


def _exchanges_of_rows(df):
    """Shuffles in a plan that are dealt by the key of a row."""
    return [x for x in df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1].splitlines() if "Exchange hashpartitioning(_row" in x]


def _same_rows(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("of", [orient.route_orientation, orient.connected_routes, geometry.explode_geometries])
def test_texts_are_looked_up_in_place(spark, monkeypatch, of):
    """Plans that occur once are not shuffled, and the rows are those of plans whose items are joined."""
    df = _varied_plans(spark)
    here = of(df)
    assert not _exchanges_of_rows(of(df.where("_row > 2")))
    monkeypatch.setattr(geometry, "is_small", lambda *_: False)
    assert _same_rows(here, of(df)) and here.count() > 30


def test_bounds_parse_each_text_once(spark):
    df = _varied_plans(spark)
    each = geometry.explode_geometries(df).select("geom", F.explode(F.flatten("geom.parts")).alias("p"))
    want = each.agg(F.min("p.lon"), F.min("p.lat"), F.max("p.lon"), F.max("p.lat")).head()
    got = geometry.geometry_bounds(df)
    assert tuple(got.head()) == (*want, geometry.explode_geometries(df).count())
    assert "Aggregate [text#" in got._jdf.queryExecution().optimizedPlan().toString()


def test_lookups_do_not_shuffle_plans(spark):
    """The size of a lookup is known before plans meet it."""
    plans = _varied_plans(spark).withColumns({"camp_label": F.lit("1/2"), "entrance_asm_code": F.lit("E1"), "plan_type_name": F.lit(None).cast("string")})
    paths = spark.createDataFrame([(1, "1/2", "E1", "p", LINE)], "_row bigint, camp_label string, entrance_code string, path_code string, geom_text string")
    physical = lookups.with_camp_path(plans, paths)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "Exchange hashpartitioning" not in physical


def test_cameras_are_looked_up_in_place(spark, monkeypatch):
    """Plans that occur once are not shuffled to their cameras, and the rows are those of plans whose texts are joined."""
    df = _varied_plans(spark, 15).withColumns({"plan_type_name": F.lit("x"), "transport_type_name": F.lit("t"), "owner_company_name": F.col("plan_id"),
                                               "owner_office_number": F.lit("1"), "number_of_buses": F.lit(2.0)})
    cameras = spark.createDataFrame([(f"c{k}", 39.9 + k % 5 / 100, 21.4 + k // 5 / 100) for k in range(20)], "name string, longitude double, latitude double")
    of = (proximity.camera_plan_pairs, proximity.camera_directions, proximity.camera_stats)
    here = [f(df, cameras) for f in of]
    assert not _exchanges_of_rows(proximity.camera_plan_pairs(df.where("_row > 2"), cameras))
    for module in (geometry, proximity):
        monkeypatch.setattr(module, "is_small", lambda *_: False)
    assert all(_same_rows(a, f(df, cameras)) and a.count() for a, f in zip(here, of))
