"""Geometry as native Spark columns.

A geometry is ``struct<type string, parts array<array<struct<lon,lat>>>>``;
points, lines and polygons all fit.  Everything here is an expression over one
row, so it runs in the JVM and needs no UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from convoyspark.functions import text as t

# Sphere radii in metres.  Map distances use the rounded radius,
# buffers and bearings the mean earth radius.
MAP_RADIUS_M = 6371000.0
MEAN_RADIUS_M = 6371008.8

POINT_TYPE = "struct<lon:double,lat:double>"
GEOMETRY_TYPE = f"struct<type:string,parts:array<array<{POINT_TYPE}>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    An array function binds it to a lambda variable; written out in place, a
    parsed geometry would be parsed again at every mention.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def with_value(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    A filter on a plain column is pushed below the projection together with a
    copy of the expression; it does not move below a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
# A WKT vertex: the first two numbers between two commas.  A JSON one: an array of numbers.
_WKT_VERTEX = rf"(^|,)\s*({_NUMBER})\s+({_NUMBER})(?:\s[^,]*)?(?=,|$)"
_JSON_VERTEX = rf"\[\s*({_NUMBER})\s*,\s*({_NUMBER})\s*(?:,[^\[\]]*)?\]"
_TEXT_PARTS = "array<array<struct<lon:string,lat:string>>>"

# Usual texts: one ring or line of bare pairs.  Possessive, so that long ones neither backtrack nor recurse.
_PLAIN_WKT_NUMBER = r"[+-]?+(?:\d++(?:\.\d*+)?+|\.\d++)"
_PLAIN_WKT_PAIR = rf"{_PLAIN_WKT_NUMBER} {_PLAIN_WKT_NUMBER}"
_PLAIN_JSON_NUMBER = r"(?:-?+(?:0|[1-9]\d{0,17}+)\.\d{1,40}+|-?+[1-9]\d{0,17}+|0)"
_PLAIN_JSON_PAIR = rf"\[{_PLAIN_JSON_NUMBER}, ?+{_PLAIN_JSON_NUMBER}\]"
_PLAIN_JSON_LINE = rf"\[{_PLAIN_JSON_PAIR}(?:, ?+{_PLAIN_JSON_PAIR})*+\]"
_PLAIN = (
    rf"^(?:POINT ?+\({_PLAIN_WKT_PAIR}\)|(?:LINESTRING|POLYGON) ?+\({{1,2}}+{_PLAIN_WKT_PAIR}(?:, ?+{_PLAIN_WKT_PAIR})*+\){{1,2}}+"
    rf'|\{{"type": ?+"(?:Point", ?+"coordinates": ?+{_PLAIN_JSON_PAIR}|LineString", ?+"coordinates": ?+{_PLAIN_JSON_LINE}'
    rf'|Polygon", ?+"coordinates": ?+\[{_PLAIN_JSON_LINE}\])\}})\z')


def _typed_parts(kind: Column, parts: Column) -> Column:
    return F.struct(kind.alias("type"), parts.alias("parts"))


def _wkt(c: Column) -> Column:
    """Type and parts text of a WKT; rings and parts run together, bad vertices are dropped."""
    # Recognised tags, in upper case only.  Each is as long as its type's name.
    kind = (F.when(c.startswith("LINESTRING"), "LineString").when(c.startswith("POLYGON"), "Polygon")
            .when(c.startswith("MULTIPOLYGON"), "MultiPolygon").when(c.startswith("POINT"), "Point"))

    def of_body(body: Column) -> Column:
        marked = F.regexp_replace(body, _WKT_VERTEX, '$1{"lon":"$2","lat":"$3"}')
        between_vertices = r"(^|\})[^{}]*(\{|$)"
        vertices = F.btrim(F.regexp_replace(marked, between_vertices, "$1,$2"), F.lit(","))
        return let(vertices, lambda v: _typed_parts(
            F.when((kind != "Point") & (body != ""), kind).when((v != "") & ~body.contains(","), kind),
            F.concat(F.lit("[["), v, F.lit("]]"))))

    bare = F.replace(F.replace(c, F.lit("("), F.lit("")), F.lit(")"), F.lit(""))
    return let(t.trim_ws(F.substring(bare, F.length(kind) + 1, F.lit(2_000_000_000))), of_body)


def _geojson(c: Column) -> Column:
    """Type and parts text of a GeoJSON; a MultiPolygon contributes all its rings."""

    def of_object(found: Column) -> Column:
        kind = found["type"]
        nested = F.regexp_replace(found["coordinates"], _JSON_VERTEX, '{"lon":"$1","lat":"$2"}')
        rings = F.regexp_replace(F.regexp_replace(nested, r"\]\s*\]\s*,\s*\[\s*\[", "],["), r"^\s*\[|\]\s*$", "")
        return _typed_parts(kind, (
            F.when(kind == "Point", F.concat(F.lit("[["), nested, F.lit("]]")))
            .when(kind == "LineString", F.concat(F.lit("["), nested, F.lit("]")))
            .when(kind == "MultiPolygon", rings)
            .when(kind.isin("MultiLineString", "Polygon"), nested)))

    return let(F.from_json(c, "type string, coordinates string"), of_object)


def _plain(text: Column) -> Column:
    """Geometry of a text that matches ``_PLAIN``: its numbers in pairs, in one part."""
    kind = (F.when(text.startswith("POINT") | text.contains('"Point"'), "Point")
            .when(text.startswith("LINESTRING") | text.contains('"LineString"'), "LineString").otherwise("Polygon"))
    axis = lambda group: F.regexp_extract_all(text, F.lit("([0-9+.-]+)[ ,]+([0-9+.-]+)"), F.lit(group))
    pairs = F.arrays_zip(axis(1), axis(2)).try_cast(f"array<{POINT_TYPE}>")
    return _typed_parts(kind, F.array(pairs))


def parse_geometry(c: Column) -> Column:
    """Geometry of a WKT or GeoJSON text; null if it is neither.

    Usual texts are matched for their pairs of numbers.  All others are rewritten, in
    either notation, to one JSON form of the parts and read by a single
    ``from_json``, so nothing is done vertex by vertex outside the
    regular-expression and JSON readers.
    """

    def of_text(text: Column) -> Column:
        return F.when(text.rlike(_PLAIN), _plain(text)).otherwise(
            let(F.when(text.startswith("{"), _geojson(text)).otherwise(_wkt(text)), of_parts))

    def of_parts(found: Column) -> Column:
        parts = F.from_json(found["parts"], _TEXT_PARTS).try_cast(f"array<array<{POINT_TYPE}>>")
        return let(parts, lambda x: F.when(found["type"].isNotNull() & x.isNotNull(), F.struct(
            found["type"].alias("type"), x.alias("parts"))))

    return let(t.trim_ws(c), of_text)


def line_points(geometry: Column) -> Column:
    """Points of a line (of the first part of a multi-line); null for other shapes."""
    return F.when(geometry["type"].isin("LineString", "MultiLineString"), F.get(geometry["parts"], F.lit(0)))


def _mean(points: Column, axis: str) -> Column:
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[axis])
    return total / F.size(points)


def representative_point(geometry: Column) -> Column:
    """The point itself, the first vertex of a line, or the vertex mean of the first ring."""

    def of(g: Column) -> Column:
        first = F.get(g["parts"], F.lit(0))
        return (
            F.when(g["type"].isin("Point", "LineString"), F.get(first, F.lit(0)))
            .when(is_area(g) & (F.size(first) > 0), point(_mean(first, "lon"), _mean(first, "lat")))
        )

    return let(geometry, of)


def distance_m(a: Column, b: Column) -> Column:
    """Great-circle distance of two points in metres; infinite if one is missing."""
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2.0))
    h = half(b["lat"] - a["lat"]) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * half(b["lon"] - a["lon"])
    # ``least`` skips nulls, so missing points are tested for first.
    missing = a["lon"].isNull() | b["lon"].isNull()
    return F.when(missing, F.lit(float("inf"))).otherwise(
        F.lit(2 * MAP_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def bearing_deg(a: Column, b: Column) -> Column:
    """Initial bearing from one point to another, -180 to 180 degrees."""
    lat1, lat2, turn = F.radians(a["lat"]), F.radians(b["lat"]), F.radians(b["lon"] - a["lon"])
    east = F.sin(turn) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(turn)
    return F.degrees(F.atan2(east, north))


def _local_xy(lon: Column, lat: Column, at: Column) -> tuple[Column, Column]:
    """Metres east and north of a point, in the plane that touches the sphere there."""
    metres = MEAN_RADIUS_M * 3.141592653589793 / 180
    return (lon - at["lon"]) * F.cos(F.radians(at["lat"])) * metres, (lat - at["lat"]) * metres


def segment_position(at: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where on the segment the point nearest to ``at`` lies: 0 at its start, 1 at its end."""
    ax, ay = _local_xy(x1, y1, at)
    bx, by = _local_xy(x2, y2, at)
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    along = -(ax * dx + ay * dy) / F.nullif(length2, F.lit(0.0))
    return F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def segment_distance_m(at: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment in metres, in the local plane of the point."""
    ax, ay = _local_xy(x1, y1, at)
    bx, by = _local_xy(x2, y2, at)
    along = segment_position(at, x1, y1, x2, y2)
    px, py = ax + along * (bx - ax), ay + along * (by - ay)
    return F.sqrt(px * px + py * py)


def is_area(geometry: Column) -> Column:
    return geometry["type"].isin("Polygon", "MultiPolygon")


def segments(geometry: Column) -> Column:
    """All segments of a geometry; rings are closed and a lone point is a segment of length 0."""
    closed = is_area(geometry)

    def of_part(part: Column) -> Column:
        n = F.size(part)
        last = F.when(closed, n).otherwise(F.greatest(n - 1, F.lit(1)))
        follower = lambda i: F.when(closed, i % n + 1).otherwise(F.least(i + 1, n))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(
            F.element_at(part, i)["lon"].alias("x1"), F.element_at(part, i)["lat"].alias("y1"),
            F.element_at(part, follower(i))["lon"].alias("x2"), F.element_at(part, follower(i))["lat"].alias("y2")))

    filled = F.filter(geometry["parts"], lambda p: F.size(p) > 0)
    return F.flatten(F.transform(filled, of_part))


def inside_rings(parts: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against all rings together, so holes and islands work."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)
        return F.size(F.filter(F.sequence(F.lit(1), n), lambda i: _crosses(
            F.element_at(ring, i), F.element_at(ring, i % n + 1), lon, lat)))

    filled = F.filter(parts, lambda p: F.size(p) > 0)
    return F.aggregate(filled, F.lit(0), lambda acc, ring: acc + crossings(ring)) % 2 == 1


def _crosses(a: Column, b: Column, lon: Column, lat: Column) -> Column:
    """True if the edge a-b crosses the ray that runs east from the point."""
    meets_at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
    return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < meets_at)


def bounds(geometry: Column) -> Column:
    """Smallest and largest longitude and latitude of all vertices."""
    vertices = F.flatten(geometry["parts"])
    axis = lambda name: F.transform(vertices, lambda p: p[name])
    return F.struct(
        F.array_min(axis("lon")).alias("min_lon"), F.array_min(axis("lat")).alias("min_lat"),
        F.array_max(axis("lon")).alias("max_lon"), F.array_max(axis("lat")).alias("max_lat"))


def density_color(intensity: Column) -> Column:
    """Yellow-orange-red colour of a share between 0 and 1."""
    # Share -> red, green, blue.
    stops = ((0.00, (255, 255, 204)), (0.25, (254, 217, 118)), (0.50, (253, 141, 60)),
             (0.75, (227, 26, 28)), (1.00, (128, 0, 38)))

    def channel(k: int) -> Column:
        mixes = [(upper, F.floor(low[k] + (intensity - start) / (upper - start) * (high[k] - low[k]) + 0.5))
                 for (start, low), (upper, high) in zip(stops, stops[1:])]
        return reduce(lambda acc, m: acc.when(intensity <= m[0], m[1]), mixes, F).cast("int")

    return F.concat(F.lit("rgb("), F.concat_ws(",", *[channel(k).cast("string") for k in range(3)]), F.lit(")"))
