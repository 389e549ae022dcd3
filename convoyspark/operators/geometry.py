"""Geometries of plans: roles, labels, anchors and bounds.

Plans share their texts, so each distinct one is parsed once.  Where these are few
enough to be broadcast, plans look theirs up column by column (a text has one of
``ROLES``) and nothing of a plan is shuffled; else texts are parsed in their rows
or joined by their digests.  Arrays of parsed geometries
are exploded with the *outer* generators: for the inner ones Spark infers a
filter on the array's size, which would parse every text a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convoyspark.functions import geo, text as t
from convoyspark.operators import derive as d
from convoyspark.operators.stored import is_small, stored
from convoyspark.plans import schema as s

#: Columns the lookups of :mod:`lookups` attach; null where they were not run.
LOOKUP_COLUMNS = ("camp_path_geom", "exit_route_geom", "exit_point_geom", "exit_code", "exit_name")

#: Roles of a plan's geometry texts, in order.
ROLES = ("internal", "tarwia_exit", "tarwia_exit_point", "external", "entrance", "start", "end",
         "parking_combined", "get_parking", "set_parking")


def _text(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _end_text(end: str) -> Column:
    """Geometry text of one end: the specific column if filled, else the point column."""
    return t.first_filled(F.col(f"{end}_geom"), F.col(f"{end}_point_geom"))


def plan_class() -> Column:
    """Class of the plan's type; the folded text is long, so it is bound and worked out once."""
    return geo.let(t.text_key(t.first_filled(F.col("plan_type_code"), F.col("plan_type_name"))), d.class_of_key)


def _parking_label(prefix: str, end: str) -> Column:
    kind, name = (F.nullif(t.trim_ws(F.col(f"{end}_{x}")), F.lit("")) for x in ("type_parking", "parking_name"))
    return F.concat(F.lit(prefix), F.concat_ws("/", kind, name))


def _with_all_columns(plans: DataFrame) -> DataFrame:
    needed = (*s.GEOMETRY_COLUMNS, *LOOKUP_COLUMNS, "plan_type_code", "plan_type_name", "path_name", "camp_label",
              "start_point_name", "end_point_name", "entrance_name", "entrance_asm_code",
              "get_type_parking", "get_parking_name", "set_type_parking", "set_parking_name",
              "start_point_type", "end_point_type")
    absent = {c: F.lit(None).cast("string") for c in needed if c not in plans.columns}
    return plans.withColumns(absent) if absent else plans


def with_geometry_items(plans: DataFrame) -> DataFrame:
    """Add ``items``: the plan's geometry texts with role, order and label.

    Order: internal (or looked-up camp path), exit route, exit point, external,
    entrance, start, end, parkings.  Equal parkings become one combined item.
    """
    df = _with_all_columns(plans)
    looked_up = any(c in plans.columns for c in LOOKUP_COLUMNS)
    return df.withColumn("items", geo.let(plan_class(), _items) if looked_up else _items(F.lit(None).cast("string")))


def _slots(kind: Column) -> list[tuple[Column, Column]]:
    """Text (null where there is none) and label of each of ``ROLES``."""
    same_parking = F.coalesce(_text("get_parking_geom") == _text("set_parking_geom"), F.lit(False))
    internal = F.coalesce(_text("internal_path"), F.when(kind == "direct_taseed", F.col("camp_path_geom")))
    exit_label = t.first_filled(F.col("exit_name"), F.col("exit_code"), "")
    name = lambda *cs: t.text_or_blank(t.first_filled(*[F.col(c) for c in cs]))
    return [
        (internal, name("path_name", "camp_label")),
        (F.when(kind == "tarwia", F.col("exit_route_geom")),
         t.text_or_blank(t.first_filled(F.col("exit_name"), F.col("exit_code"), F.col("camp_label")))),
        (F.when(kind == "tarwia", F.col("exit_point_geom")), t.trim_ws(exit_label)),
        (_text("path_geom"), F.lit("")),
        (_text("entrance_polygon"), name("entrance_name", "entrance_asm_code")),
        (_end_text("start"), name("start_point_name")),
        (_end_text("end"), name("end_point_name")),
        (F.when(same_parking, _text("get_parking_geom")), _parking_label("استلام و تسليم: ", "get")),
        (F.when(~same_parking, _text("get_parking_geom")), _parking_label("استلام: ", "get")),
        (F.when(~same_parking, _text("set_parking_geom")), _parking_label("تسليم: ", "set")),
    ]


def _items(kind: Column) -> Column:
    array = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(role).alias("role"), text.alias("text"), label.alias("label"))
        for i, (role, (text, label)) in enumerate(zip(ROLES, _slots(kind)))])
    return F.filter(array, lambda x: x["text"].isNotNull())


def text_column(i: int) -> str:
    return f"text_{i}"


def with_texts(plans: DataFrame) -> DataFrame:
    """Add a text column for each of ``ROLES`` (see :func:`text_column`), and one for the entrance point after them.

    Without lookups no text depends on the class of the plan, so that is not worked out.
    """
    df = _with_all_columns(plans)
    if any(c in plans.columns for c in LOOKUP_COLUMNS):
        df = geo.with_value(df, "kind_", plan_class())
        texts = [text for text, _ in _slots(F.col("kind_"))]
    else:
        texts = [text for text, _ in _slots(F.lit(None).cast("string"))]
    return df.withColumns({text_column(i): text for i, text in enumerate([*texts, _text("entrance_point_geom")])})


def text_rows(texts: DataFrame, *carried: str, gate: bool = False) -> DataFrame:
    """``carried`` and ``text``, one row for each text of :func:`with_texts`, the entrance point included if asked for."""
    cells = F.array(*[F.col(text_column(i)) for i in range(len(ROLES) + gate)])
    return texts.select(*carried, F.explode(cells).alias("text")).where("text is not null")


def parsed_texts(texts: DataFrame, *, gate: bool = False, **values) -> DataFrame:
    """Each distinct text of :func:`with_texts` that parses, with ``values`` (functions of the geometry), written once."""
    named = geo.with_value(text_rows(texts, gate=gate).distinct(), "geom_", geo.parse_geometry(F.col("text"))).where("geom_ is not null")
    return stored(named.select("text", *[f(F.col("geom_")).alias(n) for n, f in values.items()]), "texts")


def look_up(texts: DataFrame, table: DataFrame, *, gate: bool = False) -> DataFrame:
    """Add ``found_0`` to ``found_9`` (or 10), the other columns of the row of ``table`` with the text, and ``before_0`` and on, how many are
    found before; ``table`` is broadcast."""
    rest = [c for c in table.columns if c != "text"]
    texts = texts.withColumn("before_0", F.lit(0))
    for i in range(len(ROLES) + gate):
        side = table.select(F.col("text").alias("key_"), F.struct(*rest).alias(f"found_{i}"))
        texts = texts.join(F.broadcast(side), F.col(text_column(i)) == F.col("key_"), "left").drop("key_").withColumn(
            f"before_{i + 1}", F.col(f"before_{i}") + F.col(f"found_{i}").isNotNull().cast("int"))
    return texts


def apart(plans: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """Plans whose keys occur once, and those whose keys may occur more often; None if there are none.

    Only hashes of the keys are shuffled; a collision sends a plan to the second table, where keys are compared.
    """
    hashed = plans.withColumn("hash_", F.xxhash64(*keys))
    often = stored(hashed.groupBy("hash_").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash_"), "often")
    if often.isEmpty():
        return plans, None
    side = F.broadcast(often) if is_small(often, F.lit(8)) else often
    return hashed.join(side, "hash_", "left_anti").drop("hash_"), hashed.join(side, "hash_", "left_semi").drop("hash_")


def with_geometries(plans: DataFrame) -> DataFrame:
    """Add ``geometries``: the items whose text parses, with the geometry in place of the text."""
    df = with_geometry_items(plans)
    parsed = F.transform("items", lambda x: F.struct(
        x["ord"].alias("ord"), x["role"].alias("role"), geo.parse_geometry(x["text"]).alias("geom"), x["label"].alias("label")))
    return df.withColumn("geometries", F.filter(parsed, lambda x: x["geom"].isNotNull())).drop("items")


def geometry_id(text: Column) -> Column:
    """Digest of a geometry text without the white space around it."""
    return F.md5(t.trim_ws(text).cast("binary"))


def distinct_texts(items: DataFrame) -> DataFrame:
    """Every text of the column ``text`` parsed once: ``geometry_id`` and ``geom`` (texts that do not parse are left out)."""
    texts = items.select(t.trim_ws(F.col("text")).alias("text")).distinct()
    named = texts.select(geometry_id(F.col("text")).alias("geometry_id"), "text")
    return geo.with_value(named, "geom", geo.parse_geometry(F.col("text"))).where("geom is not null").drop("text")


def item_rows(plans: DataFrame, *carried: str) -> DataFrame:
    """One row per plan and geometry text: row keys, ``plan_id``, ``carried``, ``ord``, ``role`` and ``text``, the entrance point (role ``gate``) included."""
    df = with_geometry_items(plans)
    gate = F.struct(F.lit(-1).alias("ord"), F.lit("gate").alias("role"), _text("entrance_point_geom").alias("text"), F.lit("").alias("label"))
    return df.select(*row_keys(plans), "plan_id", *carried, F.explode_outer(F.concat("items", F.array(gate))).alias("item")).where(
        "item.text is not null").select(*row_keys(plans), "plan_id", *carried, "item.ord", "item.role", "item.text")


def with_route_parts(plans: DataFrame) -> DataFrame:
    """Row keys, ``plan_id``, ``lines`` (order, role and points of every line of two or more points) and the anchors of each plan with a geometry.

    Plans are told apart by their row keys and ``plan_id``: rows with equal ones are one plan.  Where the distinct texts are
    few, plans whose keys occur once look them up in place; the items of all others are joined and meet on one row.
    """
    values = {"points": geo.line_points, "spot": geo.representative_point}
    df = _with_all_columns(plans)
    keys = [*row_keys(plans), "plan_id", "start_point_type", "end_point_type"]
    parsed = parsed_texts(with_texts(plans), gate=True, **values)
    if not is_small(parsed, F.length("text")):
        return _route_anchors(_met_parts(df, plans, keys))
    once, often = apart(df, *keys)
    found = _own_parts(once, plans, keys, parsed)
    return _route_anchors(found if often is None else found.unionByName(_met_parts(often, plans, keys)))


def _own_parts(df: DataFrame, plans: DataFrame, keys: list[str], parsed: DataFrame) -> DataFrame:
    """Keys and ``found_``: order, role, points and spot of a plan's parsed texts, looked up in place."""
    df = look_up(with_texts(df.select(*plans.columns, *[c for c in keys if c not in plans.columns])), parsed, gate=True)
    gate, part = len(ROLES), lambda i, ord_, role: F.struct(
        F.lit(ord_).alias("ord"), F.lit(role).alias("role"), F.col(f"found_{i}.points").alias("points"), F.col(f"found_{i}.spot").alias("spot"))
    parts = [(gate, -1, "gate"), *[(i, i, role) for i, role in enumerate(ROLES)]]
    each = F.array(*[F.when(F.col(f"found_{i}").isNotNull(), part(i, ord_, role)) for i, ord_, role in parts])
    return df.where(F.coalesce(*[F.col(f"found_{i}") for i, *_ in parts]).isNotNull()).select(*keys, F.array_compact(each).alias("found_"))


def _met_parts(df: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and ``found_`` as :func:`_own_parts` gives them, from all rows of a plan: items are joined by their digests and meet by their keys."""
    items = item_rows(df, *[k for k in keys if k not in (*row_keys(plans), "plan_id")])
    parts = distinct_texts(items).select("geometry_id", geo.line_points(F.col("geom")).alias("points"), geo.representative_point(F.col("geom")).alias("spot"))
    placed = items.select(*keys, "ord", "role", geometry_id(F.col("text")).alias("geometry_id")).join(parts, "geometry_id")
    return placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "role", "points", "spot"))).alias("found_"))


def _route_anchors(found: DataFrame) -> DataFrame:
    spot = lambda role: F.get(F.filter("found_", lambda x: x["role"] == role), F.lit(0))["spot"]
    lines = F.transform(F.filter("found_", lambda x: F.coalesce(F.size(x["points"]) >= 2, F.lit(False))), lambda x: F.struct(x["ord"], x["role"], x["points"]))
    return _with_named_anchors(found.withColumns({
        "lines": lines, "start_anchor": spot("start"), "end_anchor": spot("end"),
        "entrance_anchor": F.coalesce(spot("gate"), spot("entrance")), "exit_anchor": spot("tarwia_exit_point")}).drop("found_"))


def row_keys(df: DataFrame) -> list[str]:
    return [c for c in (s.ROW, s.SUB) if c in df.columns]


def explode_geometries(plans: DataFrame) -> DataFrame:
    """One row per plan and geometry.

    A label belongs to a line or an area; a point-shaped internal or exit route has none.
    """
    parsed = parsed_texts(with_texts(plans), geom=lambda geom: geom)
    if not is_small(parsed, F.length("text")):
        exploded = with_geometries(plans).select(
            *row_keys(plans), "plan_id", F.posexplode_outer("geometries").alias("ord", "g")).where("ord is not null")
    else:
        exploded = _own_geometries(plans, parsed)
    unlabelled = (F.col("g.geom.type") == "Point") & (F.col("g.role") == "internal")
    return exploded.select(
        *row_keys(plans), "plan_id", "ord", F.col("g.role").alias("role"), F.col("g.geom").alias("geom"),
        F.when(unlabelled, F.lit("")).otherwise(F.col("g.label")).alias("label"))


def _own_geometries(plans: DataFrame, parsed: DataFrame) -> DataFrame:
    """Keys, ``ord`` (the place among the plan's geometries) and ``g``, with texts looked up in place."""
    df = with_texts(plans).withColumn("kind_", F.lit(None).cast("string"))
    # A label is an operator of its own, as all of them in one make a method too large to be compiled.
    for i, (_, label) in enumerate(_slots(F.col("kind_"))):
        df = geo.with_value(df, f"label_{i}", label)
    found = look_up(df, parsed)
    cells = [F.struct(F.col(f"before_{i}").alias("ord"), F.lit(role).alias("role"), F.col(f"found_{i}.geom").alias("geom"), F.col(f"label_{i}").alias("label"))
             for i, role in enumerate(ROLES)]
    return found.select(*row_keys(plans), "plan_id", F.explode(F.array(*cells)).alias("g")).where("g.geom is not null").select(
        *row_keys(plans), "plan_id", "g.ord", "g")


def parse_report(plans: DataFrame, columns: tuple[str, ...] = s.GEOMETRY_COLUMNS) -> DataFrame:
    """Texts given, parsed and rejected per geometry column, and the vertices kept, in one pass.

    Texts are counted first, so each distinct one is parsed once.
    """
    present = [c for c in columns if c in plans.columns]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("text")) for c in present])
    given = plans.select(F.inline(F.filter(cells, lambda x: x["text"].isNotNull()))).groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))
    parsed = given.withColumn("geom", geo.parse_geometry(F.col("text")))
    vertices = F.aggregate(F.col("geom.parts"), F.lit(0), lambda acc, p: acc + F.size(p))
    return parsed.groupBy("column", F.col("geom.type").alias("type")).agg(
        F.sum("n").alias("given"), F.sum(F.when(F.col("geom").isNotNull(), F.col("n")).otherwise(0)).alias("parsed"),
        F.sum(F.when(F.col("geom").isNull(), F.col("n")).otherwise(0)).alias("rejected"),
        F.coalesce(F.sum(vertices * F.col("n")), F.lit(0)).cast("bigint").alias("vertices"))


def anchor(end: str) -> Column:
    """Representative point of the start or end geometry."""
    return geo.representative_point(geo.parse_geometry(_end_text(end)))


def with_anchors(plans: DataFrame) -> DataFrame:
    """Add the points that orient routes: start, end, entrance, residence and destination.

    Where :func:`with_geometries` has run, its parsed geometries are used again.
    """
    df = _with_all_columns(plans)
    if "geometries" in df.columns:
        parsed = lambda role: geo.representative_point(
            F.get(F.filter("geometries", lambda x: x["role"] == role), F.lit(0))["geom"])
        gate = geo.representative_point(geo.parse_geometry(F.col("entrance_point_geom")))
        spots = F.array(parsed("start"), parsed("end"), parsed("entrance"), gate)
    else:
        texts = F.array(_end_text("start"), _end_text("end"), F.col("entrance_polygon"), F.col("entrance_point_geom"))
        spots = F.transform(texts, lambda x: geo.representative_point(geo.parse_geometry(x)))
    df = geo.with_value(df, "spots_", spots)
    start, end, area, gate = (F.get("spots_", F.lit(i)) for i in range(4))
    return _with_named_anchors(df.withColumns({
        "start_anchor": start, "end_anchor": end, "entrance_anchor": F.coalesce(gate, area)}).drop("spots_"))


def _with_named_anchors(df: DataFrame) -> DataFrame:
    """The residence is the end of that type; the destination is the entrance, else the other end."""
    lives = lambda end: F.coalesce(F.col(f"{end}_point_type") == "residence", F.lit(False))
    return df.withColumns({
        "residence_anchor": F.when(lives("start"), F.col("start_anchor")).when(lives("end"), F.col("end_anchor")),
        "destination_anchor": F.coalesce(
            "entrance_anchor", F.when(~lives("start"), F.col("start_anchor")), F.when(~lives("end"), F.col("end_anchor"))),
    })


def geometry_bounds(plans: DataFrame) -> DataFrame:
    """Bounding box over all geometries.

    Texts are counted first, so each distinct one is parsed once; then a minimum and maximum per text and one small aggregate.
    """
    texts = text_rows(with_texts(plans)).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    boxes = geo.with_value(texts, "geom", geo.parse_geometry(F.col("text"))).where("geom is not null").select(
        "n", geo.bounds(F.col("geom")).alias("b"))
    return boxes.agg(
        F.min("b.min_lon").alias("min_lon"), F.min("b.min_lat").alias("min_lat"),
        F.max("b.max_lon").alias("max_lon"), F.max("b.max_lat").alias("max_lat"), F.coalesce(F.sum("n"), F.lit(0)).alias("geometries"))
