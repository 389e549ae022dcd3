"""Direction of travel of route lines: single lines, connected sequences and gaps.

Each distinct geometry text is parsed once; then a plan's lines meet on one row and
all else is local to it. The directions of a sequence are a fold over its lines with two states, the last line as it is or
turned; each state keeps its least metres and which lines it turned. Folds and
bindings are array functions, so every distance is written out once and the
generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convoyspark.functions import geo
from convoyspark.operators import geometry as g

# Fixed values, in metres: how much better the reverse direction must fit, and
# the gaps that are bridged.
MARGIN_M, INTERNAL_MARGIN_M = 6.0, 10.0
GAP_MIN_M, GAP_MAX_M = 12.0, 5000.0


def _head(points: Column) -> Column:
    return F.try_element_at(points, F.lit(1))


def _tail(points: Column) -> Column:
    return F.try_element_at(points, F.lit(-1))


def _with_aims(plans: DataFrame) -> DataFrame:
    """Add ``aim_`` and ``internal_aim_``: the points that a line should start and end near, and the margin to be turned.

    Internal paths must start at the entrance.  Otherwise the best anchors available count: residence and
    destination, residence alone, start and end, start, or end.
    """
    entrance, residence, destination, start, end = (
        F.col(f"{a}_anchor") for a in ("entrance", "residence", "destination", "start", "end"))

    def aim(near: Column, far: Column, margin: float) -> Column:
        return F.struct(near.alias("near"), far.alias("far"), F.lit(margin).alias("margin"))

    def best(margin: float) -> Column:
        none = F.lit(None).cast(geo.POINT_TYPE)
        return (F.when(residence.isNotNull(), aim(residence, destination, margin))
                .when(start.isNotNull(), aim(start, end, margin)).otherwise(aim(none, end, margin)))

    nowhere = F.lit(None).cast(geo.POINT_TYPE)
    return plans.withColumns({
        "aim_": best(MARGIN_M),
        "internal_aim_": F.when(entrance.isNotNull(), aim(entrance, nowhere, 0.0)).otherwise(best(INTERNAL_MARGIN_M))})


def should_reverse(points: Column, role: Column) -> Column:
    """Whether a line runs against the aim of its plan (see :func:`_with_aims`)."""
    away = lambda p, aim: F.when(aim.isNull(), F.lit(0.0)).otherwise(geo.distance_m(p, aim))
    found = F.struct(_head(points).alias("head"), _tail(points).alias("tail"),
                     F.when(role == "internal", F.col("internal_aim_")).otherwise(F.col("aim_")).alias("aim"))
    return (F.size(points) >= 2) & geo.let(found, lambda x: (
        away(x["tail"], x["aim"]["near"]) + away(x["head"], x["aim"]["far"]) + x["aim"]["margin"]
        < away(x["head"], x["aim"]["near"]) + away(x["tail"], x["aim"]["far"])))


def _with_lines(plans: DataFrame) -> DataFrame:
    """Row keys, ``plan_id``, ``lines``, the anchors and the aims of plans with a geometry."""
    return _with_aims(g.with_route_parts(plans))


def route_orientation(plans: DataFrame) -> DataFrame:
    """Each line on its own: whether it is reversed, and its oriented ends."""
    lines = _with_lines(plans).select(
        *g.row_keys(plans), "plan_id", F.explode_outer("lines").alias("l"), "aim_", "internal_aim_").where("l is not null")
    turned = lines.select(
        *g.row_keys(plans), "plan_id", F.col("l.role").alias("role"), F.col("l.points").alias("points"),
        should_reverse(F.col("l.points"), F.col("l.role")).alias("reversed"))
    flow = F.when(F.col("reversed"), F.reverse("points")).otherwise(F.col("points"))
    return turned.select(
        *g.row_keys(plans), "plan_id", "role", "reversed", flow.alias("points"),
        _head(flow).alias("head"), _tail(flow).alias("tail"))


def _shortest(ends: Column, start: Column, end: Column, order: int) -> Column:
    """Least length from ``start`` along all lines to ``end``, the order's number, and a mask whose bit i says that line i is turned.

    Of equal lengths the least mask wins, as if all masks were tried in turn.  Lengths are added in whole micrometres,
    so that sums are exact and ways of the same legs tie, whatever their order.
    """
    leg_length = lambda a, b: F.rint(geo.distance_m(a, b) * 1e6)
    way = lambda length, mask: F.struct(length.alias("length"), mask.alias("mask"))
    none, first = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    begin = F.struct(way(F.lit(0.0), none).alias("kept"), start.alias("kept_at"),
                     way(F.lit(float("inf")), none).alias("turned"), start.alias("turned_at"), first.alias("bit"))

    def onwards(acc: Column, to: Column, bit: Column) -> Column:
        both = F.array(*[way(acc[s]["length"] + leg_length(acc[f"{s}_at"], to), acc[s]["mask"] + bit) for s in ("kept", "turned")])
        return F.array_min(both)

    def line(acc: Column, leg: Column) -> Column:
        return F.struct(
            onwards(acc, leg["head"], none).alias("kept"), leg["tail"].alias("kept_at"),
            onwards(acc, leg["tail"], acc["bit"]).alias("turned"), leg["head"].alias("turned_at"), (acc["bit"] * 2).alias("bit"))

    return F.aggregate(ends, begin, line, lambda acc: geo.let(onwards(acc, end, none), lambda best: F.struct(
        best["length"].alias("length"), F.lit(order).alias("order"), best["mask"].alias("mask"))))


def _with_sequence(df: DataFrame) -> DataFrame:
    """Add ``sequence_``: the lines in the order and directions with the shortest total of start gap, gaps and end gap.

    Two lines may change places, more keep their order.  Plans without both ends have each line turned on its own.
    """
    ends = F.transform("lines", lambda x: F.struct(_head(x["points"]).alias("head"), _tail(x["points"]).alias("tail")))
    start, end = F.coalesce("residence_anchor", "start_anchor"), F.coalesce("destination_anchor", "end_anchor")

    def best(x: Column) -> Column:
        forth, back = (_shortest(e, x["start"], x["end"], i) for i, e in enumerate((x["ends"], F.reverse(x["ends"]))))
        return F.when(F.size(x["ends"]) == 2, F.least(forth, back)).when(F.size(x["ends"]) > 2, forth)

    found = F.when(start.isNotNull() & end.isNotNull(), geo.let(
        F.struct(ends.alias("ends"), start.alias("start"), end.alias("end")), best))
    df = geo.with_value(df, "best_", found)
    visited = F.when(F.col("best_.order") == 1, F.reverse("lines")).otherwise(F.col("lines"))
    joined = F.transform(visited, lambda x, i: _turn(x, F.getbit(F.col("best_.mask"), i) == 1))
    alone = F.transform("lines", lambda x: _turn(x, should_reverse(x["points"], x["role"])))
    return geo.with_value(df, "sequence_", F.when(F.col("best_").isNotNull(), joined).otherwise(alone))


def _turn(line: Column, reverse: Column) -> Column:
    return F.struct(line["ord"].alias("ord"), line["role"].alias("role"),
                    F.when(reverse, F.reverse(line["points"])).otherwise(line["points"]).alias("points"))


def connected_routes(plans: DataFrame) -> DataFrame:
    """All lines of a plan in travel order and direction, one row per line.

    Lines are chained from the residence (or start) to the destination (or
    end).  Internal lines are then turned to start at the entrance, and exit
    routes to end at the exit point.
    """
    df = _with_sequence(_with_lines(plans)).select(
        *g.row_keys(plans), "plan_id", F.posexplode_outer("sequence_").alias("position", "l"),
        "aim_", "internal_aim_", "exit_anchor").where("l is not null")
    points, role, out = F.col("l.points"), F.col("l.role"), F.col("exit_anchor")
    reverse = F.when(role == "internal", should_reverse(points, role)).when(
        role == "tarwia_exit", out.isNotNull() & (geo.distance_m(_head(points), out) < geo.distance_m(_tail(points), out))).otherwise(F.lit(False))
    df = df.withColumn("turn_", reverse)
    flow = F.when(F.col("turn_"), F.reverse(points)).otherwise(points)
    return df.select(
        *g.row_keys(plans), "plan_id", "position", role.alias("role"), flow.alias("points"),
        _head(flow).alias("head"), _tail(flow).alias("tail"))


def route_gaps(plans: DataFrame) -> DataFrame:
    """Gaps between consecutive lines of direct plans that are worth a connector: neither closed already nor too far."""
    df = _with_sequence(_with_lines(plans.where(g.plan_class() == "direct_taseed")))
    follower = F.slice("sequence_", 2, F.greatest(F.size("sequence_"), F.lit(0)))  # the last line has none
    gaps = df.select(*g.row_keys(plans), "plan_id", F.posexplode_outer(F.zip_with("sequence_", follower, lambda a, b: F.struct(
        _tail(a["points"]).alias("from_point"), _head(b["points"]).alias("to_point")))).alias("position", "gap")).where("gap.to_point is not null")
    measured = geo.with_value(gaps, "metres", geo.distance_m(F.col("gap.from_point"), F.col("gap.to_point")))
    return measured.where(F.col("metres").between(GAP_MIN_M, GAP_MAX_M)).select(
        *g.row_keys(plans), "plan_id", "position", "gap.from_point", "gap.to_point", "metres")
