"""Ordered sequences: polylines to runs and directions, spines, samples and arrows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import path_length, wrap_angle
from ..functions.numbers import round_feet, round_half_up
from ..functions.text import stair_phrase, turn_phrase
from .lineage import stated

PX_PER_FOOT, SAME_HALLWAY, MIN_RUN = 2.6, math.radians(42), 28 * 2.6


def _run(sx: Column, sy: Column, ex: Column, ey: Column, b: Column | None = None) -> Column:
    d = F.atan2(ey - sy, ex - sx) if b is None else b
    return F.struct(sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey"), d.alias("b"), F.hypot(ex - sx, ey - sy).alias("px"))


_RUNS = "array<struct<sx:double,sy:double,ex:double,ey:double,b:double,px:double>>"


def runs(path: Column | str) -> Column:
    """An array of (x, y) to straight runs (sx, sy, ex, ey, b, px).

    A run ends where a step's bearing leaves its first step's by more than SAME_HALLWAY; runs under
    MIN_RUN fold into the one before (the leading ones into the next); runs that then keep their
    bearing within SAME_HALLWAY become one.
    """
    p = F.col(path) if isinstance(path, str) else path
    empty = F.expr(f"cast(array() as {_RUNS})")
    first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    start = F.struct(first["x"].alias("ax"), first["y"].alias("ay"), first["x"].alias("px"), first["y"].alias("py"), F.atan2(second["y"] - first["y"], second["x"] - first["x"]).alias("b"), empty.alias("out"))

    def walk(s: Column, q: Column) -> Column:
        step = F.atan2(q["y"] - s["py"], q["x"] - s["px"])
        turn = F.abs(wrap_angle(step - s["b"])) > SAME_HALLWAY
        ended = F.array_append(s["out"], _run(s["ax"], s["ay"], s["px"], s["py"], s["b"]))
        pick = lambda a, b: F.when(turn, a).otherwise(b)
        return F.struct(pick(s["px"], s["ax"]).alias("ax"), pick(s["py"], s["ay"]).alias("ay"), q["x"].alias("px"), q["y"].alias("py"), pick(step, s["b"]).alias("b"), pick(ended, s["out"]).alias("out"))

    raw = F.aggregate(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), start, walk, lambda s: F.array_append(s["out"], _run(s["ax"], s["ay"], s["px"], s["py"], s["b"])))

    def last(out: Column) -> Column:
        return F.element_at(out, -1)

    def but_last(out: Column) -> Column:
        return F.slice(out, F.lit(1), F.size(out) - 1)

    def fold(out: Column, r: Column) -> Column:
        into = F.array_append(but_last(out), _run(last(out)["sx"], last(out)["sy"], r["ex"], r["ey"], last(out)["b"]))
        return F.when((r["px"] < MIN_RUN) & (F.size(out) > 0), into).otherwise(F.array_append(out, r))

    merged = F.aggregate(raw, empty, fold)

    def head(out: Column, r: Column) -> Column:
        short = (F.size(out) == 1) & (F.get(out, F.lit(0))["px"] < MIN_RUN)
        return F.when(short, F.array(_run(F.get(out, F.lit(0))["sx"], F.get(out, F.lit(0))["sy"], r["ex"], r["ey"]))).otherwise(F.array_append(out, r))

    opened = F.aggregate(merged, empty, head)
    flowed = F.transform(opened, lambda r: _run(r["sx"], r["sy"], r["ex"], r["ey"]))

    def straighten(out: Column, r: Column) -> Column:
        near = (F.size(out) > 0) & (F.abs(wrap_angle(r["b"] - last(out)["b"])) < SAME_HALLWAY)
        return F.when(near, F.array_append(but_last(out), _run(last(out)["sx"], last(out)["sy"], r["ex"], r["ey"]))).otherwise(F.array_append(out, r))

    return F.when(F.size(p) > 1, F.aggregate(flowed, empty, straighten)).otherwise(empty)


def directions(legs: DataFrame, floors: DataFrame) -> DataFrame:
    """legs (route_id, leg, floor, path, start_label, end_label) to readable steps.

    (route_id, leg, step, kind, text, feet, floor, x, y): start; walks, with the turn from the run before; stairs
    between legs, over as many flights as there are floors between; arrive, with the side of the last turn. x and y
    are where on the floor a step happens, null for a leg without points. Legs of fewer than two points have no
    walks. floors is (floor, idx, label), a stated table.
    """
    by_route = Window.partitionBy("route_id")
    order = by_route.orderBy("leg")
    known = stated(floors, "floors")
    table = F.broadcast(known.select("floor", F.col("idx").alias("f_idx")))
    l = legs.join(table, "floor").withColumns({"runs": runs("path"), "is_last": F.col("leg") == F.max("leg").over(by_route), "is_first": F.col("leg") == F.min("leg").over(by_route), "to_idx": F.lead("f_idx").over(order)})
    l = l.join(F.broadcast(known.select(F.col("idx").alias("to_idx"), F.col("label").alias("to_label"))), "to_idx", "left")
    n = F.size("runs")
    walked = F.when(F.col("is_last") & (n > 1), F.slice("runs", F.lit(1), n - 1)).otherwise(F.col("runs"))
    r = l.withColumn("walked", walked).select("route_id", "leg", "floor", "is_first", F.posexplode("walked").alias("i", "run"), "walked")
    before = F.get("walked", F.col("i") - 1)
    feet = round_feet(F.col("run.px") / PX_PER_FOOT)
    said = F.concat(F.lit("~"), feet.cast("long").cast("string"), F.lit(" ft"))
    turn = turn_phrase(wrap_angle(F.col("run.b") - before["b"]))
    text = F.when((F.col("i") == 0) & F.col("is_first"), F.concat(F.lit("Head down the hallway for "), said)).when(F.col("i") == 0, F.concat(F.lit("Continue for "), said)).when(turn.isNotNull(), F.concat(turn, F.lit(" and continue for "), said)).otherwise(F.concat(F.lit("Keep going for "), said))
    walk = r.select("route_id", "leg", (F.col("i") + 1).alias("step"), F.lit("walk").alias("kind"), text.alias("text"), feet.cast("double").alias("feet"), "floor", F.col("run.ex").alias("x"), F.col("run.ey").alias("y"))
    none = F.lit(None).cast("double").alias("feet")
    point = lambda i: ["floor", F.get("path", i)["x"].alias("x"), F.get("path", i)["y"].alias("y")]
    last = point(F.size("path") - 1)
    start = l.where("is_first").select("route_id", "leg", F.lit(0).alias("step"), F.lit("start").alias("kind"), F.concat(F.lit("Start at "), "start_label").alias("text"), none, *point(F.lit(0)))
    end = F.lit(1 << 20).alias("step")
    stairs = l.where("not is_last").select("route_id", "leg", end, F.lit("stairs").alias("kind"), stair_phrase("f_idx", "to_idx", "to_label").alias("text"), none, *last)
    delta = wrap_angle(F.get("runs", n - 1)["b"] - F.get("runs", n - 2)["b"])
    side = F.when(n < 2, " right there").when(F.abs(F.degrees(delta)) > 30, F.when(delta > 0, " on your right").otherwise(" on your left")).otherwise(" straight ahead")
    arrive = l.where("is_last").select("route_id", "leg", end, F.lit("arrive").alias("kind"), F.concat("end_label", F.lit(" is"), side).alias("text"), none, *last)
    return start.unionByName(walk).unionByName(stairs).unionByName(arrive)


def route_totals(legs: DataFrame) -> DataFrame:
    """(route_id, feet, flights, minutes) measured along the drawn paths."""
    g = legs.groupBy("route_id").agg((F.sum(path_length("path")) / PX_PER_FOOT).alias("ft"), (F.count(F.lit(1)) - 1).alias("flights"))
    return g.select("route_id", round_half_up("ft").cast("long").alias("feet"), "flights", F.greatest(F.lit(1), round_half_up((F.col("ft") / 4.0 + F.col("flights") * 25) / 60)).cast("int").alias("minutes"))


def _corner(a: Column, b: Column, c: Column, most: float) -> Column:
    """The point b between a and c, or the two points that replace it."""
    d1, d2 = F.hypot(b["x"] - a["x"], b["y"] - a["y"]), F.hypot(c["x"] - b["x"], c["y"] - b["y"])
    cut = F.least(d1 / 3, d2 / 3, F.lit(float(most)))
    to = lambda q, d: F.struct((b["x"] + (q["x"] - b["x"]) * cut / d).alias("x"), (b["y"] + (q["y"] - b["y"]) * cut / d).alias("y"))
    return F.when(cut < 2, F.array(b)).otherwise(F.array(to(a, d1), to(c, d2)))


def rounded_points(points: DataFrame, most: float, *, group: str = "route_id", seq: str = "seq") -> DataFrame:
    """Ordered (group, seq, x, y) to (group, i, part, x, y): as :func:`round_corners`, row by row, each point under its
    number from 1 on and a corner that is cut in two parts, 0 and 1."""
    order = Window.partitionBy(group).orderBy(seq)
    here = F.struct("x", "y")
    near = points.select(group, F.row_number().over(order).alias("i"), here.alias("b"), F.lag(here).over(order).alias("a"), F.lead(here).over(order).alias("c"))
    inner = F.col("a").isNotNull() & F.col("c").isNotNull()
    parts = F.when(inner, _corner(F.col("a"), F.col("b"), F.col("c"), most)).otherwise(F.array("b"))
    return near.select(group, "i", F.posexplode(parts).alias("part", "p")).select(group, "i", "part", "p.x", "p.y")


def round_corners(path: Column | str, most: float) -> Column:
    """Replaces each inner corner by two points, a third of the shorter way to its neighbours at most."""
    p = F.col(path) if isinstance(path, str) else path
    n = F.size(p)

    inner = F.flatten(F.transform(F.sequence(F.lit(1), n - 2), lambda i: _corner(F.get(p, i - 1), F.get(p, i), F.get(p, i + 1), most)))
    return F.when(n < 3, p).otherwise(F.concat(F.slice(p, 1, 1), inner, F.slice(p, -1, 1)))


def along(points: DataFrame, *, group: str = "route_id", seq: str = "seq") -> DataFrame:
    """Ordered (group, seq, x, y) with ``cum``, the running length of the path."""
    order = Window.partitionBy(group).orderBy(seq)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0))
    stepped = points.withColumn("__step", step)
    return stepped.withColumn("cum", F.sum("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def sample_at(spine: DataFrame, wanted: DataFrame, *, group: str = "route_id") -> DataFrame:
    """(group, d) to the point at length ``d`` along (group, seq, x, y, cum): an as-of join with interpolation."""
    order = Window.partitionBy(group).orderBy("seq")
    legs = spine.select(group, "x", "y", "cum", F.lead("x").over(order).alias("nx"), F.lead("y").over(order).alias("ny"), F.lead("cum").over(order).alias("ncum"), F.row_number().over(order).alias("i"))
    at = wanted.join(legs, group).where((F.col("cum") <= F.greatest("d", F.lit(0.0))) & (F.col("ncum").isNull() | (F.col("d") < F.col("ncum")) | (F.col("d") < 0) & (F.col("i") == 1)))
    t = F.when(F.col("ncum") > F.col("cum"), F.least(F.greatest((F.col("d") - F.col("cum")) / (F.col("ncum") - F.col("cum")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    found = at.select(group, "d", "i", (F.col("x") + (F.coalesce("nx", "x") - F.col("x")) * t).alias("x"), (F.col("y") + (F.coalesce("ny", "y") - F.col("y")) * t).alias("y"))
    return found.groupBy(group, "d").agg(F.max_by(F.struct("x", "y"), "i").alias("p")).select(group, "d", "p.x", "p.y")


def arrows(spine: DataFrame, *, every: float = 260.0, first: float = 130.0, group: str = "route_id") -> DataFrame:
    """Points every ``every`` along each spine, from ``first`` on."""
    length = spine.groupBy(group).agg(F.max("cum").alias("length")).where(F.col("length") >= first)
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.col("length") - first) / every).cast("int")), lambda i: i * every + first)
    return sample_at(spine, length.select(group, F.explode(steps).alias("d")), group=group)


def string_pull(path: Column | str, blocked: Column | str) -> Column:
    """Drops points that the anchor sees past: greedy, over an array of cells (x, y) and an array of
    blocked cells as ``x * 65536 + y`` values. The sight line is the cells of its rounded steps."""
    p = F.col(path) if isinstance(path, str) else path
    wall = F.col(blocked) if isinstance(blocked, str) else blocked

    def clear(a: Column, b: Column) -> Column:
        n = F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"]), F.lit(1)).cast("int")
        cells = F.transform(F.sequence(F.lit(0), n), lambda i: (round_half_up(a["x"] + (b["x"] - a["x"]) * i / n) * 65536 + round_half_up(a["y"] + (b["y"] - a["y"]) * i / n)).cast("long"))
        return ~F.arrays_overlap(cells, wall)

    first = F.get(p, F.lit(0))
    start = F.struct(F.array(first).alias("out"), first.alias("anchor"), first.alias("last"))

    def step(s: Column, q: Column) -> Column:
        sees = clear(s["anchor"], q)
        return F.when(sees, F.struct(s["out"].alias("out"), s["anchor"].alias("anchor"), q.alias("last"))).otherwise(F.struct(F.array_append(s["out"], s["last"]).alias("out"), s["last"].alias("anchor"), q.alias("last")))

    return F.when(F.size(p) < 3, p).otherwise(F.aggregate(F.slice(p, F.lit(2), F.size(p) - 1), start, step, lambda s: F.array_append(s["out"], s["last"])))
