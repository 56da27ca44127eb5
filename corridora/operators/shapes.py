"""Rings: chained from unit edges, simplified, nested; rooms assembled from pockets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import signed_area
from . import graph, spatial
from .lineage import cut

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def rings(edges: DataFrame) -> DataFrame:
    """Directed edges (layer, x1, y1, x2, y2) to rings (layer, ring_id, ring), corners only.

    At a corner with several ways on, the sharpest turn to the inside is taken, so touching rings stay apart.
    Positions along a ring come from pointer doubling: the rounds are the logarithm of its length.
    """
    e = cut(edges.select("layer", "x1", "y1", "x2", "y2", F.monotonically_increasing_id().alias("id")))  # written: the numbers stay
    following = e.select("layer", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("id").alias("next"))
    ax, ay, bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2")
    turn = F.atan2((ax * by - ay * bx).cast("double"), (ax * bx + ay * by).cast("double"))
    nxt = cut(e.join(following, ["layer", "x2", "y2"]).groupBy("id").agg(F.min_by("next", F.struct((-turn).alias("t"), "x3", "y3")).alias("next")))
    named = graph.components(nxt.select("id"), nxt.select(F.col("id").alias("a"), F.col("next").alias("b")))
    place = F.struct("layer", "x1", "y1", "x2", "y2")
    placed = cut(e.join(named, "id").select("id", "component", place.alias("e")))
    first = placed.groupBy("component").agg(F.min("e").alias("ring_id"), F.min_by("id", "e").alias("first"))
    # steps from each edge to its ring's first edge; that edge itself ends the walk
    at_end = F.col("id") == F.col("first")
    hop = nxt.join(placed, "id").join(first, "component").select("id", "first", F.when(at_end, F.col("id")).otherwise(F.col("next")).alias("to"), F.when(at_end, 0).otherwise(1).alias("d"))
    hop = cut(hop)
    while not hop.where(F.col("to") != F.col("first")).isEmpty():
        far = hop.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        hop = cut(hop.join(far, "to").select("id", "first", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d")), hop)
    point = F.struct((-F.col("d")).alias("k"), F.col("e.x1").cast("double").alias("x"), F.col("e.y1").cast("double").alias("y"))
    listed = hop.join(placed, "id").groupBy("first").agg(F.sort_array(F.collect_list(point)).alias("p"), F.min("e").alias("ring_id"))
    plain = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return listed.select(F.col("ring_id.layer").alias("layer"), "ring_id", corners(plain).alias("ring"))


def corners(ring: Column) -> Column:
    """A ring without points that lie straight between their neighbours."""
    n = F.size(ring)

    def bends(q: Column, i: Column) -> Column:
        a, b = F.get(ring, F.pmod(i + n - 1, n)), F.get(ring, F.pmod(i + 1, n))
        return (q["x"] - a["x"]) * (b["y"] - q["y"]) != (q["y"] - a["y"]) * (b["x"] - q["x"])

    return F.filter(ring, bends)


def _reduce(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Keeps the farthest point of a stretch while it is off the chord by more than ``tolerance``."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    open_ = [(0, len(points) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        chord, off = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*chord)
        away = np.abs(chord[0] * off[:, 1] - chord[1] * off[:, 0]) / length if length > 0 else np.hypot(off[:, 0], off[:, 1])
        far = int(away.argmax())
        if away[far] > tolerance:
            keep[a + 1 + far] = True
            open_ += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplify(ring: Column | str, tolerance: float = 2.2) -> Column:
    """A ring of fewer points, nowhere farther than ``tolerance``: split at the two points that are
    farthest apart from the first, then reduced stretch by stretch."""

    @F.arrow_udf(RING)
    def cut(values: pa.Array) -> pa.Array:
        out = []
        for r in values.to_pylist():
            if r is None or len(r) < 5:
                out.append(r)
                continue
            p = np.array([(q["x"], q["y"]) for q in r])
            p = np.vstack([p, p[:1]])
            half = int(np.hypot(*(p - p[0]).T).argmax())
            keep = np.zeros(len(p), dtype=bool)
            keep[: half + 1] |= _reduce(p[: half + 1], tolerance)
            keep[half:] |= _reduce(p[half:], tolerance)
            out.append([r[i] for i in np.flatnonzero(keep[:-1])])
        return pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return cut(F.col(ring) if isinstance(ring, str) else ring)


def _straight(points: np.ndarray, merge: float, snap: float, most: float, least: float) -> np.ndarray:
    """A ring's points with nearly straight corners taken out and edges near a multiple of 45 degrees made exact."""

    def turns(p: np.ndarray) -> np.ndarray:
        edge = np.roll(p, -1, axis=0) - p
        bearing = np.arctan2(edge[:, 1], edge[:, 0])
        return np.abs((np.degrees(bearing - np.roll(bearing, 1)) + 180) % 360 - 180)

    while len(points) > 3 and (bend := turns(points)).min() <= merge:
        points = np.delete(points, int(bend.argmin()), axis=0)
    edge = np.roll(points, -1, axis=0) - points
    bearing = np.degrees(np.arctan2(edge[:, 1], edge[:, 0]))
    exact = np.round(bearing / 45) * 45
    bearing = np.radians(np.where(np.abs(bearing - exact) <= snap, exact, bearing))
    way, middle = np.stack([np.cos(bearing), np.sin(bearing)], axis=1), points + edge / 2
    # a corner is where its two edges' lines meet, unless that is far from the point or they are parallel
    before, start = np.roll(way, 1, axis=0), np.roll(middle, 1, axis=0)
    area = before[:, 0] * way[:, 1] - before[:, 1] * way[:, 0]
    gap = middle - start
    t = (gap[:, 0] * way[:, 1] - gap[:, 1] * way[:, 0]) / np.where(np.abs(area) < 1e-6, 1.0, area)
    met = start + before * t[:, None]
    near = (np.abs(area) >= 1e-6) & (np.hypot(*(met - points).T) <= most)
    corners_ = np.where(near[:, None], met, points)
    kept: list[np.ndarray] = []
    for p in corners_:
        if not kept or np.hypot(*(p - kept[-1])) >= least:
            kept.append(p)
    if len(kept) > 1 and np.hypot(*(kept[0] - kept[-1])) < least:
        kept.pop()
    return np.array(kept)


def straighten(ring: Column | str, *, tolerance: float = 2.2, merge: float = 8.0, snap: float = 7.0, most: float = 6.0, least: float = 3.0) -> Column:
    """A simplified ring whose edges are straight: corners of up to ``merge`` degrees are taken out, edges
    within ``snap`` degrees of a multiple of 45 turned to it (corners move up to ``most``), edges under
    ``least`` dropped. An empty ring if fewer than three points stay."""

    @F.arrow_udf(RING)
    def tidy(values: pa.Array) -> pa.Array:
        out = []
        for r in values.to_pylist():
            points = np.array([(q["x"], q["y"]) for q in r]) if r else np.zeros((0, 2))
            points = _straight(points, merge, snap, most, least) if len(points) > 2 else points
            out.append(None if r is None else [{"x": x, "y": y} for x, y in points.tolist()] if len(points) > 2 else [])
        return pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return tidy(simplify(ring, tolerance))


def clip_ring(ring: Column | str, box: tuple[float, float, float, float]) -> Column:
    """The part of a ring inside (x0, y0, x1, y1), cut side by side; an empty array if nothing is."""
    sides = [F.struct(F.lit(across).alias("across"), F.lit(float(limit)).alias("limit"), F.lit(sign).alias("sign")) for across, limit, sign in ((True, box[0], 1.0), (True, box[2], -1.0), (False, box[1], 1.0), (False, box[3], -1.0))]
    points = F.coalesce(F.col(ring) if isinstance(ring, str) else ring, F.array()).cast("array<struct<x:double,y:double>>")
    return F.aggregate(F.array(*sides), points, _half_plane)


def _half_plane(ring: Column, side: Column) -> Column:
    """The ring's points on the inner side of a line, and where it crosses the line."""
    on = lambda p: F.when(side["across"], p["x"]).otherwise(p["y"])
    along = lambda p: F.when(side["across"], p["y"]).otherwise(p["x"])
    inner = lambda p: (on(p) - side["limit"]) * side["sign"] >= 0
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))

    def step(a: Column, b: Column) -> Column:
        at = along(a) + (along(b) - along(a)) * (side["limit"] - on(a)) / F.nullif(on(b) - on(a), F.lit(0.0))
        cross = F.struct(F.when(side["across"], side["limit"]).otherwise(at).alias("x"), F.when(side["across"], at).otherwise(side["limit"]).alias("y"))
        return F.filter(F.array(F.when(inner(a) != inner(b), cross), F.when(inner(b), b)), lambda p: p.isNotNull())

    return F.when(F.size(ring) == 0, ring).otherwise(F.flatten(F.zip_with(before, ring, step)))


def clip_segments(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Segments (x1, y1, x2, y2, ...) cut to the box; those outside of it drop out."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    ok = F.lit(True)
    for start, step, lo, hi in (("x1", dx, box[0], box[2]), ("y1", dy, box[1], box[3])):
        a, b = (F.lit(lo) - F.col(start)) / F.nullif(step, F.lit(0.0)), (F.lit(hi) - F.col(start)) / F.nullif(step, F.lit(0.0))
        low.append(F.coalesce(F.least(a, b), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(a, b), F.lit(1.0)))
        ok = ok & ((step != 0) | F.col(start).between(lo, hi))
    t = segments.withColumns({"__a": F.greatest(*low), "__b": F.least(*high), "__ok": ok}).where("__ok and __a <= __b")
    at = lambda c, d, k: F.col(c) + d * F.col(k)
    return t.withColumns({"x1": at("x1", dx, "__a"), "y1": at("y1", dy, "__a"), "x2": at("x1", dx, "__b"), "y2": at("y1", dy, "__b")}).drop("__a", "__b", "__ok")


def combine_polygons(a: DataFrame, b: DataFrame, hows: tuple[str, ...] = ("union", "intersection", "difference")) -> DataFrame:
    """The outlines (how, layer, ring_id, ring) of two sets of polygons (layer, poly_id, ring) together, told on
    cells of one unit: their union, intersection or difference."""
    from . import raster

    def cells(p: DataFrame) -> DataFrame:
        named = p.select("ring", F.struct("layer", F.col("poly_id").alias("pid")).alias("poly_id"))
        return cut(raster.polygon_cells(spatial.ring_edges(named).select("poly_id.layer", "poly_id", "x1", "y1", "x2", "y2")).select(*raster.CELL).distinct())

    one, two = cells(a), cells(b)
    of = {"union": raster.either, "intersection": raster.both, "difference": raster.without}
    tagged = [of[how](one, two).withColumn("layer", F.struct(F.lit(how).alias("how"), "layer")) for how in hows]
    found = rings(raster.boundary_edges(reduce(DataFrame.union, tagged)))
    return found.select("layer.how", "layer.layer", "ring_id", "ring")


def boxes(points: DataFrame, keys: list[str], *, margin: float = 0.0) -> DataFrame:
    """(keys, x0, y0, x1, y1, w, h) around the points (x, y) of each key."""
    g = points.groupBy(*keys).agg((F.min("x") - margin).alias("x0"), (F.min("y") - margin).alias("y0"), (F.max("x") + margin).alias("x1"), (F.max("y") + margin).alias("y1"))
    return g.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})


def frame(bounds: DataFrame, width: float, height: float, *, most: float = 4.0, pad: float = 1.2) -> DataFrame:
    """Boxes with the view that shows each: its middle (cx, cy) and a scale that fits it, padded, up to ``most``."""
    fit = F.least(F.lit(width) / (F.greatest("w", F.lit(1.0)) * pad), F.lit(height) / (F.greatest("h", F.lit(1.0)) * pad), F.lit(float(most)))
    return bounds.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "scale": fit})


def floor_in_view(samples: DataFrame, outlines: DataFrame, current: int) -> DataFrame:
    """The floor (idx) that a view's samples (p_id, x, y, weight) show: coverage of each floor's outlines
    (idx, poly_id, ring), then the choice that does not flicker."""
    edges = spatial.ring_edges(outlines.withColumn("poly_id", F.struct("idx", "poly_id")))
    share = spatial.coverage(samples, edges).groupBy(F.col("poly_id.idx").alias("idx")).agg(F.sum("share").alias("share"))
    return spatial.pick_floor(share, current)


def hole_owners(outers: DataFrame, holes: DataFrame) -> DataFrame:
    """(hole_id, poly_id): the smallest outer ring (poly_id, ring) that contains each hole (hole_id, ring)."""
    points = holes.select(F.col("hole_id").alias("p_id"), ((F.get("ring", F.lit(0))["x"] + F.get("ring", F.lit(1))["x"]) / 2).alias("x"), ((F.get("ring", F.lit(0))["y"] + F.get("ring", F.lit(1))["y"]) / 2).alias("y"))
    area = outers.select("poly_id", F.abs(signed_area("ring")).alias("area"))
    inside = spatial.inside(points, spatial.ring_edges(outers)).join(area, "poly_id")
    return inside.groupBy(F.col("p_id").alias("hole_id")).agg(F.min_by("poly_id", F.struct("area", "poly_id")).alias("poly_id"))


def assemble_rooms(owners: DataFrame, pockets: DataFrame, most: int = 120_000) -> DataFrame:
    """owners (p_id, label) and pockets (label, area) to (label, area, kind, p_id).

    A pocket with one owner and up to ``most`` pixels is that room; with several owners or more
    pixels it is merged space; without an owner it is unclaimed.
    """
    owned = owners.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("p_id").alias("p_id"))
    j = pockets.join(owned, "label", "left")
    kind = F.when(F.col("n").isNull(), "unclaimed").when((F.col("n") > 1) | (F.col("area") > most), "merged").otherwise("room")
    return j.select("label", "area", kind.alias("kind"), F.when(kind == "room", F.col("p_id")).alias("p_id"))


def corridors(rooms: DataFrame, limit: int = 60, least: int = 1200) -> DataFrame:
    """The largest unclaimed pockets; the cap counts merged ones too, which are not listed."""
    return rooms.where((F.col("kind") != "room") & (F.col("area") >= least)).orderBy(F.col("area").desc(), "label").limit(limit).where("kind = 'unclaimed'")


def moved_points(points: DataFrame, moves: DataFrame) -> DataFrame:
    """points (floor, id, x, y, kind, label) after moves (floor, id, action move|drop|promote, to_floor,
    scale, angle, tx, ty, label): transformed to another floor, dropped, or made a landmark."""
    from ..functions.geometry import similarity

    m = moves.select("floor", "id", "action", "to_floor", "scale", "angle", "tx", "ty", F.col("label").alias("new_label"))
    j = points.join(m, ["floor", "id"], "left").where("action is null or action != 'drop'")
    x, y = similarity("x", "y", "scale", "angle", "tx", "ty")
    goes, up = F.col("action") == "move", F.col("action") == "promote"
    return j.select(F.when(goes, F.col("to_floor")).otherwise(F.col("floor")).alias("floor"), "id", F.when(goes, x).otherwise(F.col("x")).alias("x"), F.when(goes, y).otherwise(F.col("y")).alias("y"), F.when(up, "landmark").otherwise(F.col("kind")).alias("kind"), F.coalesce("new_label", "label").alias("label"))


def anchor_steps(steps: DataFrame, spine: DataFrame, reach: float = 50.0) -> DataFrame:
    """steps (route_id, step, leg, x, y) to the spine vertex (route_id, leg, seq, x, y, cum) nearest within
    the leg; if that is farther than ``reach``, the nearest of the whole spine. The first wins ties."""
    v = spine.select("route_id", F.col("leg").alias("v_leg"), "seq", F.col("x").alias("vx"), F.col("y").alias("vy"), "cum")
    pairs = steps.join(v, "route_id").withColumn("d", F.hypot(F.col("vx") - F.col("x"), F.col("vy") - F.col("y")))
    pick = lambda cond: F.min_by(F.struct("seq", "cum", "d"), F.when(cond, F.struct("d", "seq")))
    best = pairs.groupBy("route_id", "step").agg(pick(F.col("v_leg") == F.col("leg")).alias("own"), pick(F.lit(True)).alias("any"))
    chosen = F.when(F.col("own.d") <= reach, F.col("own")).otherwise(F.col("any"))
    return best.select("route_id", "step", chosen.alias("c")).select("route_id", "step", "c.seq", "c.cum")


def lift(points: DataFrame, heights: DataFrame, risers: int = 10) -> DataFrame:
    """points (route_id, leg, seq, floor, x, y) to a spine in space: each leg at its floor's height and
    ``risers`` points between two legs; points nearer than 1e-4 to the one before drop out."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("route_id").orderBy("leg", "seq", "riser")
    flat = points.join(F.broadcast(heights.select("floor", "z")), "floor").withColumn("riser", F.lit(0))
    ends = Window.partitionBy("route_id").orderBy("leg", "seq")
    step = flat.withColumns({"nx": F.lead("x").over(ends), "ny": F.lead("y").over(ends), "nz": F.lead("z").over(ends), "nl": F.lead("leg").over(ends)}).where("nl != leg")
    t = F.col("riser") / F.lit(risers + 1.0)
    rise = step.withColumn("riser", F.explode(F.sequence(F.lit(1), F.lit(risers))))
    rise = rise.select("route_id", "leg", "seq", "riser", (F.col("x") + (F.col("nx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("ny") - F.col("y")) * t).alias("y"), (F.col("z") + (F.col("nz") - F.col("z")) * t).alias("z"))
    whole = flat.select("route_id", "leg", "seq", "riser", "x", "y", "z").unionByName(rise)
    d = F.sqrt((F.col("x") - F.lag("x").over(order)) ** 2 + (F.col("y") - F.lag("y").over(order)) ** 2 + (F.col("z") - F.lag("z").over(order)) ** 2)
    first = F.row_number().over(order) == 1
    kept = whole.withColumns({"d": F.coalesce(d, F.lit(0.0)), "first": first}).where("first or d >= 1e-4").drop("first")
    return kept.withColumn("cum", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("d")


def view_samples(frames: DataFrame, columns: int = 16, rows: int = 12, sigma: float = 0.3) -> DataFrame:
    """Frames (view_id, cx, cy, width, height) to a grid of samples of each: (view_id, i, j, x, y, weight), their
    weights Gaussian about the frame's middle."""
    each = frames.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    u, v = (F.col("i") + 0.5) / columns * 2 - 1, (F.col("j") + 0.5) / rows * 2 - 1
    weight = F.exp(-(u * u + v * v) / (2 * sigma * sigma))
    return each.select("view_id", "i", "j", (F.col("cx") + u * F.col("width") / 2).alias("x"), (F.col("cy") + v * F.col("height") / 2).alias("y"), weight.alias("weight"))
