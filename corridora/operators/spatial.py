"""Nearest points, snapping, polygons, transforms, fits and clusters."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import similarity
from . import tree
from .lineage import cut, grown


def nearest(points: DataFrame, x: float, y: float, limit: int = 6) -> DataFrame:
    """The ``limit`` points nearest to one place; the smaller ``ord`` wins ties."""
    return points.withColumn("dist", F.hypot(F.col("x") - x, F.col("y") - y)).orderBy("dist", "ord").limit(limit)


def knn(queries: DataFrame, points: DataFrame, k: int, cell: float) -> DataFrame:
    """(q_id, qx, qy) to each one's k nearest of (p_id, x, y): exact, by rings of grid cells.

    Of points at one place only the k smallest ids can be neighbours, and queries at one place are one. Cells are ``cell``
    wide, or less where points are dense: about even ones then lie a few in a cell. Rings of cells are searched
    outwards; a query is done when it has k points no farther than the ring's inner border. What three rounds leave
    open, beside or far from the points, is told by a tree (:func:`tree.nearest_in_tree`). All joins are by cell.
    """
    same = Window.partitionBy("x", "y").orderBy("p_id")
    kept = cut(points.select("p_id", "x", "y").withColumn("__at", F.row_number().over(same)).where(F.col("__at") <= k).drop("__at"))
    b = kept.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count(F.lit(1))).first()
    area = (b[0] or 0.0) * (b[1] or 0.0)
    if 0 < area < float("inf"):
        cell = min(cell, math.sqrt(area * max(k, 4) / b[2]))
    placed = kept.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    place, done = ["qx", "qy"], []
    open_ = cut(queries.select(*place).distinct())
    rank = Window.partitionBy(*place).orderBy("dist", "p_id")
    for reach in (1, 2, 4):
        side = F.sequence(F.lit(-reach), F.lit(reach))
        probes = open_.withColumn("i", F.explode(side)).withColumn("j", F.explode(side)).select(*place, (F.floor(F.col("qx") / cell) + F.col("i")).alias("cx"), (F.floor(F.col("qy") / cell) + F.col("j")).alias("cy"))
        found = probes.join(grown(placed), ["cx", "cy"]).withColumn("dist", F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")))
        best = cut(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(*place, "p_id", "dist", "rank"))
        sure = best.groupBy(*place).agg(F.count(F.lit(1)).alias("m"), F.max("dist").alias("far")).where((F.col("m") >= min(k, b[2])) & (F.col("far") <= reach * cell)).select(*place)
        done.append(best.join(grown(sure), place, "left_semi"))
        open_ = cut(open_.join(grown(sure), place, "left_anti"), open_)
        if open_.isEmpty():
            break
    else:
        rest = tree.nearest_in_tree(open_.withColumn("q_id", F.struct(*place)), tree.point_tree(kept, k))
        done.append(rest.select("q_id.*", "p_id", "dist", "rank"))
    return queries.select("q_id", *place).join(grown(functools.reduce(DataFrame.union, done)), place).select("q_id", "p_id", "dist", "rank")


def snap_key(dx: Column, dy: Column) -> Column:
    """Orders cells around a centre: by Chebyshev ring, then along the ring (rows before columns)."""
    ring = F.greatest(F.abs(dx), F.abs(dy))
    along = F.least(
        F.when(dy == -ring, F.struct(dx.alias("o"), F.lit(0).alias("side"))), F.when(dy == ring, F.struct(dx.alias("o"), F.lit(1).alias("side"))),
        F.when(dx == -ring, F.struct(dy.alias("o"), F.lit(2).alias("side"))), F.when(dx == ring, F.struct(dy.alias("o"), F.lit(3).alias("side"))),
    )
    return F.struct(ring.alias("ring"), along.alias("along"))


def snap(places: DataFrame, cells: DataFrame, cell_size: float, *, max_ring: int = 45, prefer_public: bool = True) -> DataFrame:
    """(place_id, floor, x, y) to the walkable cell each stands on or nearest to it.

    cells (floor, r, c, walk, pub, net). A public cell of the network is preferred, then any cell of
    the network, then any walkable cell; within a class the first ring wins. The places are the small side.
    """
    here = places.withColumns({"pr": F.floor(F.col("y") / cell_size), "pc": F.floor(F.col("x") / cell_size)})
    block = max_ring + 1
    tiles = here.withColumn("i", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("j", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    tiles = tiles.withColumns({"tr": F.floor(F.col("pr") / block) + F.col("i"), "tc": F.floor(F.col("pc") / block) + F.col("j")})
    ground = cells.where("walk").withColumns({"tr": F.floor(F.col("r") / block), "tc": F.floor(F.col("c") / block)})
    near = ground.join(tiles.select("place_id", "floor", "pr", "pc", "tr", "tc"), ["floor", "tr", "tc"])
    dx, dy = F.col("c") - F.col("pc"), F.col("r") - F.col("pr")
    near = near.where(F.greatest(F.abs(dx), F.abs(dy)) <= max_ring)
    kind = F.when(F.col("net") & F.col("pub") & F.lit(prefer_public), 0).when(F.col("net"), 1).otherwise(2)
    best = near.groupBy("place_id").agg(F.min_by(F.struct("r", "c"), F.struct(kind.alias("k"), snap_key(dx, dy).alias("s"))).alias("cell"))
    return best.select("place_id", "cell.r", "cell.c")


def inside(points: DataFrame, edges: DataFrame, cell: float = 64.0) -> DataFrame:
    """(p_id, x, y) and polygon edges (poly_id, x1, y1, x2, y2) to (p_id, poly_id) of points inside.

    Even-odd rule. Edges are filed under the rows of a grid that they cross and points join them by
    row, with the polygon's box first: no cross join.
    """
    box = edges.groupBy("poly_id").agg(F.min(F.least("x1", "x2")).alias("bx0"), F.max(F.greatest("x1", "x2")).alias("bx1"))
    low, high = F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell)
    filed = edges.where("y1 != y2").withColumn("row", F.explode(F.sequence(low, high))).join(box, "poly_id")
    placed = points.withColumn("row", F.floor(F.col("y") / cell))
    pairs = placed.join(filed, "row").where((F.col("x") >= F.col("bx0")) & (F.col("x") <= F.col("bx1")) & ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))))
    crosses = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return pairs.groupBy("p_id", "poly_id").agg(F.count_if(crosses).alias("n")).where("n % 2 = 1").select("p_id", "poly_id")


def ring_edges(rings: DataFrame) -> DataFrame:
    """(poly_id, ring array of (x, y)) to its edges, the last point joined to the first."""
    following = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    e = rings.select("poly_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), following.alias("b"))).alias("e"))
    return e.select("poly_id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def coverage(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """The weighted share of samples (p_id, x, y, weight) inside each polygon."""
    hit = inside(samples, edges).join(samples.select("p_id", "weight"), "p_id").groupBy("poly_id").agg(F.sum("weight").alias("w"))
    total = samples.agg(F.sum("weight").alias("total"))
    return edges.select("poly_id").distinct().join(hit, "poly_id", "left").join(F.broadcast(total)).select("poly_id", F.coalesce(F.col("w") / F.col("total"), F.lit(0.0)).alias("share"))


def pick_floor(cover: DataFrame, current: int) -> DataFrame:
    """(idx, share) to the floor in view: the largest share, the one nearest to ``current`` on ties;
    a change needs a share of 0.2, and 1.4 times and 0.12 over the current one's."""
    best = cover.agg(F.min_by(F.struct("idx", "share"), F.struct((-F.col("share")).alias("s"), F.abs(F.col("idx") - current).alias("d"), "idx")).alias("b"), F.coalesce(F.max(F.when(F.col("idx") == current, F.col("share"))), F.lit(0.0)).alias("mine"))
    change = (F.col("b.share") >= 0.2) & (F.col("b.share") >= F.greatest(1.4 * F.col("mine"), F.col("mine") + 0.12))
    return best.select(F.when(change, F.col("b.idx")).otherwise(F.lit(current)).alias("idx"))


def fit_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ax, ay, bx, by) to the least-squares similarity a to b: n, scale, angle, tx, ty.

    Null where fewer than two pairs or no spread in a. Centred sums, in one aggregation over sums
    and products, so partial sums combine before the shuffle.
    """
    s = {n: F.sum(e).alias(n) for n, e in {"ax_": F.col("ax"), "ay_": F.col("ay"), "bx_": F.col("bx"), "by_": F.col("by"), "aa": F.col("ax") ** 2 + F.col("ay") ** 2, "dot": F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"), "cross": F.col("ax") * F.col("by") - F.col("ay") * F.col("bx")}.items()}
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *s.values())
    n = F.col("n")
    spread = F.col("aa") - (F.col("ax_") ** 2 + F.col("ay_") ** 2) / n
    dot = F.col("dot") - (F.col("ax_") * F.col("bx_") + F.col("ay_") * F.col("by_")) / n
    cross = F.col("cross") - (F.col("ax_") * F.col("by_") - F.col("ay_") * F.col("bx_")) / n
    ok = (n >= 2) & (spread > 1e-9)
    fit = g.select(*keys, "n", "ax_", "ay_", "bx_", "by_", F.when(ok, F.hypot(dot, cross) / spread).alias("scale"), F.when(ok, F.atan2(cross, dot)).alias("angle"))
    mx, my = similarity(F.col("ax_") / n, F.col("ay_") / n, "scale", "angle", F.lit(0.0), F.lit(0.0))
    return fit.select(*keys, "n", "scale", "angle", (F.col("bx_") / n - mx).alias("tx"), (F.col("by_") / n - my).alias("ty"))


def fit_pinned(pairs: DataFrame, keys: list[str], angle: float = 0.0) -> DataFrame:
    """(keys, ax, ay, bx, by) to the least-squares scale and shift a to b with the turn given: n, scale, angle, tx, ty.

    A scale of 1 where a has no spread; null with fewer than two pairs.
    """
    x, y = similarity("ax", "ay", F.lit(1.0), F.lit(float(angle)), F.lit(0.0), F.lit(0.0))
    turned = pairs.withColumns({"rx": x, "ry": y})
    sums = {"sx": "rx", "sy": "ry", "ox": "bx", "oy": "by", "rr": "rx * rx + ry * ry", "rb": "rx * bx + ry * by"}
    g = turned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in sums.items()])
    spread = F.col("rr") - (F.col("sx") ** 2 + F.col("sy") ** 2) / F.col("n")
    along = F.col("rb") - (F.col("sx") * F.col("ox") + F.col("sy") * F.col("oy")) / F.col("n")
    fit = g.withColumn("scale", F.when(F.col("n") >= 2, F.when(spread > 1e-9, along / spread).otherwise(1.0)))
    return fit.select(*keys, "n", "scale", F.lit(float(angle)).alias("angle"), ((F.col("ox") - F.col("scale") * F.col("sx")) / F.col("n")).alias("tx"), ((F.col("oy") - F.col("scale") * F.col("sy")) / F.col("n")).alias("ty"))


def within(words: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """words (read_id, x, y) and points (point_id, px, py) to (read_id, point_id, dist) of pairs up to ``reach`` apart, by tiles."""
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    near = words.withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps)).withColumns({"__tx": F.floor(F.col("x") / reach) + F.col("__i"), "__ty": F.floor(F.col("y") / reach) + F.col("__j")})
    filed = points.select("point_id", "px", "py", F.floor(F.col("px") / reach).alias("__tx"), F.floor(F.col("py") / reach).alias("__ty"))
    dist = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    return near.join(filed, ["__tx", "__ty"]).withColumn("dist", dist).where(F.col("dist") <= reach).select("read_id", "point_id", "dist")


def claims(words: DataFrame, points: DataFrame, owners: DataFrame, near: float = 60.0) -> DataFrame:
    """words (read_id, x, y, pocket, leaky) to (read_id, point_id, dist, claimed): the points up to ``near`` away.

    A word claims the points (pocket, point_id) that own its pocket; in a leaky pocket, which spans
    several rooms, only points up to half of ``near`` away. ``dist`` is null for owners farther off.
    """
    close = within(words, points, near)
    owned = words.where("not leaky").select("read_id", "pocket").join(owners, "pocket").select("read_id", "point_id", F.lit(True).alias("owned"))
    leaky = words.select("read_id", "leaky")
    joined = close.join(owned, ["read_id", "point_id"], "full_outer").join(leaky, "read_id")
    return joined.select("read_id", "point_id", "dist", (F.coalesce("owned", F.lit(False)) | F.col("leaky") & (F.col("dist") <= near / 2)).alias("claimed"))


def shared_names(points: DataFrame) -> DataFrame:
    """(floor, name, x, y) to named pairs of every two floors: floor_a, floor_b, name, ax, ay, bx, by."""
    a = points.select(F.col("floor").alias("floor_a"), "name", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select(F.col("floor").alias("floor_b"), "name", F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(b, "name").where("floor_a != floor_b")


def residuals(pairs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair's distance after the fit."""
    joined = pairs.join(fits, keys)
    mx, my = similarity("ax", "ay", "scale", "angle", "tx", "ty")
    return joined.withColumn("residual", F.hypot(F.col("bx") - mx, F.col("by") - my))


def owner_by_majority(points: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """(p_id, x, y) to the most frequent label of cells (cx, cy, label) within ``reach`` in each axis;
    the smallest label wins ties. Joined by tiles of that size."""
    tile = 2 * reach + 1
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    near = points.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumns({"tx": F.floor(F.col("x") / tile) + F.col("i"), "ty": F.floor(F.col("y") / tile) + F.col("j")})
    filed = cells.where("label != 0").withColumns({"tx": F.floor(F.col("cx") / tile), "ty": F.floor(F.col("cy") / tile)})
    hit = near.join(filed, ["tx", "ty"]).where((F.abs(F.col("cx") - F.col("x")) <= reach) & (F.abs(F.col("cy") - F.col("y")) <= reach))
    counts = hit.groupBy("p_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("p_id").agg(F.min_by("label", F.struct((-F.col("n")).alias("m"), "label")).alias("label"))


def _around(marks: DataFrame, cells: int, to: tuple[str, str] = ("cx", "cy")) -> DataFrame:
    """Rows of cells (cx, cy) filed under all cells up to ``cells`` away, named ``to``."""
    steps = F.sequence(F.lit(-cells), F.lit(cells))
    spread = marks.withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    near = {"__x": F.col("cx") + F.col("__i"), "__y": F.col("cy") + F.col("__j")}
    return spread.withColumns(near).drop("cx", "cy", "__i", "__j").withColumnsRenamed({"__x": to[0], "__y": to[1]})


def stair_links(marks: DataFrame, reach: float = 130.0, max_rounds: int = 10_000) -> DataFrame:
    """Stair marks (grp, ord, floor, x, y) to (grp, link, ord) of the stairwells of each building ``grp``.

    In order, a mark belongs to the first well whose seed lies nearer than ``reach``, and founds one where there is
    none. A well keeps its first mark of each floor; wells of one mark drop out, and the others are numbered by
    their seeds. Marks of no finite place belong nowhere; of marks at one place and floor only the first counts.

    Seeds are told in rounds: a mark is one as soon as no earlier mark within reach is open. A cell is so small
    that it holds one seed at most, so a round compares a mark with no more than the first open marks, and the
    seeds, of the 25 cells around, however many marks a building or a cell has. Rounds follow the longest chain of
    neighbours in ascending order, for marks in no spatial order about the logarithm of their number.
    """
    side = 0.7 * reach
    place = [F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")]
    finite = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    placed = cut(marks.where(finite).groupBy("grp", "floor", "x", "y").agg(F.min("ord").alias("ord")).select("grp", *place, F.struct("ord", "floor", "x", "y").alias("m")))
    cell = ["grp", "cx", "cy"]

    def near(a: str, b: str) -> Column:
        return F.hypot(F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")) < reach

    def on(a: DataFrame, b: DataFrame, also: Column) -> Column:
        return (a["grp"] == b["grp"]) & (a["cx"] == b["cx"]) & (a["cy"] == b["cy"]) & also

    open_, kept = placed, []
    for _ in range(max_rounds):
        first = open_.groupBy(*cell).agg(F.min("m").alias("m"))
        probes = _around(first.select("grp", F.col("m").alias("lead"), "cx", "cy", F.col("cx").alias("lx"), F.col("cy").alias("ly")), 2)
        blocked = probes.join(open_, on(probes, open_, near("lead", "m") & (F.col("m") < F.col("lead"))), "left_semi")
        seeds = first.join(blocked.select("grp", F.col("lx").alias("cx"), F.col("ly").alias("cy")), cell, "left_anti")
        reached = _around(seeds.withColumnRenamed("m", "lead"), 2)
        left = open_.join(reached, on(open_, reached, near("lead", "m")), "left_anti")
        told = cut(seeds.select(*cell, "m", F.lit(True).alias("seed")).union(left.select(*cell, "m", F.lit(False))))
        kept.append(told)
        open_ = told.where("not seed")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"stair marks have not settled after {max_rounds} rounds")
    wells = _around(functools.reduce(DataFrame.union, kept).where("seed").select(*cell, F.col("m").alias("lead")), 2)
    # the first well within reach of each mark, then the first mark of each floor
    mine = placed.join(wells, cell).where(near("lead", "m")).groupBy("grp", "m").agg(F.min("lead").alias("lead"))
    members = mine.groupBy("grp", "lead", F.col("m.floor").alias("floor")).agg(F.min("m.ord").alias("ord"))
    members = cut(members.select("grp", "lead", "ord"), placed, *kept)
    # seeds keep their distance, so a building has few of them to number
    links = members.groupBy("grp", "lead").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    links = links.select("grp", "lead", (F.row_number().over(Window.partitionBy("grp").orderBy("lead")) - 1).alias("link"))
    return members.join(links, ["grp", "lead"]).select("grp", "link", "ord")
