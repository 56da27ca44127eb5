"""Raster operators over cell tables (layer, r, c, ...): set semantics, so masks are rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .lineage import cut, grown, release

CELL = ["layer", "r", "c"]


def _shifted(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    return mask.select(*CELL).withColumn("s", F.explode(steps)).select("layer", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"))


def disc(radius: float) -> list[tuple[int, int]]:
    """Offsets within ``radius``."""
    n = math.floor(radius)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= radius * radius]


def dilate(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Cells that an offset from a cell of the mask reaches."""
    return _shifted(mask, offsets).distinct()


def erode(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Cells from which every offset lands in the mask: counted, as each lands at most once."""
    back = [(-i, -j) for i, j in offsets]
    return _shifted(mask, back).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(offsets)).select(*CELL)


def closing(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    return erode(dilate(mask, offsets), offsets)


def opening(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(mask, offsets), offsets)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of both masks."""
    return a.select(*CELL).join(b.select(*CELL), CELL, "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of one mask or the other."""
    return a.select(*CELL).union(b.select(*CELL)).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of the first mask that the second has not."""
    return a.select(*CELL).join(b.select(*CELL), CELL, "left_anti")


def inverse(mask: DataFrame, page: DataFrame) -> DataFrame:
    """Cells of a page's rectangles (layer, r0, c0, r1, c1) that the mask has not."""
    return without(fill_rectangles(page), mask)


def grow(mask: DataFrame, n: int) -> DataFrame:
    """``n`` dilations by the eight neighbours: a square, along one axis and then the other."""
    return _spread(_spread(mask.select(*CELL), "r", n).distinct(), "c", n).distinct()


def _spread(cells: DataFrame, axis: str, n: int) -> DataFrame:
    """Each row at all places up to ``n`` away along an axis."""
    return cells.withColumn("__d", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn(axis, F.col(axis) + F.col("__d")).drop("__d")


def shrink(mask: DataFrame, n: int) -> DataFrame:
    """``n`` erosions by the eight neighbours, along one axis and then the other."""
    whole = F.count(F.lit(1)) == 2 * n + 1
    kept = lambda cells: cells.groupBy(*CELL).agg(whole.alias("ok")).where("ok").select(*CELL)
    return kept(_spread(kept(_spread(mask.select(*CELL).distinct(), "r", n)), "c", n))


def seal(mask: DataFrame, n: int) -> DataFrame:
    """A closing by a square of ``n`` cells on each side."""
    return shrink(grow(mask, n), n)


def density(cells: DataFrame, reach: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, layer, r, c, share): the share of set cells in the square of ``reach`` around; 0 is not listed."""
    keys = [*(keys or []), *CELL]
    moved = lambda df, axis: _spread(df, axis, reach).groupBy(*keys).agg(F.sum("n").alias("n"))
    summed = moved(moved(cells.select(*keys).distinct().withColumn("n", F.lit(1)), "r"), "c")
    return summed.select(*keys, (F.col("n") / float((2 * reach + 1) ** 2)).alias("share"))


def line_offsets(angle: float, length: int) -> list[tuple[int, int]]:
    """The cells (row, column) of a straight line of ``length`` about the origin."""
    t, half = math.radians(angle), (length - 1) / 2
    return sorted({(round(s * math.sin(t)), round(s * math.cos(t))) for s in (k / 3 - half for k in range(3 * length - 2))})


def line_openings(mask: DataFrame, length: int = 31, angles: int = 12) -> DataFrame:
    """(angle, layer, r, c): cells of the mask on a whole line of ``length``, for each of ``angles`` directions (numbered)."""
    lines = [line_offsets(180.0 * k / angles, length) for k in range(angles)]
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, line in enumerate(lines) for i, j in line])
    many = F.element_at(F.array(*[F.lit(len(line)) for line in lines]), F.col("angle") + 1)
    spread = mask.select(*CELL).distinct().withColumn("s", F.explode(steps))
    centres = spread.groupBy(F.col("s.k").alias("angle"), "layer", (F.col("r") - F.col("s.i")).alias("r"), (F.col("c") - F.col("s.j")).alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == many)
    back = centres.withColumn("s", F.explode(F.filter(steps, lambda s: s["k"] == F.col("angle"))))
    return back.select("angle", "layer", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c")).distinct()


def hatching(ink: DataFrame, lines: DataFrame, *, reach: int = 60, strong: float = 0.045, dense: float = 0.07, crossed: float = 0.25, link: int = 10, core: int = 15, least: int = 40_000, spread: int = 14, angles: int = 12) -> DataFrame:
    """Fields of parallel ruling: where one direction's lines (angle, layer, r, c) are dense, those of
    directions a quarter turn and more apart are not, and ink is dense. Small fields drop out."""
    d = density(lines, reach, ["angle"])
    best = d.groupBy(*CELL).agg(F.max(F.struct("share", (-F.col("angle")).alias("a"))).alias("b")).select(*CELL, F.col("b.share").alias("best"), (-F.col("b.a")).alias("main"))
    apart = F.abs(F.col("angle") - F.col("main"))
    far = F.least(apart, angles - apart) >= angles // 4
    cross = d.join(best, CELL).groupBy(*CELL, "best").agg(F.coalesce(F.max(F.when(far, F.col("share"))), F.lit(0.0)).alias("cross"))
    inked = density(ink, reach).where(F.col("share") > dense)
    field = cross.where((F.col("best") > strong) & (F.col("cross") < crossed * F.col("best"))).join(inked.select(*CELL), CELL, "left_semi")
    whole = despeckle(shrink(fill_holes(seal(field, link)), core), least, eight=False)
    return grow(whole, core + spread)


def storey(ink: DataFrame, lines: DataFrame, points: DataFrame, *, reach: int = 60, dense: float = 0.02, near: int = 45, link: int = 30, spread: int = 22) -> DataFrame:
    """The part of a page that is drawn in detail: dense short ink near a known point (layer, r, c)."""
    detail = without(ink, grow(lines, 2))
    seeds = label(density(detail, reach).where(F.col("share") > dense))
    kept = seeds.join(grow(points, near), CELL, "left_semi").select("layer", "component").distinct()
    return grow(fill_holes(seal(seeds.join(kept, ["layer", "component"], "left_semi"), link)), spread)


def clean_ink(ink: DataFrame, least: int = 6) -> DataFrame:
    """Ink without specks, its gaps of a cell closed."""
    return seal(despeckle(ink, least, eight=True), 1)


def page_footprint(ink: DataFrame, reach: int = 14) -> DataFrame:
    """What a page's ink encloses: grown together, filled, shrunk again; the largest part of each layer."""
    return largest(shrink(fill_holes(grow(ink, reach)), reach))


def footprint(walls: DataFrame, storey_mask: DataFrame, *, link: int = 22, least: int = 120_000, clear: int = 24, court: int = 90_000) -> DataFrame:
    """A storey's solid slab: sealed, filled, without parts under ``least`` cells; courts of ``court`` cells
    or more that hold no wall within ``clear`` and are not of the storey are open."""
    solid = despeckle(fill_holes(seal(storey_mask, link)), least)
    voids = without(without(solid, grow(walls, clear)), storey_mask)
    return without(solid, despeckle(voids, court))


def polygon_cells(edges: DataFrame) -> DataFrame:
    """Polygon edges (layer, poly_id, x1, y1, x2, y2) to the cells whose centres lie inside (even-odd): (layer, poly_id, r, c).

    An edge is met by the rows whose centre line it crosses; a row's crossings pair up from left to right.
    """
    top, bottom = F.ceil(F.least("y1", "y2") - 0.5), F.ceil(F.greatest("y1", "y2") - 0.5) - 1
    rows = edges.withColumns({"__top": top, "__bottom": bottom}).where("__top <= __bottom").withColumn("r", F.explode(F.sequence("__top", "__bottom")))
    x = F.col("x1") + (F.col("r") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    met = rows.groupBy("layer", "poly_id", "r").agg(F.sort_array(F.collect_list(x)).alias("x"))
    runs_ = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda i: F.struct(F.ceil(F.get("x", 2 * i) - 0.5).alias("a"), (F.ceil(F.get("x", 2 * i + 1) - 0.5) - 1).alias("b")))
    spans = met.where(F.size("x") > 1).withColumn("s", F.explode(runs_)).where("s.a <= s.b")
    return spans.select("layer", "poly_id", "r", F.explode(F.sequence("s.a", "s.b")).alias("c"))


def box_cells(boxes: DataFrame, scale: float = 1.0) -> DataFrame:
    """Boxes (layer, x, y, w, h) to the cells that they touch after scaling, one at least each."""
    lo = lambda c: F.floor(F.col(c) * scale).cast("long")
    hi = lambda c, d: F.greatest(F.ceil((F.col(c) + F.col(d)) * scale).cast("long") - 1, lo(c))
    return fill_rectangles(boxes.select("layer", lo("y").alias("r0"), lo("x").alias("c0"), hi("y", "h").alias("r1"), hi("x", "w").alias("c1")))


def near_wall(cells: DataFrame) -> DataFrame:
    """cells (layer, r, c, walk) with ``near_wall``: the cell or one of its eight neighbours is not
    walkable or off the grid (a chamfer clearance below 2)."""
    free = cells.where("walk")
    ring = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    open_ = erode(free, ring).withColumn("open", F.lit(True))
    return cells.join(grown(open_), CELL, "left").withColumn("near_wall", F.col("open").isNull()).drop("open")


def derived_planes(cells: DataFrame) -> DataFrame:
    """cells (layer, r, c, walk, east, south) with ``near_wall`` and ``net``: whether the cell is of its
    layer's largest network over open steps (the smallest cell's on ties)."""
    walled = near_wall(cells)
    found = networks(cells)
    size = found.groupBy("layer", "component").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("layer").agg(F.min_by("component", F.struct((-F.col("n")).alias("m"), "component")).alias("component"))
    net = found.join(grown(best), ["layer", "component"], "left_semi").select(*CELL, F.lit(True).alias("net"))
    return walled.join(grown(net), CELL, "left").withColumn("net", F.coalesce("net", F.lit(False)))


def networks(cells: DataFrame) -> DataFrame:
    """cells (layer, r, c, walk, east, south) to (layer, r, c, component): walkable cells joined by open steps.

    Cells of a row that open steps join are one run first, so components are found between runs, named by their first cells.
    """
    order = Window.partitionBy("layer", "r").orderBy("c")
    begins = F.coalesce((F.lag("c").over(order) != F.col("c") - 1) | ~F.lag("east").over(order), F.lit(True))
    walk = cells.where("walk").select(*CELL, F.coalesce("east", F.lit(False)).alias("east"), "south").withColumn("begins", begins)
    walk = cut(walk.withColumn("c0", F.max(F.when(F.col("begins"), F.col("c"))).over(order)).select(*CELL, "south", F.struct("layer", "r", "c0").alias("id")))
    below = walk.select("layer", (F.col("r") - 1).alias("r"), "c", F.col("id").alias("b"))
    joined = walk.where("south").select(*CELL, F.col("id").alias("a")).join(grown(below), CELL).select("a", "b")
    found = graph.components(walk.select("id"), joined)
    found = walk.join(grown(found), "id").select(F.struct(*CELL).alias("id"), F.col("component").alias("run"))
    found = found.select("id", F.struct(F.col("run.layer").alias("layer"), F.col("run.r").alias("r"), F.col("run.c0").alias("c")).alias("component"))
    return found.select("id.*", F.format_string("%s:%d:%d", F.col("component.layer").cast("string"), F.col("component.r").cast("long"), F.col("component.c").cast("long")).alias("component"))


def label(mask: DataFrame, *, eight: bool = False) -> DataFrame:
    """(layer, r, c, component): components over four neighbours, or eight, named by their smallest cell id.

    Rows of cells become runs first, so components are found between runs, not cells.
    """
    flat = runs(mask)
    ident = F.struct("layer", "r", "c0")
    nodes = flat.select(ident.alias("id"), "layer", "r", "c0", "c1")
    below = nodes.select(F.col("id").alias("b"), "layer", (F.col("r") - 1).alias("r"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    touch = nodes.join(below, ["layer", "r"]).where(f"c0 <= d1 + {int(eight)} and d0 <= c1 + {int(eight)}").select(F.col("id").alias("a"), "b")
    found = graph.components(nodes.select("id"), touch)
    cells = nodes.join(found, "id").select("layer", "r", F.explode(F.sequence("c0", "c1")).alias("c"), "component")
    return cells.select("layer", "r", "c", F.format_string("%s:%d:%d", F.col("component.layer").cast("string"), F.col("component.r").cast("long"), F.col("component.c0").cast("long")).alias("component"))


def largest(mask: DataFrame) -> DataFrame:
    """Each layer's largest component; the smallest name on ties."""
    found = label(mask)
    size = found.groupBy("layer", "component").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("layer").agg(F.min_by("component", F.struct((-F.col("n")).alias("m"), "component")).alias("component"))
    return found.join(best, ["layer", "component"], "left_semi").select(*CELL)


def despeckle(mask: DataFrame, least: int, *, eight: bool = False) -> DataFrame:
    """The mask without components of fewer than ``least`` cells."""
    found = label(mask, eight=eight)
    kept = found.groupBy("layer", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.join(kept, ["layer", "component"], "left_semi").select(*CELL)


def runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs of cells: (layer, r, c0, c1). Gaps and islands within a row."""
    order = Window.partitionBy("layer", "r").orderBy("c")
    grouped = mask.select(*CELL).distinct().withColumn("g", F.col("c") - F.row_number().over(order))
    return grouped.groupBy("layer", "r", "g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("g")


def rectangles(mask: DataFrame) -> DataFrame:
    """Equal runs of successive rows merged: (layer, r0, c0, r1, c1)."""
    order = Window.partitionBy("layer", "c0", "c1").orderBy("r")
    grouped = runs(mask).withColumn("g", F.col("r") - F.row_number().over(order))
    return grouped.groupBy("layer", "c0", "c1", "g").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).select("layer", "r0", "c0", "r1", "c1")


def fill_rectangles(boxes: DataFrame) -> DataFrame:
    """The cells of rectangles."""
    rows = boxes.select("layer", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("r"))
    return rows.select("layer", "r", F.explode(F.sequence("c0", "c1")).alias("c")).distinct()


def pool(cells: DataFrame, size: int, value: str = "value") -> DataFrame:
    """Tiles of ``size`` cells: their mean and whether any is set."""
    tile = [F.floor(F.col("r") / size).alias("tr"), F.floor(F.col("c") / size).alias("tc")]
    return cells.groupBy("layer", *tile).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.bool_or(F.col(value).cast("double") > 0).alias("any"))


def walk_grid(pixels: DataFrame, size: int, *, walk_share: float = 0.55, public_share: float = 0.45) -> DataFrame:
    """pixels (layer, r, c, walk, pub) to grid cells with open steps: (layer, r, c, walk, pub, east, south).

    A step to the next cell is open if both are walkable and no pixel between their centres is blocked.
    """
    n = float(size * size)
    tile = pixels.groupBy("layer", F.floor(F.col("r") / size).cast("int").alias("tr"), F.floor(F.col("c") / size).cast("int").alias("tc")).agg((F.count_if("walk") / n >= walk_share).alias("walk"), (F.count_if("pub") / n >= public_share).alias("pub"))
    half = size // 2
    blocked = pixels.where("not walk")
    over = lambda a, b, name: blocked.where(F.pmod(F.col(b), F.lit(size)) == half).select("layer", F.floor((F.col("r") - (half if a == "r" else 0)) / size).cast("int").alias("tr"), F.floor((F.col("c") - (half if a == "c" else 0)) / size).cast("int").alias("tc"), F.lit(True).alias(name)).distinct()
    # the centre line runs from pixel half of a cell to pixel half of the next
    far = lambda a, b, name: blocked.where((F.pmod(F.col(b), F.lit(size)) == half) & (F.pmod(F.col(a), F.lit(size)) == half)).select("layer", (F.floor(F.col("r") / size) - (1 if a == "r" else 0)).cast("int").alias("tr"), (F.floor(F.col("c") / size) - (1 if a == "c" else 0)).cast("int").alias("tc"), F.lit(True).alias(name))
    wall_e = over("c", "r", "wall_e").unionByName(far("c", "r", "wall_e")).distinct()
    wall_s = over("r", "c", "wall_s").unionByName(far("r", "c", "wall_s")).distinct()
    keys = ["layer", "tr", "tc"]
    right = tile.select("layer", "tr", (F.col("tc") - 1).alias("tc"), F.col("walk").alias("walk_e"))
    down = tile.select("layer", (F.col("tr") - 1).alias("tr"), "tc", F.col("walk").alias("walk_s"))
    j = tile.join(right, keys, "left").join(down, keys, "left").join(wall_e, keys, "left").join(wall_s, keys, "left")
    open_ = lambda other, wall: F.col("walk") & F.coalesce(other, F.lit(False)) & wall.isNull()
    return j.select("layer", F.col("tr").alias("r"), F.col("tc").alias("c"), "walk", "pub", open_(F.col("walk_e"), F.col("wall_e")).alias("east"), open_(F.col("walk_s"), F.col("wall_s")).alias("south"))


def fill_holes(mask: DataFrame) -> DataFrame:
    """The mask with everything that the outside of its box cannot reach over four neighbours."""
    box = mask.groupBy("layer").agg((F.min("r") - 1).alias("r0"), (F.max("r") + 1).alias("r1"), (F.min("c") - 1).alias("c0"), (F.max("c") + 1).alias("c1"))
    every = fill_rectangles(box).join(mask.select(*CELL), CELL, "left_anti")
    found = label(every)
    corner = box.select("layer", F.col("r0").alias("r"), F.col("c0").alias("c"))
    outside = found.join(corner, CELL).select("layer", "component")
    holes = found.join(outside, ["layer", "component"], "left_anti").select(*CELL)
    return mask.select(*CELL).unionByName(holes)


def boundary_edges(mask: DataFrame) -> DataFrame:
    """Directed unit edges around the mask, the inside on the right: (layer, x1, y1, x2, y2)."""
    sides = [((-1, 0), (0, 0), (1, 0)), ((0, 1), (1, 0), (1, 1)), ((1, 0), (1, 1), (0, 1)), ((0, -1), (0, 1), (0, 0))]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a[0]).alias("ax"), F.lit(a[1]).alias("ay"), F.lit(b[0]).alias("bx"), F.lit(b[1]).alias("by")) for (i, j), a, b in sides])
    spread = mask.select(*CELL).distinct().withColumn("s", F.explode(steps)).withColumns({"nr": F.col("r") + F.col("s.i"), "nc": F.col("c") + F.col("s.j")})
    other = mask.select("layer", F.col("r").alias("nr"), F.col("c").alias("nc")).distinct()
    edge = spread.join(other, ["layer", "nr", "nc"], "left_anti")
    at = lambda k, b: (F.col(b) + F.col(f"s.{k}"))
    return edge.select("layer", at("ax", "c").alias("x1"), at("ay", "r").alias("y1"), at("bx", "c").alias("x2"), at("by", "r").alias("y2"))


def separators(ink: DataFrame, spaces: DataFrame, reach: int = 5, least: int = 600) -> DataFrame:
    """Ink cells with two different spaces (layer, r, c, component) of ``least`` cells or more within ``reach``."""
    big = spaces.groupBy("layer", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    side = F.sequence(F.lit(-reach), F.lit(reach))
    near = spaces.join(big, ["layer", "component"], "left_semi")
    # in two passes along the axes, as least and greatest name
    along = near.withColumn("i", F.explode(side)).groupBy("layer", (F.col("r") + F.col("i")).alias("r"), "c").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    square = along.withColumn("j", F.explode(side)).groupBy("layer", "r", (F.col("c") + F.col("j")).alias("c")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi")
    return ink.join(square.select(*CELL), CELL, "left_semi")


def overlap_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """(layer, both, n_a, n_b, dice, iou, covered) of two masks."""
    j = a.select(*CELL).withColumn("a", F.lit(1)).join(b.select(*CELL).withColumn("b", F.lit(1)), CELL, "full_outer")
    g = j.groupBy("layer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))
    both = F.col("both").cast("double")
    return g.select("layer", "both", "n_a", "n_b", (2 * both / (F.col("n_a") + F.col("n_b"))).alias("dice"), (both / (F.col("n_a") + F.col("n_b") - both)).alias("iou"), F.when(F.col("n_a") > 0, both / F.col("n_a")).alias("covered"))


def bridges(labelled: DataFrame, wanted: DataFrame, main: DataFrame, reach: int = 5) -> DataFrame:
    """(component, r, c, to_r, to_c): the shortest straight gap of up to ``reach`` cells along a row or
    column from each wanted component (layer, component) to a cell of its layer's main one."""
    here = labelled.join(wanted, ["layer", "component"], "left_semi")
    goal = labelled.join(main, ["layer", "component"], "left_semi").select("layer", F.col("r").alias("to_r"), F.col("c").alias("to_c"))
    step = F.explode(F.sequence(F.lit(-reach - 1), F.lit(reach + 1)))
    along = here.withColumn("d", step).where("d != 0")
    tries = along.select("layer", "component", "r", "c", "d", F.col("r").alias("to_r"), (F.col("c") + F.col("d")).alias("to_c")).unionByName(along.select("layer", "component", "r", "c", "d", (F.col("r") + F.col("d")).alias("to_r"), F.col("c").alias("to_c")))
    hit = tries.join(goal, ["layer", "to_r", "to_c"])
    best = hit.groupBy("layer", "component").agg(F.min_by(F.struct("r", "c", "to_r", "to_c"), F.struct(F.abs("d").alias("a"), "r", "c", "to_r", "to_c")).alias("b"))
    return best.select("layer", "component", "b.*")


def rim(mask: DataFrame) -> DataFrame:
    """Cells of the mask that lack one of their four neighbours in it."""
    return without(mask, erode(mask.select(*CELL).distinct(), [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]))


def shortest_gaps(labelled: DataFrame, wanted: DataFrame, main: DataFrame, reach: float) -> DataFrame:
    """(layer, component, r, c, to_r, to_c): each wanted component's nearest cell of its layer's main one, up
    to ``reach`` away; the first by row and column on ties. Only rims meet, by tiles."""
    tile = math.ceil(reach)
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    edge = labelled.join(rim(labelled.withColumn("layer", F.struct("layer", "component"))).select("layer.layer", "layer.component", "r", "c"), ["layer", "component", "r", "c"], "left_semi")
    here = edge.join(wanted, ["layer", "component"], "left_semi").withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    here = here.withColumns({"tr": F.floor(F.col("r") / tile) + F.col("i"), "tc": F.floor(F.col("c") / tile) + F.col("j")})
    goal = edge.join(main, ["layer", "component"], "left_semi").select("layer", F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    square = (F.col("r") - F.col("to_r")) ** 2 + (F.col("c") - F.col("to_c")) ** 2
    met = here.join(goal, ["layer", "tr", "tc"]).withColumn("d", square).where(F.col("d") <= reach * reach)
    best = met.groupBy("layer", "component").agg(F.min_by(F.struct("r", "c", "to_r", "to_c"), F.struct("d", "r", "c", "to_r", "to_c")).alias("b"))
    return best.select("layer", "component", "b.*")


def _line_points(corners: bool) -> Column:
    """The cells of a straight line from (r, c) to (to_r, to_c); with ``corners`` only straight steps."""
    n = F.greatest(F.abs(F.col("to_r") - F.col("r")), F.abs(F.col("to_c") - F.col("c")), F.lit(1))
    at = lambda a, b, k: F.floor(F.col(a) + (F.col(b) - F.col(a)) * k / n + 0.5).cast("long")
    point = lambda k: F.struct(at("r", "to_r", k).alias("r"), at("c", "to_c", k).alias("c"))
    corner = lambda k: F.struct(at("r", "to_r", k - 1).alias("r"), at("c", "to_c", k).alias("c"))
    k = F.sequence(F.lit(0).cast("long"), n.cast("long"))
    if not corners:
        return F.transform(k, point)
    bent = lambda k: (k > 0) & (at("r", "to_r", k) != at("r", "to_r", k - 1)) & (at("c", "to_c", k) != at("c", "to_c", k - 1))
    return F.flatten(F.transform(k, lambda k: F.when(bent(k), F.array(corner(k), point(k))).otherwise(F.array(point(k)))))


def _largest_and_rest(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    sizes = labelled.groupBy("layer", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("layer").agg(F.min_by("component", F.struct((-F.col("n")).alias("m"), "component")).alias("component"))
    return main, sizes.join(main, ["layer", "component"], "left_anti")


def connect(cells: DataFrame, points: DataFrame, *, reach: float = 5.0, least: int = 12, passes: int = 6) -> DataFrame:
    """cells (layer, r, c, walk, east, south) with short gaps bridged: pockets that hold a point (layer, r, c)
    or have ``least`` cells open a run of cells to the nearest cell of the largest network, pass by pass,
    until none is near enough or ``passes`` are over."""
    now = cut(cells.select(*CELL, "walk", "east", "south"))
    for _ in range(passes):
        found = cut(networks(now))
        main, rest = _largest_and_rest(found)
        held = found.join(points.select(*CELL), CELL, "left_semi").select("layer", "component").distinct()
        wanted = rest.join(held.withColumn("held", F.lit(True)), ["layer", "component"], "left").where((F.col("n") >= least) | F.col("held")).select("layer", "component")
        gaps = cut(shortest_gaps(found, wanted, main, reach))
        if gaps.isEmpty():
            release(found, gaps)
            return now
        path = gaps.withColumn("p", _line_points(corners=True))
        opened = path.select("layer", F.explode("p").alias("q")).select("layer", "q.r", "q.c", F.lit(True).alias("o_walk"), F.lit(False).alias("o_east"), F.lit(False).alias("o_south"))
        pairs = path.select("layer", F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("s"))
        pairs = pairs.where("s.a.r != s.b.r or s.a.c != s.b.c").select("layer", F.least("s.a.r", "s.b.r").alias("r"), F.least("s.a.c", "s.b.c").alias("c"), (F.col("s.a.r") == F.col("s.b.r")).alias("along"))
        opened = opened.unionByName(pairs.select(*CELL, F.lit(True).alias("o_walk"), F.col("along").alias("o_east"), (~F.col("along")).alias("o_south")))
        opened = opened.groupBy(*CELL).agg(*[F.bool_or(c).alias(c) for c in ("o_walk", "o_east", "o_south")])
        either_ = lambda a: (F.coalesce(a, F.lit(False)) | F.coalesce(f"o_{a}", F.lit(False))).alias(a)
        now = cut(now.join(opened, CELL, "full_outer").select(*CELL, either_("walk"), either_("east"), either_("south")), now)
        release(found, gaps)
    return now


def carve_doors(free: DataFrame, *, least: int = 400, wall: float = 16.0, radius: int = 5, passes: int = 14) -> tuple[DataFrame, DataFrame]:
    """(the mask with its rooms opened, doors (layer, r, c)): free space of ``least`` cells or more that is not
    of the largest part (over eight neighbours) is opened to it through the thinnest wall of up to ``wall``
    cells, ``radius`` cells to each side, pass by pass."""
    now, doors = cut(free.select(*CELL).distinct()), None
    for _ in range(passes):
        found = cut(label(now, eight=True))
        main, rest = _largest_and_rest(found)
        gaps = cut(shortest_gaps(found, rest.where(F.col("n") >= least).select("layer", "component"), main, wall))
        release(found)
        if gaps.isEmpty():
            release(gaps)
            break
        way = gaps.select("layer", F.explode(_line_points(corners=False)).alias("q")).select("layer", "q.r", "q.c")
        now = cut(either(now, grow(way, radius)), now)
        here = gaps.select("layer", "r", "c")
        doors = cut(here if doors is None else doors.unionByName(here), *([gaps] if doors is None else [gaps, doors]))
    return now, doors if doors is not None else now.limit(0)


def reachable_share(owners: DataFrame, main: DataFrame) -> DataFrame:
    """(layer, rooms, reached, share) of rooms (layer, room, component) that touch the main component."""
    j = owners.join(main.withColumn("is_main", F.lit(True)), ["layer", "component"], "left")
    rooms = j.groupBy("layer", "room").agg(F.bool_or(F.coalesce("is_main", F.lit(False))).alias("ok"))
    return rooms.groupBy("layer").agg(F.count(F.lit(1)).alias("rooms"), F.count_if("ok").alias("reached"), F.avg(F.col("ok").cast("double")).alias("share"))
