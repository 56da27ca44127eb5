"""Polygon overlay: union, intersection and difference of two sets of polygons, their vertices as they are.

Edges are split wherever they meet, found by grid cells, until none meet any more but in end points. On both
sides of every piece it is then told which polygons lie there: the edges that a ray from its middle crosses are
counted for the polygons around, and the edges that run along the piece differ between its sides. Pieces with
the result on one side only are its outline, chained to rings by pointer doubling.

Coordinates are rounded to ``UNIT`` (2**-20), split points too; an end point that lies within a unit of an edge
splits it, so what rounding brings together stays together. Polygons are sets of points by the even-odd rule:
rows of one poly_id are one polygon's rings (holes), which may cross themselves or touch. Polygons of one set may
overlap. Rings of fewer than three points, and rows of null, have no inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shapes, spatial
from .lineage import cut, release

UNIT = 2.0**-20
#: Rounds of splitting; each meets only what the rounding of the one before has moved.
MOST_ROUNDS = 24
_SEGMENT = ["ax", "ay", "bx", "by"]
#: A ray's direction leans by this much, so that no edge of rounded coordinates runs along it.
_LEAN = 0.6180339887498949


def _round(c: Column) -> Column:
    return F.round(c / UNIT) * UNIT + 0.0


def _ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Edges (x1, y1, x2, y2) with their ends in order (ax, ay, bx, by), without those of no length."""
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    ends = df.where("x1 != x2 or y1 != y2").select(*keys, F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    return ends.select(*keys, F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def _odd(edges: DataFrame) -> DataFrame:
    """One row of each edge that a polygon has an odd number of times: the others cancel out."""
    return edges.groupBy("layer", "side", "poly", *_SEGMENT).agg((F.count(F.lit(1)) % 2).alias("n")).where("n = 1").drop("n")


def _edges(polygons: DataFrame, side: int) -> DataFrame:
    named = polygons.where("ring is not null").select("ring", F.struct("layer", F.col("poly_id").alias("poly")).alias("poly_id"))
    raw = spatial.ring_edges(named).select("poly_id.*", *[_round(F.col(c).cast("double")).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return _ordered(raw.withColumn("side", F.lit(side)), "layer", "side", "poly")


def _in_cells(segments: DataFrame, size: float) -> DataFrame:
    """Each segment in the cells (i, j) that it runs through, two units wide of them included."""
    pad = 2 * UNIT
    top, bottom = F.least("ay", "by") - pad, F.greatest("ay", "by") + pad
    strips = segments.withColumn("i", F.explode(F.sequence(F.floor(top / size), F.floor(bottom / size))))
    at = lambda y: F.col("ax") + (F.greatest(F.least(y, F.greatest("ay", "by")), F.least("ay", "by")) - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    one, two = F.coalesce(at(F.col("i") * size - pad), F.col("ax")), F.coalesce(at((F.col("i") + 1) * size + pad), F.col("bx"))
    return strips.withColumn("j", F.explode(F.sequence(F.floor((F.least(one, two) - pad) / size), F.floor((F.greatest(one, two) + pad) / size))))


def _meetings(segments: DataFrame, size: float) -> DataFrame:
    """(layer, ax, ay, bx, by, points): where segments must be split."""
    cells = _in_cells(segments, size)
    one = cells.select("layer", "i", "j", F.struct(*_SEGMENT).alias("s"))
    both = one.join(one.withColumnRenamed("s", "t"), ["layer", "i", "j"]).where(F.col("s") < F.col("t")).select("layer", "s", "t").distinct()
    c = lambda s, k: F.col(f"{s}.{k}")
    end = lambda s, k: (c(s, f"{k}x"), c(s, f"{k}y"))

    def on(s: str, p: tuple[Column, Column]) -> Column:
        """Whether a point lies on a segment, within a unit, and is none of its ends."""
        dx, dy, px, py = c(s, "bx") - c(s, "ax"), c(s, "by") - c(s, "ay"), p[0] - c(s, "ax"), p[1] - c(s, "ay")
        length = dx * dx + dy * dy
        along, off = px * dx + py * dy, px * dy - py * dx
        return (along > 0) & (along < length) & (off * off <= UNIT * UNIT * length) & ((p[0] != c(s, "bx")) | (p[1] != c(s, "by")))

    def beside(s: str, p: tuple[Column, Column]) -> Column:
        return F.signum((c(s, "bx") - c(s, "ax")) * (p[1] - c(s, "ay")) - (c(s, "by") - c(s, "ay")) * (p[0] - c(s, "ax")))

    touch = {(s, k): on(s, end("t" if s == "s" else "s", k)) for s in "st" for k in "ab"}
    none = reduce(lambda x, y: x & y, [~x for x in touch.values()])
    cross = none & (beside("s", end("t", "a")) * beside("s", end("t", "b")) < 0) & (beside("t", end("s", "a")) * beside("t", end("s", "b")) < 0)
    sx, sy, tx, ty = (c(s, f"b{k}") - c(s, f"a{k}") for s in "st" for k in "xy")
    at = ((c("t", "ax") - c("s", "ax")) * ty - (c("t", "ay") - c("s", "ay")) * tx) / F.nullif(sx * ty - sy * tx, F.lit(0.0))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    crossing = F.when(cross, point(_round(c("s", "ax") + at * sx), _round(c("s", "ay") + at * sy)))
    of = lambda s: F.array(*[F.when(touch[s, k], point(*end("t" if s == "s" else "s", k))) for k in "ab"], crossing)
    told = both.select("layer", F.col("s").alias("s"), F.explode(of("s")).alias("p")).union(both.select("layer", F.col("t").alias("s"), F.explode(of("t")).alias("p")))
    told = told.where("p is not null and (p.x != s.ax or p.y != s.ay) and (p.x != s.bx or p.y != s.by)")
    return told.groupBy("layer", "s").agg(F.collect_set("p").alias("points")).select("layer", "s.*", "points")


def _split(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges in pieces between the points on them."""
    met = edges.join(points, ["layer", *_SEGMENT], "left")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    far = lambda p: (p["x"] - F.col("ax")) * dx + (p["y"] - F.col("ay")) * dy
    inner = F.array_sort(F.transform("points", lambda p: F.struct(far(p).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))
    inner = F.transform(inner, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    start, end = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    chain = F.concat(F.array(start), F.coalesce(inner, F.array().cast("array<struct<x:double,y:double>>")), F.array(end))
    piece = F.explode(F.arrays_zip(F.slice(chain, F.lit(1), F.size(chain) - 1).alias("p"), F.slice(chain, F.lit(2), F.size(chain) - 1).alias("q")))
    flat = met.select("layer", "side", "poly", piece.alias("e")).select("layer", "side", "poly", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
    return _odd(_ordered(flat, "layer", "side", "poly"))


def arranged(edges: DataFrame, size: float) -> DataFrame:
    """Edges (layer, side, poly, ax, ay, bx, by) in pieces that meet in end points only, as a written table."""
    now = cut(_odd(edges))
    for _ in range(MOST_ROUNDS):
        points = cut(_meetings(now.select("layer", *_SEGMENT).distinct(), size))
        if points.isEmpty():
            release(points)
            return now
        now = cut(_split(now, points), now, points)
    raise RuntimeError(f"edges still meet after {MOST_ROUNDS} rounds")


def sides(pieces: DataFrame, size: float) -> DataFrame:
    """(layer, x1, y1, x2, y2, a_left, a_right, b_left, b_right): which sets lie on both sides of each piece.

    Only polygons whose extent in a strip of rays holds a piece's middle are asked, by their edges in that strip.
    """
    lean = lambda x, y: F.col(y) + _LEAN * F.col(x)
    e = pieces.withColumns({"av": lean("ax", "ay"), "bv": lean("bx", "by")})
    up = F.col("av") < F.col("bv")
    pick = lambda a, b, name: F.when(up, F.col(a)).otherwise(F.col(b)).alias(name)
    strip = F.explode(F.sequence(F.floor(F.least("av", "bv") / size), F.floor(F.greatest("av", "bv") / size)))
    own = e.select("layer", "side", "poly", *_SEGMENT, "av", "bv", strip.alias("i"))
    extent = own.groupBy("layer", "side", "poly", "i").agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"))
    extent = extent.withColumn("j", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))))
    middle = e.select("layer", *_SEGMENT, ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("av") + F.col("bv")) / 2).alias("mv")).distinct()
    middle = middle.withColumns({"i": F.floor(F.col("mv") / size), "j": F.floor(F.col("mx") / size)}).withColumn("seg", F.struct(*_SEGMENT)).drop(*_SEGMENT)
    around = middle.join(extent, ["layer", "i", "j"]).where("mx between x0 and x1").select("layer", "side", "poly", "i", "seg", "mx", "mv")
    met = around.join(own, ["layer", "side", "poly", "i"])
    same = F.col("seg") == F.struct(*_SEGMENT)
    x = F.col("ax") + (F.col("mv") - F.col("av")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("bv") - F.col("av"), F.lit(0.0))
    crossed = ~same & ((F.col("av") > F.col("mv")) != (F.col("bv") > F.col("mv"))) & (x > F.col("mx"))
    told = met.groupBy("layer", "seg", "side", "poly").agg(F.count_if(crossed).alias("base"), F.count_if(same).alias("along"))
    left, right = (F.col("base") + F.col("along")) % 2 == 1, F.col("base") % 2 == 1
    of = lambda k, inside, name: F.coalesce(F.bool_or(inside & (F.col("side") == k)), F.lit(False)).alias(name)
    found = told.groupBy("layer", "seg").agg(of(0, left, "a_left"), of(0, right, "a_right"), of(1, left, "b_left"), of(1, right, "b_right"))
    found = found.select("layer", "seg.*", "a_left", "a_right", "b_left", "b_right").withColumns({"av": lean("ax", "ay"), "bv": lean("bx", "by")})
    # by ascending rays, a piece's left is where x is smaller
    return found.select("layer", pick("ax", "bx", "x1"), pick("ay", "by", "y1"), pick("bx", "ax", "x2"), pick("by", "ay", "y2"), "a_left", "a_right", "b_left", "b_right")


_HOWS = {"union": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b}


def overlay(a: DataFrame, b: DataFrame, hows: tuple[str, ...] = ("union", "intersection", "difference"), *, size: float | None = None) -> DataFrame:
    """The outlines (how, layer, ring_id, ring) of two sets of polygons (layer, poly_id, ring) together.

    Outer rings have a positive shoelace area, holes a negative one. ``size``: of grid cells, by default twice
    the edges' mean extent.
    """
    edges = cut(_edges(a, 0).union(_edges(b, 1)))
    if size is None:
        mean = edges.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0]
        size = max(2 * (mean or 1.0), 1024 * UNIT)
    pieces = arranged(edges, size)
    told = cut(sides(pieces, size), pieces, edges)
    parts = []
    for how in hows:
        left, right = (_HOWS[how](F.col(f"a_{s}"), F.col(f"b_{s}")) for s in ("left", "right"))
        turn = lambda p, q: F.when(left, F.col(p)).otherwise(F.col(q))  # noqa: B023, E731  the inside to the left
        outline = told.where(left != right).select(F.struct(F.lit(how).alias("how"), "layer").alias("layer"), turn("x1", "x2").alias("x1"), turn("y1", "y2").alias("y1"), turn("x2", "x1").alias("x2"), turn("y2", "y1").alias("y2"))
        parts.append(outline)
    found = shapes.rings(reduce(DataFrame.union, parts))
    return found.select("layer.how", "layer.layer", "ring_id", "ring")


def union_all(polygons: DataFrame, *, size: float | None = None) -> DataFrame:
    """The outlines (layer, ring_id, ring) of all polygons of a layer together."""
    return overlay(polygons, polygons.limit(0), ("union",), size=size).drop("how")
