"""Printed marks on masks: glyphs, words, upright crops and feature vectors. Marks are cell tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, raster
from .lineage import grown
from .raster import CELL

WORD_REACH, SIZE_RATIO, WORD_GAP, WORD_GLYPHS = 70, 1.5, 0.7, 6
SIZE_BAND, VERTICAL_ASPECT, SNAP_DEGREES = 0.35, 1.3, 10.0
#: Rows and columns of a glyph's vector.
ROWS, COLUMNS = 24, 16


def pocket_marks(pockets: DataFrame, ink: DataFrame) -> DataFrame:
    """pockets (layer, r, c, component) and ink to (layer, r, c, component): ink in the holes of each pocket."""
    key = F.struct("layer", "component")
    holes = raster.without(raster.fill_holes(pockets.withColumn("layer", key)), pockets.withColumn("layer", key))
    return holes.select("layer.layer", "layer.component", "r", "c").join(ink.select(*CELL), CELL, "left_semi").select(*CELL, "component")


def glyph_boxes(marks: DataFrame, height: tuple[int, int], width: tuple[int, int], cells: tuple[int, int], *, keys: list[str] | None = None, aspect: tuple[float, float] = (0.0, 1e9), fill: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """marks (layer, r, c, glyph, keys) to one row a glyph whose sizes, aspect (width by height) and filled share
    of its box lie in the bounds: (layer, keys, glyph, y0, y1, x0, x1, h, w, n, size, cy, cx)."""
    g = marks.groupBy("layer", *(keys or []), "glyph").agg(F.min("r").alias("y0"), (F.max("r") + 1).alias("y1"), F.min("c").alias("x0"), (F.max("c") + 1).alias("x1"), F.count(F.lit(1)).alias("n"))
    g = g.withColumns({"h": F.col("y1") - F.col("y0"), "w": F.col("x1") - F.col("x0"), "cy": (F.col("y0") + F.col("y1")) / 2.0, "cx": (F.col("x0") + F.col("x1")) / 2.0})
    sized = F.col("h").between(*height) & F.col("w").between(*width) & F.col("n").between(*cells)
    return g.withColumn("size", F.greatest("h", "w")).where(sized & (F.col("w") / F.col("h")).between(*aspect) & (F.col("n") / (F.col("h") * F.col("w"))).between(*fill))


def of_one_height(boxes: DataFrame, keys: list[str], band: float = SIZE_BAND) -> DataFrame:
    """Glyphs whose height lies within a band around their key's median height."""
    middle = boxes.groupBy(*keys).agg(F.median("h").alias("__mid"))  # a pocket has few glyphs
    return boxes.join(middle, keys).where(F.abs(F.col("h") - F.col("__mid")) <= band * F.col("__mid")).drop("__mid")


def words(boxes: DataFrame, *, reach: int = WORD_REACH, ratio: float = SIZE_RATIO, gap: float = WORD_GAP, most: int = WORD_GLYPHS) -> DataFrame:
    """Glyph boxes (layer, pocket, glyph, ...) to (glyph, word): glyphs of one pocket and like size with a small
    gap between them are one word, named by its smallest glyph; words of more than ``most`` glyphs drop out."""
    row = ["glyph", "y0", "y1", "x0", "x1", "size", "cy", "cx"]
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    filed = boxes.select("layer", "pocket", *row).withColumns({"ty": F.floor(F.col("cy") / reach), "tx": F.floor(F.col("cx") / reach)})
    other = filed.select("layer", "pocket", *[F.col(c).alias(f"o_{c}") for c in row], "ty", "tx").withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    other = other.withColumns({"ty": F.col("ty") + F.col("i"), "tx": F.col("tx") + F.col("j")})
    apart = lambda a, b: F.greatest(F.lit(0), F.greatest(F.col(a), F.col(f"o_{a}")) - F.least(F.col(b), F.col(f"o_{b}")))
    small, large = F.least("size", "o_size"), F.greatest("size", "o_size")
    met = filed.join(grown(other), ["layer", "pocket", "ty", "tx"]).where(F.col("glyph") < F.col("o_glyph"))
    met = met.where((F.hypot(F.col("cy") - F.col("o_cy"), F.col("cx") - F.col("o_cx")) <= reach) & (large <= ratio * small) & (F.hypot(apart("x0", "x1"), apart("y0", "y1")) <= gap * small))
    found = graph.components(boxes.select(F.col("glyph").alias("id")), met.select(F.col("glyph").alias("a"), F.col("o_glyph").alias("b")))
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    return found.join(grown(size), "component").select(F.col("id").alias("glyph"), F.col("component").alias("word"))


def word_boxes(boxes: DataFrame, named: DataFrame) -> DataFrame:
    """(word, y0, y1, x0, x1, glyphs) around each word's glyphs."""
    return boxes.join(grown(named), "glyph").groupBy("word").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("glyphs"))


def word_angles(boxes: DataFrame, named: DataFrame, *, snap: float = SNAP_DEGREES, vertical: float = VERTICAL_ASPECT) -> DataFrame:
    """(word, angle): degrees of the line through a word's glyph centres, in (-90, 90], made 0 or 90 where near;
    a word of one glyph is upright unless it is taller than wide by ``vertical``."""
    j = boxes.join(grown(named), "glyph")
    g = j.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("cx", "cx").alias("xx"), F.covar_pop("cy", "cy").alias("yy"), F.covar_pop("cx", "cy").alias("xy"), (F.max("y1") - F.min("y0")).alias("h"), (F.max("x1") - F.min("x0")).alias("w"))
    axis = F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2)
    angle = F.when(F.col("n") > 1, axis).otherwise(F.when(F.col("h") > F.col("w") * vertical, 90.0).otherwise(0.0))
    snapped = F.when(F.abs(angle) < snap, 0.0).when(90 - F.abs(angle) < snap, 90.0).otherwise(angle)
    return g.select("word", snapped.alias("angle"))


def upright_crops(marks: DataFrame, angles: DataFrame) -> DataFrame:
    """marks (layer, r, c, word) to (word, turn, r, c): each word turned upright, from its corner; one that does not
    run across is given both ways up, as its cells alone do not tell."""
    both = F.when(F.col("angle") == 0, F.array(F.lit(0.0))).otherwise(F.array(F.col("angle"), F.col("angle") - 180))
    posed = marks.select("word", "r", "c").join(angles, "word").withColumn("turn", F.explode(both))
    t = F.radians("turn")
    y, x = F.round(F.cos(t) * F.col("r") - F.sin(t) * F.col("c")).cast("int"), F.round(F.sin(t) * F.col("r") + F.cos(t) * F.col("c")).cast("int")
    cells = posed.select("word", "turn", y.alias("r"), x.alias("c")).distinct()
    corner = cells.groupBy("word", "turn").agg(F.min("r").alias("r0"), F.min("c").alias("c0"))
    return cells.join(corner, ["word", "turn"]).select("word", "turn", (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"))


def segments(crops: DataFrame, *, aspect: float = 0.62, least_cells: int = 15, least_height: float = 0.45, least_piece: int = 10) -> DataFrame:
    """crops (crop, blob, r, c) to (crop, blob, piece, r, c): a blob wider than a glyph is cut into as many
    pieces as its width implies, each cut at the thinnest column near where a border should fall. Specks drop out."""
    tall = crops.groupBy("crop").agg((F.max("r") - F.min("r") + 1).alias("height"))
    box = crops.groupBy("crop", "blob").agg(F.min("c").alias("x0"), (F.max("c") - F.min("c") + 1).alias("w"), (F.max("r") - F.min("r") + 1).alias("h"), F.count(F.lit(1)).alias("n"))
    box = box.join(tall, "crop").where((F.col("n") >= least_cells) & (F.col("h") >= least_height * F.col("height")))
    k = F.when(F.col("w") > 0.95 * F.col("h"), F.greatest(F.lit(1), F.round(F.col("w") / (aspect * F.col("h"))).cast("int"))).otherwise(1)
    columns = crops.groupBy("crop", "blob", "c").agg(F.count(F.lit(1)).alias("n"))
    profile = columns.groupBy("crop", "blob").agg(F.sort_array(F.collect_list(F.struct("c", "n"))).alias("profile"))
    slack = F.greatest(F.lit(1), F.floor(0.36 * F.col("w") / F.col("k"))).cast("int")

    def thinnest(i: Column) -> Column:
        middle = F.floor(i * F.col("w") / F.col("k")).cast("int")
        lo, hi = F.greatest(F.lit(1), middle - slack), F.least(F.col("w") - 1, middle + slack)
        near = F.filter("profile", lambda p: (p["c"] - F.col("x0")).between(lo, hi))
        return F.coalesce(F.array_min(F.transform(near, lambda p: F.struct(p["n"].alias("n"), p["c"].alias("c"))))["c"], F.col("x0") + middle)

    cuts = F.when(F.col("k") > 1, F.transform(F.sequence(F.lit(1), F.col("k") - 1), thinnest)).otherwise(F.array().cast("array<int>"))
    cut_at = box.withColumn("k", k).join(profile, ["crop", "blob"]).select("crop", "blob", cuts.alias("cuts"))
    cells = crops.join(cut_at, ["crop", "blob"]).withColumn("piece", F.size(F.filter("cuts", lambda x: x <= F.col("c"))))
    size = cells.groupBy("crop", "blob", "piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_piece)
    return cells.join(size, ["crop", "blob", "piece"], "left_semi").select("crop", "blob", "piece", "r", "c")


def glyph_vectors(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, c) to (keys, vector): how much of each of ROWS by COLUMNS parts of a glyph's box is set, and the
    box's shape, as a vector of length 1."""
    box = cells.groupBy(*keys).agg(F.min("r").alias("y0"), F.min("c").alias("x0"), (F.max("r") - F.min("r") + 1).alias("h"), (F.max("c") - F.min("c") + 1).alias("w"))
    placed = cells.join(box, keys).withColumns({"r": F.col("r") - F.col("y0"), "c": F.col("c") - F.col("x0")})

    def shares(df: DataFrame, at: str, size: str, parts: int, name: str) -> DataFrame:
        lo, hi = F.col(at) * parts / F.col(size), (F.col(at) + 1) * parts / F.col(size)
        spread = df.withColumn(name, F.explode(F.sequence(F.floor(lo).cast("int"), (F.ceil(hi) - 1).cast("int"))))
        return spread.withColumn(f"{name}_share", F.least(hi, F.col(name) + 1) - F.greatest(lo, F.col(name)))

    wide = shares(shares(placed, "r", "h", ROWS, "i"), "c", "w", COLUMNS, "j")
    parts = wide.groupBy(*keys, "h", "w", (F.col("i") * COLUMNS + F.col("j")).alias("at")).agg(F.sum(F.col("i_share") * F.col("j_share")).alias("v"))
    shape = box.select(*keys, F.lit(ROWS * COLUMNS).alias("at"), (F.col("w") / F.col("h") * math.sqrt(COLUMNS)).alias("v"))
    every = parts.select(*keys, "at", "v").union(shape)
    # the length as a row of its own: as an expression it would be told again for each part
    length = every.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    listed = every.join(length, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", (F.col("v") / F.col("length")).alias("v")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(ROWS * COLUMNS)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return listed.select(*keys, dense.alias("vector"))
