"""Nearest neighbours at any density: a tree of tight boxes, searched level by level for all queries at once."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut, release

#: Points of a leaf at most (of one place: as many as are sought), and parts of a box along each axis.
LEAF, PARTS = 32, 4
_BOX = ["x0", "y0", "x1", "y1"]


class Tree(NamedTuple):
    """``levels``: for each level its boxes (parent, path, n, x0, y0, x1, y1, leaf); ``points``: (path, p_id, x, y) under
    the leaves; ``k``: how many neighbours it can tell."""

    levels: list[DataFrame]
    points: DataFrame
    k: int


def _finite(*columns: str) -> Column:
    sure = [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in columns]
    return functools.reduce(Column.__and__, sure)


def _part(at: str, lo: str, hi: str) -> Column:
    """Which part of a box a coordinate lies in; halves, so that no width overflows."""
    width = F.col(hi) / 2 - F.col(lo) / 2
    return F.when(width > 0, F.least(F.floor((F.col(at) / 2 - F.col(lo) / 2) / width * PARTS), F.lit(PARTS - 1))).otherwise(0)


def _boxes(rows: DataFrame) -> DataFrame:
    """(parent, path) of points to their boxes; sums and extremes combine before the shuffle."""
    g = rows.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return g.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")))


def point_tree(points: DataFrame, k: int, max_rounds: int = 500) -> Tree:
    """Points (p_id, x, y) to a tree for up to ``k`` neighbours.

    A box of more than ``LEAF`` points is cut into parts of its *own* points' extent, so a crowd in a corner or a point
    far off costs a level, not a crowded leaf. Of points at one place only the ``k`` smallest ids can be neighbours and
    are kept, so no leaf is larger than ``LEAF`` or ``k``. A round counts the points of boxes still open and gives those of
    leaves away. Points without finite coordinates drop out.
    """
    same = Window.partitionBy("x", "y").orderBy("p_id")
    kept = points.where(_finite("x", "y")).select("p_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kept = kept.withColumn("rank", F.row_number().over(same)).where(F.col("rank") <= k).drop("rank")
    rows = cut(kept.select(F.lit(None).cast("string").alias("parent"), F.lit("").alias("path"), "p_id", "x", "y"))
    levels, settled = [], []
    for _ in range(max_rounds):
        boxes = cut(_boxes(rows))
        levels.append(boxes)
        settled.append(rows.join(boxes.where("leaf").select("path"), "path", "left_semi").select("path", "p_id", "x", "y"))
        open_ = boxes.where("not leaf")
        if open_.isEmpty():
            break
        inside = rows.select("path", "p_id", "x", "y").join(open_.select("path", *_BOX), "path")
        digit = F.hex(_part("y", "y0", "y1") * PARTS + _part("x", "x0", "x1"))
        rows = cut(inside.select(F.col("path").alias("parent"), F.concat("path", digit).alias("path"), "p_id", "x", "y"))
    else:
        raise RuntimeError(f"the tree is deeper than {max_rounds} levels")
    return Tree(levels, functools.reduce(DataFrame.union, settled), k)


def nearest_in_tree(queries: DataFrame, tree: Tree, k: int | None = None) -> DataFrame:
    """(q_id, qx, qy) to (q_id, p_id, dist, rank) of each one's ``k`` nearest points; the smaller p_id wins ties. Exact.

    All queries go down one level a round. Boxes that surely hold ``k`` points within some distance bound the search,
    and those that begin farther off are dropped, so a query keeps a few boxes a level and meets a few leaves of
    bounded size, in a crowd as well as beside it: no pair of a query and all points of a cell is made. Queries
    without finite coordinates get no rows; with fewer points than ``k`` all are told.
    """
    k = tree.k if k is None else k
    if k > tree.k:
        raise ValueError(f"the tree tells up to {tree.k} neighbours")
    gap = lambda q, lo, hi: F.greatest(F.col(lo) - F.col(q), F.col(q) - F.col(hi), F.lit(0.0))
    reach = lambda q, lo, hi: F.greatest(F.abs(F.col(q) - F.col(lo)), F.abs(F.col(q) - F.col(hi)))
    near, far = F.hypot(gap("qx", "x0", "x1"), gap("qy", "y0", "y1")), F.hypot(reach("qx", "x0", "x1"), reach("qy", "y0", "y1"))
    query, node = ["q_id", "qx", "qy"], ["path", "n", "leaf", "near", "far"]
    asked = queries.where(_finite("qx", "qy")).select("q_id", F.col("qx").cast("double").alias("qx"), F.col("qy").cast("double").alias("qy"))
    found = asked.crossJoin(F.broadcast(tree.levels[0])).select(*query, "path", "n", "leaf", near.alias("near"), far.alias("far"))  # the root: one row
    mine = Window.partitionBy("q_id")
    sure = mine.orderBy("far", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for boxes in tree.levels[1:]:
        below = boxes.select(F.col("parent").alias("up"), "path", "n", "leaf", *_BOX)
        up = found.where("not leaf").select(*query, F.col("path").alias("up"))
        down = up.join(below, "up").select(*query, "path", "n", "leaf", near.alias("near"), far.alias("far"))
        both = found.where("leaf").select(*query, *node).union(down).withColumn("held", F.sum("n").over(sure))
        bound = F.coalesce(F.min(F.when(F.col("held") >= k, F.col("far"))).over(mine), F.lit(float("inf")))
        # distances are rounded, so a box that begins right at the bound stays
        told = cut(both.withColumn("bound", bound).where(F.col("near") <= F.col("bound") * (1 + 1e-9)).select(*query, *node))
        release(found)
        found = told
    dist = F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))
    pairs = found.select(*query, "path").join(tree.points, "path").select("q_id", "p_id", dist.alias("dist"))
    return pairs.withColumn("rank", F.row_number().over(mine.orderBy("dist", "p_id"))).where(F.col("rank") <= k)
