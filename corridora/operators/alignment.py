"""Placements of floors on a site: edits, tests for change, descriptions, heights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import smoothstep

FIXED_FLOOR, LEAST_SCALE = "main", 0.2
FIELDS = ("scale", "rotation_deg", "tx", "ty")


def nudge(placements: DataFrame, deltas: DataFrame) -> DataFrame:
    """placements (floor, scale, rotation_deg, tx, ty, verified) plus deltas of the same fields a floor.

    The scale keeps LEAST_SCALE; the fixed floor does not move; a moved floor is no longer verified.
    """
    d = deltas.select("floor", *[F.col(f).alias(f"d_{f}") for f in FIELDS])
    joined = placements.join(d, "floor", "left")
    free = F.col("floor") != FIXED_FLOOR
    step = {f: F.when(free, F.col(f) + F.coalesce(f"d_{f}", F.lit(0.0))).otherwise(F.col(f)) for f in FIELDS}
    step["scale"] = F.greatest(step["scale"], F.lit(LEAST_SCALE))
    moved = free & reduce(lambda a, b: a | b, [F.coalesce(f"d_{f}", F.lit(0.0)) != 0 for f in FIELDS])
    return joined.select("floor", *[step[f].alias(f) for f in FIELDS], (F.col("verified") & ~moved).alias("verified"))


def changed(saved: DataFrame, now: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Floors whose placement differs by more than ``tolerance`` or in being verified."""
    other = now.select("floor", *[F.col(f).alias(f"n_{f}") for f in FIELDS], F.col("verified").alias("n_verified"))
    differ = reduce(lambda a, b: a | b, [F.abs(F.col(f) - F.col(f"n_{f}")) > tolerance for f in FIELDS])
    return saved.join(other, "floor").where(differ | (F.col("verified") != F.col("n_verified"))).select("floor")


def for_file(placements: DataFrame) -> DataFrame:
    """Rounded as stored: scale and rotation to 4 places, shifts to 2."""
    return placements.withColumns({f: F.round(f, 4 if f in FIELDS[:2] else 2) for f in FIELDS})


def describe() -> Column:
    """A sentence about a placement; parts that do not apply are left out."""
    return F.concat_ws(
        ", ", F.format_string("%s: scale %.4f", F.col("floor"), F.col("scale")), F.when(F.col("rotation_deg") != 0, F.format_string("turned %.2f degrees", F.col("rotation_deg"))),
        F.when((F.col("tx") != 0) | (F.col("ty") != 0), F.format_string("moved by %.1f, %.1f", F.col("tx"), F.col("ty"))), F.when(F.col("verified"), "verified"),
    )


def elevation(position: Column | str, heights: dict[int, float]) -> Column:
    """Height at a fractional storey: smooth from one storey's height to the next."""
    p = F.col(position) if isinstance(position, str) else position
    levels = sorted(heights)
    out = F.lit(float(heights[levels[0]]))
    for a, b in zip(levels, levels[1:]):
        out = out + smoothstep(p, a, b) * (heights[b] - heights[a])
    return out


def column_anchors(ends: DataFrame, heights: DataFrame) -> DataFrame:
    """(link_id, floor, x, y) to each link's distinct anchors in order of height."""
    raised = ends.join(heights.select("floor", "z"), "floor")
    return raised.groupBy("link_id").agg(F.sort_array(F.collect_set(F.struct("z", "floor", "x", "y"))).alias("anchors"))
