"""Walk reports: bounds, validity and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col, finite, round_half_up
from .lineage import stated

STAIR_SECONDS, FEET_PER_SECOND = 25, 4.0
MIN_SECONDS, MAX_SECONDS, MIN_PACE, MAX_PACE, MAX_NAME = 10, 1200, 1.0, 10.0, 64
MAX_FEET, MAX_FLIGHTS, MAX_SKEW_MS = 5000, 4, 86_400_000


def pace(feet: Column | str = "feet", flights: Column | str = "flights", seconds: Column | str = "seconds") -> Column:
    """Feet per second with the stairs taken out."""
    return col(feet) / F.greatest(col(seconds) - STAIR_SECONDS * col(flights), F.lit(1))


def reject_reason(feet: Column | str = "feet", flights: Column | str = "flights", seconds: Column | str = "seconds") -> Column:
    """The first bound that a walk breaks: too_quick, too_long, too_fast, too_slow; null if none."""
    p = pace(feet, flights, seconds)
    return F.when(col(seconds) < MIN_SECONDS, "too_quick").when(col(seconds) > MAX_SECONDS, "too_long").when(p > MAX_PACE, "too_fast").when(p < MIN_PACE, "too_slow")


def is_valid() -> Column:
    """Whether a row (from, to, feet, flights, seconds, at) is a fair measurement."""
    named = [F.length(c).between(1, MAX_NAME) for c in ("from", "to")]
    numbers = [finite(c) for c in ("feet", "flights", "seconds", "at")]
    ok = F.lit(True)
    for condition in (*named, *numbers, F.col("feet") > 0, F.col("flights") >= 0):
        ok = ok & condition
    return F.coalesce(ok & reject_reason().isNull(), F.lit(False))


def valid_reports(reports: DataFrame) -> DataFrame:
    return reports.where(is_valid())


def clean_reports(reports: DataFrame, now_ms: Column | int) -> DataFrame:
    """The server's form: valid and bounded rows, whole numbers, and a clock a day or more off is
    set to ``now_ms`` (never dropped)."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    kept = reports.where(is_valid() & (F.col("feet") <= MAX_FEET) & (F.col("flights") <= MAX_FLIGHTS))
    at = F.when(F.abs(now - F.col("at")) < MAX_SKEW_MS, F.col("at")).otherwise(now).cast("long")
    whole = {c: round_half_up(c).cast("long") for c in ("feet", "flights", "seconds")}
    return kept.withColumns(whole | {"at": at})


def valid_sponsors(sponsors: DataFrame) -> DataFrame:
    """Sponsors with an id, a name, a text, and an https address or none."""
    given = [F.col(c).isNotNull() for c in ("id", "name", "text")]
    return sponsors.where(given[0] & given[1] & given[2] & (F.col("url").isNull() | F.col("url").startswith("https://")))


def whole_bounds(df: DataFrame, boxes: DataFrame, slack: float = 3.0) -> DataFrame:
    """Rows (x0, y0, x1, y1) that are one of a few known ``boxes``, each side within ``slack``."""
    close = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= slack for c in ("x0", "y0", "x1", "y1")]
    return df.alias("a").join(stated(boxes, "known boxes", 1_000).alias("b"), close[0] & close[1] & close[2] & close[3], "left_semi")
