"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, step: float = 1) -> Column:
    """Rounds to a multiple of ``step``, halves towards plus infinity (-2.5 to -2)."""
    return F.floor(col(c) / step + F.lit(0.5)) * step


def round_feet(feet: Column | str) -> Column:
    """Distances as spoken: to 10 ft from 100 ft on, else to 5 ft."""
    return F.when(col(feet) >= 100, round_half_up(feet, 10)).otherwise(round_half_up(feet, 5))


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def smoothstep(c: Column | str, low: float, high: float) -> Column:
    """0 below ``low``, 1 above ``high``, 3t^2 - 2t^3 between."""
    t = clamp((col(c) - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def lerp(a: Column | str, b: Column | str, t: Column | str) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def finite(c: Column | str) -> Column:
    """Not null, not NaN and not infinite."""
    d = col(c).cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def circular_minutes(a: Column | str, b: Column | str, day: int = 1440) -> Column:
    """Distance of two minutes of the day, across midnight if that is nearer."""
    away = F.abs(col(a) - col(b))
    return F.least(away, F.lit(day) - away)


def minute_of_day(ts: Column | str) -> Column:
    """Minutes past midnight in the session's time zone."""
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def hash31(text: Column | str) -> Column:
    """The absolute value of h = h * 31 + code point, wrapped to 32 bits, over the characters."""
    wrap, half = 2**32, 2**31
    codes = F.filter(F.split(F.coalesce(col(text), F.lit("")), ""), lambda ch: ch != "")
    hashed = F.aggregate(codes, F.lit(0).cast("long"), lambda h, ch: F.pmod(h * 31 + F.ascii(ch) + half, F.lit(wrap).cast("long")) - half)
    return F.abs(hashed)
