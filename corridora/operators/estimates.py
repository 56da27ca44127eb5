"""Travel-time estimates from walk reports: exact medians, a circular time window, fallback tiers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import minute_of_day, round_half_up
from .lineage import cut, release
from .validate import FEET_PER_SECOND, STAIR_SECONDS, pace, valid_reports

WINDOW_MINUTES, MIN_ROUTE, MIN_PACE_REPORTS, BUSIER = 30, 2, 3, 0.15
#: Parts of a range of values in one round, and rows that one task may sort for one key.
VALUE_BINS, MOST_AT_ONCE = 4096, 100_000
#: Parts of the range of paces that are counted for each minute of the day, and copied to the 61 around.
MINUTE_BINS = 64


def exact_medians(df: DataFrame, keys: list[str], value: Column, *, at_most: int | None = None) -> DataFrame:
    """(keys, n, median): exact medians, whatever the spread of values and the share of rows that a key has.

    Keys of up to ``MOST_AT_ONCE`` rows are one aggregate. For the others a histogram, which combines before
    the shuffle, tells which part of the key's values holds the middle ranks; that part's own least and greatest
    value bound the next histogram, until so few rows are left that a task can sort them. A value far off thus
    costs a round, not a task. ``at_most``: a bound on the rows of a key where the caller has counted one; keys are
    not counted again if it is small enough.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias("k"), value.cast("double").alias("v")).where("v is not null")
    if at_most is not None and at_most <= MOST_AT_ONCE:
        found = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("median"))
        return found.select(*[F.col(f"k.{c}").alias(c) for c in keys], "n", "median")
    heavy = cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("n") > MOST_AT_ONCE))
    if heavy.isEmpty():
        release(heavy)
        found = rows
    else:
        found = rows.join(heavy.select("k"), "k", "left_anti")
    found = found.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("median"))
    if "_scratch" in heavy.__dict__:
        found = found.union(_heavy_medians(rows.join(heavy.select("k"), "k", "left_semi"), heavy))
    return found.select(*[F.col(f"k.{c}").alias(c) for c in keys], "n", "median")


def _binned(lo: Column, hi: Column, bins: int | None = None) -> Column:
    bins = bins or VALUE_BINS
    width = (hi - lo) / bins
    return F.when(width > 0, F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))).otherwise(0)


def _middle(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, above, m, lo, hi, a, b): bins (keys, n, before, bin, m, lo, hi) to those with the middle ranks.

    Where these lie in different bins, or in one of a single value, ``a`` and ``b`` are the two values; else they
    are null, and the one bin has ``m`` rows from ``lo`` to ``hi`` after ``above`` others.
    """
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("above", F.col("before") + F.coalesce(F.sum("m").over(order), F.lit(0)))
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda r: (F.col("above") < r) & (r <= F.col("above") + F.col("m"))
    kept = placed.where(holds(first) | holds(second))
    of = lambda c, r: F.max(F.when(holds(r), F.col(c)))
    both = kept.groupBy(*keys, "n").agg(of("above", first).alias("above"), of("m", first).alias("m"), of("lo", first).alias("lo"), of("hi", first).alias("hi"), of("lo", second).alias("lo2"), of("bin", first).alias("bin"), of("bin", second).alias("bin2"))
    apart = (F.col("bin") != F.col("bin2")) | (F.col("lo") == F.col("hi"))
    return both.select(*keys, "n", "above", "m", "lo", "hi", F.when(apart, F.col("hi")).alias("a"), F.when(apart, F.col("lo2")).alias("b"))


def _sorted_out(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median) of few rows (keys, n, above, v) a key, which ``above`` smaller ones precede."""
    at = lambda r: F.element_at("vs", (r - F.col("above")).cast("int"))
    held = values.groupBy(*keys, "n", "above").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return held.select(*keys, "n", ((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("median"))


def _heavy_medians(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """(k, n, median) for keys (k, n, lo, hi) of many rows."""
    return _refined(rows, cut(heavy.select("k", "n", F.lit(0).cast("long").alias("above"), F.col("n").alias("m"), "lo", "hi")))


def _refined(rows: DataFrame, now: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(k, n, median) of rows (k, v) for keys (k, n, above, m, lo, hi), whose middle ranks lie among ``m`` rows from
    ``lo`` to ``hi``."""
    rows, out, kept = cut(rows), [], []
    for _ in range(max_rounds):
        inside = rows.join(now.select("k", "n", "above", "m", "lo", "hi"), "k").where("v between lo and hi")
        kept.append(cut(_sorted_out(inside.where(F.col("m") <= MOST_AT_ONCE), ["k"])))
        out.append(kept[-1])
        bins = inside.where(F.col("m") > MOST_AT_ONCE).withColumn("bin", _binned(F.col("lo"), F.col("hi")))
        bins = bins.groupBy("k", "n", F.col("above").alias("before"), "bin").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        told = cut(_middle(bins, ["k"]), now)
        kept.append(told)
        out.append(told.where("a is not null").select("k", "n", ((F.col("a") + F.col("b")) / 2).alias("median")))
        now = cut(told.where("a is null").select("k", "n", "above", "m", "lo", "hi"))
        if now.isEmpty():
            return cut(functools.reduce(DataFrame.union, out), rows, now, *kept)
    raise RuntimeError(f"medians have not settled after {max_rounds} rounds")


def pair_key(a: str = "from", b: str = "to") -> list[Column]:
    """An unordered pair as two columns."""
    return [F.least(a, b).alias("pair_a"), F.greatest(a, b).alias("pair_b")]


def _around(minutes: DataFrame) -> DataFrame:
    """(minute) to (minute, near): every minute of the day within the window, across midnight."""
    return minutes.select("minute", F.explode(F.sequence(F.lit(-WINDOW_MINUTES), F.lit(WINDOW_MINUTES))).alias("d")).select("minute", F.pmod(F.col("minute") + F.col("d"), F.lit(1440)).alias("near"))


def pace_by_minute(reports: DataFrame, minutes: DataFrame) -> DataFrame:
    """(minute, n_now, pace_now) for the asked minutes (at most 1440, so they are broadcast).

    Reports are counted once by their minute and a part of the range of paces; the asked minutes add up the
    counts of the 61 minutes around. Only the reports of the part with a minute's middle ranks are looked at again.
    """
    timed = reports.select(minute_of_day(F.timestamp_millis("at")).alias("near"), pace().cast("double").alias("v")).where("v is not null")
    ends = timed.agg(F.min("v"), F.max("v")).first()
    lo, hi = (F.lit(x).cast("double") for x in ends)
    counts = timed.groupBy("near", _binned(lo, hi, MINUTE_BINS).alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    around = _around(minutes.select("minute").distinct())
    bins = counts.join(F.broadcast(around), "near").groupBy("minute", "bin").agg(F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = F.sum("m").over(Window.partitionBy("minute"))
    told = cut(_middle(bins.withColumns({"n": total, "before": F.lit(0).cast("long")}), ["minute"]))  # 1440 rows at most
    done = told.where("a is not null").select("minute", "n", ((F.col("a") + F.col("b")) / 2).alias("median"))
    near = around.join(F.broadcast(told.where("a is null").select("minute", "n", "above", "m", "lo", "hi")), "minute")
    again = timed.join(F.broadcast(near), "near").where("v between lo and hi")
    small = _sorted_out(again.where(F.col("m") <= MOST_AT_ONCE), ["minute"])
    # a part that many reports share: minutes whose windows have a third of all reports, say
    large = again.where(F.col("m") > MOST_AT_ONCE)
    heavy = told.where((F.col("m") > MOST_AT_ONCE) & F.col("a").isNull())
    found = done.union(small)
    if not heavy.isEmpty():
        key = F.struct("minute").alias("k")
        rest = _refined(large.select(key, "v"), cut(heavy.select(key, "n", "above", "m", "lo", "hi")))
        found = found.union(rest.select("k.minute", "n", "median"))
    return found.select("minute", F.col("n").alias("n_now"), F.col("median").alias("pace_now"))


def estimate(wanted: DataFrame, reports: DataFrame) -> DataFrame:
    """wanted (walk_id, from, to, feet, flights, now) to minutes, basis, count, busier.

    Tiers: two or more valid reports of the pair (median seconds, of those near in time of day if
    there are two, else slowed by how busy it is now); three or more of any (median pace, of those
    near in time if there are three); else a fixed pace.

    The reports are read and checked once; what is left of them is written in a few columns for the passes over it.
    """
    valid = cut(valid_reports(reports).select("from", "to", "at", "feet", "flights", "seconds"))
    n_valid = valid.count()  # told by the files, no pass
    asked = wanted.withColumn("minute", minute_of_day(F.timestamp_millis("now"))).select("*", *pair_key())
    every = exact_medians(valid, [], pace(), at_most=n_valid).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_all"), F.max("median").alias("pace_all"))
    base = asked.join(pace_by_minute(valid, asked), "minute", "left").join(F.broadcast(every))  # one row
    n_now = F.coalesce("n_now", F.lit(0))
    enough_now = (n_now >= MIN_PACE_REPORTS) & (F.col("n_all") >= MIN_PACE_REPORTS)
    slowdown = F.when(enough_now, F.col("pace_all") / F.col("pace_now") - 1)
    base = base.withColumn("busier", F.when(slowdown >= BUSIER, slowdown))

    same = valid.select(*pair_key(), "seconds", minute_of_day(F.timestamp_millis("at")).alias("report_minute"))
    pairs = asked.select("pair_a", "pair_b", "minute").distinct()
    away = F.abs(F.col("report_minute") - F.col("minute"))
    near = F.least(away, 1440 - away) <= WINDOW_MINUTES
    whole = exact_medians(same, ["pair_a", "pair_b"], F.col("seconds"), at_most=n_valid).select("pair_a", "pair_b", "n", F.col("median").alias("all_seconds"))
    close = exact_medians(pairs.join(same, ["pair_a", "pair_b"]).where(near), ["pair_a", "pair_b", "minute"], F.col("seconds"), at_most=n_valid)
    route = pairs.join(whole, ["pair_a", "pair_b"]).join(close.select("pair_a", "pair_b", "minute", F.col("n").alias("n_near"), F.col("median").alias("near_seconds")), ["pair_a", "pair_b", "minute"], "left")
    joined = base.join(route, ["pair_a", "pair_b", "minute"], "left")
    by_route = F.col("n") >= MIN_ROUTE
    route_seconds = F.when(F.col("n_near") >= MIN_ROUTE, F.col("near_seconds")).otherwise(F.col("all_seconds") * (1 + F.coalesce("busier", F.lit(0.0))))
    by_pace = F.col("n_all") >= MIN_PACE_REPORTS
    used = F.when(n_now >= MIN_PACE_REPORTS, F.col("pace_now")).otherwise(F.col("pace_all"))
    stairs = F.col("flights") * STAIR_SECONDS
    seconds = F.when(by_route, route_seconds).when(by_pace, F.col("feet") / used + stairs).otherwise(F.col("feet") / FEET_PER_SECOND + stairs)
    return joined.select(
        "walk_id", F.greatest(F.lit(1), round_half_up(seconds / 60)).cast("int").alias("minutes"), F.when(by_route, "route").when(by_pace, "pace").otherwise("default").alias("basis"),
        F.when(by_route, F.col("n")).when(by_pace, F.col("n_all")).otherwise(0).cast("long").alias("count"), F.when(by_route | by_pace, F.col("busier")).alias("busier"),
    )


def merge_reports(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Both tables' rows, one for each (from, to, at, seconds); local rows and earlier ``ord`` win."""
    both = local.withColumn("__src", F.lit(0)).unionByName(shared.withColumn("__src", F.lit(1)))
    columns = [c for c in local.columns if c not in ("from", "to", "at", "seconds")]
    first = F.min_by(F.struct(*columns), F.struct("__src", "ord")) if columns else None
    # a partial aggregate, not a window: copies of a report shrink before they are shuffled
    kept = both.groupBy("from", "to", "at", "seconds").agg(first.alias("__r"))
    return kept.select(*[F.col(c) if c in ("from", "to", "at", "seconds") else F.col(f"__r.{c}").alias(c) for c in local.columns])


def newest(log: DataFrame, n: int, *, order: str = "ord") -> DataFrame:
    """The newest ``n`` rows of a log, newest first."""
    return log.orderBy(F.col(order).desc()).limit(n)


def open_walk(walks: DataFrame, now_ms: int, limit_minutes: int = 60) -> DataFrame:
    """Open walks that did not expire."""
    return walks.where(F.lit(now_ms) - F.col("started_at") <= limit_minutes * 60_000)
