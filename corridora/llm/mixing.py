"""Mixing sources to target weights by entropy balancing.

Each source g gets a target of T_g words. Among all document rates r (0 to ``cap``) whose words meet
every source's target, the one nearest to taking each document once is chosen: the least relative
entropy, the sum of r log r - r + 1 over documents. Its dual is convex with one multiplier per source,
and the solution tilts every document exponentially by its tokens: r = min(cap, exp(lambda_g * z)),
where z is the document's size over its source's mean size. A source that has too many words loses
them from its long documents first and keeps most of its documents; one that has too few repeats its
long documents first.

The dual is solved by Newton steps, kept inside a shrinking bracket; each is an aggregation over
strata of documents of a source that are alike in size. A stratum enters with its exact sums and has
the rate of its mean size, so the constraint holds for the documents themselves, and the steps cost
the same whatever a source's documents are. Strata are sizes up to 64 words, and a 64th of a doubling
beyond.

Rates are rounded into copies so that each source's words stay near its target: from the longest
stratum to the shortest, a stratum gets the whole number of copies that comes nearest to its share plus
what was left over so far; inside a stratum they are dealt out evenly in a fixed pseudo-random order.

DataFrame functions only; reruns agree. Rows that repeat are one group with a number of rows, and
prefix sums run over tiers in two levels, so that no source, stratum or copied document is one task's
alone.

Targets: sources by code point, null last, weigh ``weights`` in turn, and share ``budget`` of all
sizes; a target stops at ``cap`` times its source's size and the excess is reshared by weight
until none is above (the water level of the sorted caps).

Defined results: null and empty texts have size 0 and nothing is taken of them; a null source is a
source; repeated rows are dealt copies each; very long texts are strata like others; an empty table
gives an empty result; other columns are left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, release, running_start

WEIGHTS = (3, 1, 2)
STRATA_PER_DOUBLING = 64
TOLERANCE, STEPS = 1e-9, 60
#: Newton steps between two cuts of the lineage.
STEPS_A_CUT = 2


def count_words(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Orders sources by code point with null last; never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source_size) to (key, source_size, target); one row per source."""
    turn = F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", cap * F.col("source_size")).withColumn("full", F.col("cap") / F.col("w"))
    order = Window.orderBy("full", "key")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    found = weighed.withColumn("level", level).withColumn("water", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "key", "level"))).over(whole)["level"])
    return found.select("key", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("w"), F.col("cap"))).alias("target"))


def _stratum(size: Column) -> Column:
    """A number for sizes that are alike: the size itself, or its 64th of a doubling; -1 for none."""
    fine = F.floor(F.log2(size.cast("double")) * STRATA_PER_DOUBLING + 1e-9)
    return F.when(size <= 0, -1).when(size <= STRATA_PER_DOUBLING, size).otherwise(fine).cast("int")


def solve_rates(strata: DataFrame, wanted: DataFrame, *, cap: float = 2.0) -> DataFrame:
    """(key, class, n, words) and (key, source_size, target) to strata with their ``rate``.

    Newton steps on the dual until every source's words are within TOLERANCE of its target.
    """
    means = strata.where("words > 0").groupBy("key").agg((F.sum("words") / F.sum("n")).alias("source_mean"))
    cells = strata.where("words > 0").join(means, "key").select("key", "class", "n", "words", (F.col("words") / F.col("n") / F.col("source_mean")).alias("z"))
    cells = materialize(cells, "strata")
    # exp(lam * z) spans all rates that doubles tell apart, down to the shortest document's z
    state = wanted.where("source_size > 0").select("key", "target", F.lit(0.0).alias("lam"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"), F.lit(1.0).alias("off"))
    state = materialize(state, "newton")
    rate = F.least(F.lit(cap), F.exp(F.col("lam") * F.col("z")))

    def step(state: DataFrame) -> DataFrame:
        slope = F.when(rate < cap, F.col("z") * rate * F.col("words")).otherwise(0.0)
        held = [F.first(c).alias(c) for c in ("target", "lam", "lo", "hi")]
        sums = cells.join(state, "key").groupBy("key").agg(*held, F.sum(rate * F.col("words")).alias("got"), F.sum(slope).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        sums = sums.withColumn("off", F.abs(gap) / F.col("target")).withColumns({"lo": lo, "hi": hi, "next": newton})
        # outside of the bracket a step halves it, on a scale that reaches far ends in few steps
        middle = F.when(F.col("lo") >= 1, F.sqrt(F.col("lo") * F.col("hi"))).when(F.col("hi") <= -1, -F.sqrt(F.col("lo") * F.col("hi")))
        middle = F.coalesce(middle, F.when(F.col("lo") < -2, F.lit(-1.5)).when(F.col("hi") > 2, F.lit(1.5)), (F.col("lo") + F.col("hi")) / 2)
        inside = F.when(F.col("next").between(F.col("lo"), F.col("hi")), F.col("next")).otherwise(middle)
        return sums.select("key", "target", F.when(F.col("off") <= TOLERANCE, F.col("lam")).otherwise(inside).alias("lam"), "lo", "hi", "off")

    for _ in range(0, STEPS, STEPS_A_CUT):
        before, following = state, state
        for _ in range(STEPS_A_CUT):
            following = step(following)
        state = materialize(following, "newton")
        release(before)
        if state.where(F.col("off") > TOLERANCE).isEmpty():
            break
    else:
        raise RuntimeError(f"the multipliers did not settle within {STEPS} steps")
    return cells.join(state.select("key", "lam"), "key").select("key", "class", "n", "words", rate.alias("rate"))


def _copies_per_stratum(rated: DataFrame, cap: float) -> DataFrame:
    """(key, class, n, copies): whole copies of each stratum, what is left over passed to shorter ones."""
    row = F.struct(F.col("class").alias("c"), "n", "words", "rate")
    listed = rated.groupBy("key").agg(F.sort_array(F.collect_list(row), asc=False).alias("rows"))

    def deal(done: Column, x: Column) -> Column:
        mean = x["words"] / x["n"]
        want = x["rate"] * x["words"] + done["left"]
        copies = F.least(F.greatest(F.round(want / mean), F.lit(0.0)), cap * x["n"])
        entry = F.struct(x["c"].alias("class"), x["n"].alias("n"), x["rate"].alias("rate"), F.floor(copies).cast("long").alias("copies"))
        return F.struct((want - F.floor(copies) * mean).alias("left"), F.concat(done["out"], F.array(entry)).alias("out"))

    start = F.struct(F.lit(0.0).alias("left"), F.expr("cast(array() as array<struct<class:int,n:bigint,rate:double,copies:bigint>>)").alias("out"))
    return listed.select("key", F.explode(F.aggregate("rows", start, deal)["out"]).alias("x")).select("key", "x.*")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per document: doc_id, text_hash, source, size, source_size, target, rate, copies, taken."""
    columns = [F.col(id_col), _key(F.col(source_col)).alias("key"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash")]
    small = docs.select(*columns).withColumn("class", _stratum(F.col("size")))
    # rows that repeat are one group of m rows
    small = materialize(small.groupBy(id_col, "key", "source", "size", "text_hash", "class").agg(F.count(F.lit(1)).alias("m")), "sizes")
    strata = materialize(small.groupBy("key", "class").agg(F.sum("m").alias("n"), F.sum(F.col("size") * F.col("m")).alias("words")), "classes")
    wanted = materialize(targets(strata.groupBy("key").agg(F.sum("words").alias("source_size")), weights=weights, budget=budget, cap=cap), "targets")
    dealt = materialize(_copies_per_stratum(solve_rates(strata, wanted, cap=cap), cap), "copies")

    placed = running_start(small.where("size > 0"), ["key", "class"], [id_col, "text_hash"], "m").join(dealt, ["key", "class"])
    rows = placed.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("m"))))
    at, share = F.col("start") + F.col("__i"), F.col("copies")
    each = (F.floor(at * share / F.col("n")) - F.floor((at - 1) * share / F.col("n"))).cast("int")
    some = rows.select(id_col, "text_hash", "key", "source", "size", "rate", each.alias("copies"))
    none = small.where("size = 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("m")))).select(id_col, "text_hash", "key", "source", "size", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    return some.unionByName(none).join(wanted, "key").select(id_col, "text_hash", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0 to cap times).

    Rows that repeat id, text and source count as one row that takes their copies together.
    """
    keys = {"__id": F.col(id_col), "__text": F.col("text_hash"), "__from": F.col("source")}
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    plan = materialize(plan, "plan")
    keyed = docs.withColumn("__hash", F.xxhash64(text_col))
    if not plan.where("__rows > 1").isEmpty():
        keyed = keyed.dropDuplicates([id_col, "__hash", source_col])
    chosen = plan.where("__copies > 0")
    joined = keyed.join(chosen, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text")) & F.col(source_col).eqNullSafe(F.col("__from")))
    repeated = joined.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*docs.columns)
