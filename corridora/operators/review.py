"""Dataset differences, review queues, conflict settlement and reconciliation of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import round_half_up
from ..functions.text import natural_order

NEAR, APPLIED, MIN_CONFIDENCE, CONFLICT = 60.0, 0.5, 0.5, 0.3
MATCH_DISTANCE = 2 * NEAR


def diff_points(base: DataFrame, following: DataFrame) -> DataFrame:
    """(id, x, y, label) twice to (kind, id, detail): added, removed, moved, renamed.

    A point can be moved and renamed; positions are compared as whole pixels.
    """
    a = base.select("id", F.struct("x", "y", "label").alias("a"))
    b = following.select("id", F.struct("x", "y", "label").alias("b"))
    at = lambda p: F.concat_ws(",", *[round_half_up(F.col(f"{p}.{c}")).cast("long").cast("string") for c in ("x", "y")])
    kept = F.col("a").isNotNull() & F.col("b").isNotNull()
    change = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    found = F.array(
        F.when(F.col("a").isNull(), change("added", at("b"))),
        F.when(F.col("b").isNull(), change("removed", at("a"))),
        F.when(kept & (at("a") != at("b")), change("moved", F.concat(at("a"), F.lit(" -> "), at("b")))),
        F.when(kept & ~F.col("a.label").eqNullSafe(F.col("b.label")), change("renamed", F.concat(F.coalesce("a.label", F.lit("")), F.lit(" -> "), F.coalesce("b.label", F.lit(""))))),
    )
    return a.join(b, "id", "full_outer").select("id", F.explode(F.filter(found, lambda c: c.isNotNull())).alias("c")).select("c.kind", "id", "c.detail")


def diff_edges(base: DataFrame, following: DataFrame) -> DataFrame:
    """(a, b) twice, as unordered pairs, to (kind, a, b)."""
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    one, two = base.select(*ends).distinct(), following.select(*ends).distinct()
    added = two.join(one, ["a", "b"], "left_anti").select(F.lit("added").alias("kind"), "a", "b")
    return added.unionByName(one.join(two, ["a", "b"], "left_anti").select(F.lit("removed").alias("kind"), "a", "b"))


def suggestions(candidates: DataFrame, rooms: DataFrame) -> DataFrame:
    """(bucket, ord, text, x, y, conf) that are unsure and not among ``rooms`` (id); of equal texts
    the first (bucket, ord). Sorted by confidence, then natural text."""
    open_ = candidates.where(F.col("conf") < APPLIED).join(rooms.select(F.col("id").alias("text")), "text", "left_anti")
    row = F.struct(*[c for c in candidates.columns if c != "text"])
    first = open_.groupBy("text").agg(F.min_by(row, F.struct("bucket", "ord")).alias("r"))
    return first.select("text", "r.*").orderBy(F.col("conf").desc(), *natural_order("text"))


def missing(named: DataFrame, rooms: DataFrame, suggested: DataFrame) -> DataFrame:
    """Labels that a report names, that no room has and no suggestion would restore."""
    return named.select(F.col("label").alias("text")).distinct().join(rooms.select(F.col("id").alias("text")), "text", "left_anti").join(suggested.select("text"), "text", "left_anti").orderBy(*natural_order("text"))


def settle_conflicts(reads: DataFrame, min_conf: float = MIN_CONFIDENCE) -> DataFrame:
    """(read_id, text, x, y, conf, valid): sure reads that cannot both be true are capped.

    One text at two places more than NEAR apart: told from each text's bounding box, so that no
    pairs of equal texts are made unless a box is about as large as NEAR. Two texts less than a
    third of NEAR apart: found in a grid whose cells are that wide, with its neighbours.
    """
    sure = reads.where(F.col("valid") & (F.col("conf") >= min_conf)).select("read_id", "text", "x", "y")
    box = sure.groupBy("text").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).where("n > 1")
    boxed = sure.join(box, "text")
    dx, dy = F.greatest(F.col("x") - F.col("x0"), F.col("x1") - F.col("x")), F.greatest(F.col("y") - F.col("y0"), F.col("y1") - F.col("y"))
    boxed = boxed.withColumns({"dx": dx, "dy": dy})
    far = boxed.where(F.greatest("dx", "dy") > NEAR).select("read_id")
    unsure = boxed.where((F.greatest("dx", "dy") <= NEAR) & (F.hypot("dx", "dy") > NEAR)).select("read_id", "text", "x", "y")
    other = sure.select(F.col("read_id").alias("o"), "text", F.col("x").alias("ox"), F.col("y").alias("oy"))
    far = far.union(unsure.join(other, "text").where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) > NEAR).select("read_id"))

    cell = NEAR / 3
    placed = sure.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = placed.withColumn("s", F.explode(steps)).select(F.col("read_id").alias("o"), F.col("text").alias("otext"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    near = placed.join(around, ["cx", "cy"]).where((F.col("text") != F.col("otext")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) < cell)).select("read_id")
    bad = far.union(near).distinct().withColumn("__bad", F.lit(True))
    joined = reads.join(bad, "read_id", "left")
    conf = F.when(F.col("__bad"), F.least("conf", F.lit(CONFLICT))).otherwise(F.col("conf"))
    return joined.withColumn("conf", conf).withColumn("opinion", F.when(F.col("__bad"), "conflict")).drop("__bad")


def matches_decision(text: str, x: str, y: str, d: str) -> Column:
    return (F.col(text) == F.col(f"{d}.text")) & (F.hypot(F.col(x) - F.col(f"{d}.x"), F.col(y) - F.col(f"{d}.y")) <= MATCH_DISTANCE)


def reconcile(reads: DataFrame, claims: DataFrame, traced: DataFrame, rejects: DataFrame) -> DataFrame:
    """Valid reads against traced points: (bucket, text, x, y, conf, was).

    reads (read_id, text, x, y, conf, valid), claims (read_id, point_id), traced (point_id, label,
    x, y), rejects (text, x, y). Buckets: rejected, confirmed (a claimed label equals the text),
    corrected (others are claimed), found (none is), unread (points that no read claimed).
    """
    r, d = reads.where("valid").alias("r"), rejects.alias("d")
    hit = r.join(d, matches_decision("r.text", "r.x", "r.y", "d"), "left_semi").select("read_id", F.lit(True).alias("rejected"))
    labels = claims.join(traced.select("point_id", F.coalesce("label", "point_id").alias("name")), "point_id").groupBy("read_id").agg(F.sort_array(F.collect_set("name")).alias("was"))
    joined = reads.where("valid").join(hit, "read_id", "left").join(labels, "read_id", "left")
    bucket = F.when(F.col("rejected"), "rejected").when(F.array_contains("was", F.col("text")), "confirmed").when(F.size("was") > 0, "corrected").otherwise("found")
    told = joined.withColumn("bucket", bucket)
    used = claims.join(told.where(F.col("bucket").isin("confirmed", "corrected")).select("read_id"), "read_id", "left_semi").select("point_id")
    unread = traced.join(used, "point_id", "left_anti").select(F.lit("unread").alias("bucket"), F.coalesce("label", "point_id").alias("text"), "x", "y", F.lit(None).cast("double").alias("conf"), F.lit(None).cast("array<string>").alias("was"))
    return told.select("bucket", "text", "x", "y", "conf", F.when(F.col("bucket") == "corrected", F.col("was")).alias("was")).unionByName(unread)


def best_per_text(reads: DataFrame) -> DataFrame:
    """(bucket, ord, text, ...) to the most confident read of each text; the earlier bucket wins ties."""
    row = F.struct(*reads.columns)
    return reads.groupBy("text").agg(F.min_by(row, F.struct((-F.col("conf")).alias("c"), "bucket", "ord")).alias("r")).select("r.*")


def overlay(points: DataFrame, placed: DataFrame, best: DataFrame, contested: DataFrame) -> DataFrame:
    """A floor's points rebuilt: (id, x, y, kind, label, source, conf) each.

    By precedence: points that are no rooms or have a label stay; then decided places; then the best
    reads; then traced points, unless contested and not accepted before.
    """
    ranked = (
        points.where("kind != 'room' or label is not null").withColumn("rank", F.lit(0))
        .unionByName(placed.withColumn("rank", F.lit(1)))
        .unionByName(best.withColumn("rank", F.lit(2)))
        .unionByName(points.where("kind = 'room' and label is null").join(contested.select("id").withColumn("c", F.lit(True)), "id", "left").where("c is null or source = 'scan-accepted'").drop("c").withColumn("rank", F.lit(3)))
    )
    row = F.struct(*points.columns)
    return ranked.groupBy("id").agg(F.min_by(row, F.struct("rank", "x", "y")).alias("r")).select("r.*")


def prune_edges(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = points.select("id")
    return edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def transitions(stops: DataFrame, *, group: str = "day", seq: str = "seq", place: str = "place") -> DataFrame:
    """Consecutive non-blank stops of each group: (group, seq, from_place, to_place)."""
    order = Window.partitionBy(group).orderBy(seq)
    named = stops.where(F.trim(F.col(place)) != "")
    return named.withColumn("from_place", F.lag(place).over(order)).where(F.col("from_place").isNotNull()).select(group, seq, "from_place", F.col(place).alias("to_place"))


def summarize(legs: DataFrame, routes: DataFrame, tight_minutes: int = 7) -> DataFrame:
    """(from_key, to_key) with ``routes`` (from_key, to_key, minutes) to a status: the first of
    unknown-room, same-room, no-route, ok; tight if over ``tight_minutes``. Routes are joined once
    per distinct pair."""
    joined = legs.join(routes, ["from_key", "to_key"], "left")
    unknown = F.col("from_key").isNull() | F.col("to_key").isNull()
    status = F.when(unknown, "unknown-room").when(F.col("from_key") == F.col("to_key"), "same-room").when(F.col("minutes").isNull(), "no-route").otherwise("ok")
    return joined.withColumn("status", status).withColumn("tight", (F.col("status") == "ok") & (F.col("minutes") > tight_minutes))


def unsettled(words: DataFrame, reads: DataFrame, settled: float = MIN_CONFIDENCE) -> DataFrame:
    """Words (pocket, ...) of pockets that no valid read of the first pass (pocket, valid, conf) settled."""
    return words.join(reads.where(F.col("valid") & (F.col("conf") >= settled)).select("pocket"), "pocket", "left_anti")


def first_match(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted_id, key, label) to the item with that key, else the first by ``ord`` with that label."""
    by_key = wanted.join(items.select("key", F.lit(True).alias("known")), "key", "left")
    labels = items.groupBy("label").agg(F.min_by("key", "ord").alias("by_label"))
    return by_key.join(labels, "label", "left").select("wanted_id", F.when(F.col("known"), F.col("key")).otherwise(F.col("by_label")).alias("found"))
