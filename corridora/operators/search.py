"""A unified index of places, ranked text search and exact resolution."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import natural_order, room_tokens, strip_room
from .lineage import cut, grown

# Words that ask for the nearest restroom.
RESTROOM_WORDS = ["restroom", "restrooms", "bathroom", "bathrooms", "toilet", "washroom", "wc"]
NEAREST_RESTROOM = "__nearest_restroom__"


def build_index(points: DataFrame) -> DataFrame:
    """points (floor, floor_idx, ord, id, kind, label, aliases, poi_type) to search rows.

    Rooms, landmarks and restrooms are keyed ``floor:id``; an entrance is listed once by its name,
    from the first floor that has it; other points drop out.
    """
    restroom = (F.col("kind") == "poi") & (F.col("poi_type") == "restroom")
    kind = F.when(restroom, "restroom").when(F.col("kind").isin("room", "landmark", "entrance"), F.col("kind"))
    label = F.coalesce("label", F.when(restroom, "Restroom"), "id")
    named = points.withColumns({"kind": kind, "label": label}).where(F.col("kind").isNotNull())
    rest = F.struct(*[c for c in named.columns if c != "label"])
    doors = named.where("kind = 'entrance'").groupBy("label").agg(F.min_by(rest, F.struct("floor_idx", "ord")).alias("r")).select("label", "r.*").withColumn("key", F.concat(F.lit("entrance:"), "label"))
    rest = named.where("kind != 'entrance'").withColumn("key", F.concat_ws(":", "floor", "id"))
    return rest.unionByName(doors).select("key", "id", "floor", "floor_idx", "ord", "label", "kind", "aliases")


def match_score(name: Column, query: Column) -> Column:
    """0 equal, 1 prefix, 2 inside or ``room <name>`` starts with the query; null if no match."""
    n = F.lower(name)
    return F.when(n == query, 0.0).when(n.startswith(query), 1.0).when(n.contains(query) | F.concat(F.lit("room "), n).startswith(query), 2.0)


def search(index: DataFrame, query: str, *, has_restrooms: bool = False, limit: int = 8) -> DataFrame:
    """The best ``limit`` rows: by score (an alias costs 0.5), then natural label, then order."""
    q = query.strip().lower()
    if not q:
        return index.withColumns({"score": F.lit(0.0), "special": F.lit(0)}).limit(0)
    alias = F.array_min(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: match_score(a, F.lit(q)) + 0.5))
    scored = index.withColumn("score", F.least(match_score(F.col("label"), F.lit(q)), alias)).where(F.col("score").isNotNull()).withColumn("special", F.lit(1))
    if has_restrooms and any(w.startswith(q) for w in RESTROOM_WORDS):
        values = {"key": NEAREST_RESTROOM, "id": NEAREST_RESTROOM, "floor": "main", "label": "Nearest restroom", "kind": "nearest-restroom", "score": 0.0, "special": 0}
        row = index.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in scored.schema])
        scored = scored.unionByName(row)
    return scored.orderBy("special", "score", *natural_order("label"), "floor_idx", "ord").limit(limit)


#: Rows of an index that short searches can rank at most.
MOST_RANKS = 50
_ORDER = ["floor_idx", "ord"]


class Substrings(NamedTuple):
    """What :func:`search_many` looks texts up in, made once an index.

    ``names``: (gram, key, name, cost), each name under every three letters of it; ``counts``: (gram, n) of names;
    ``short``: (gram, key, score, rank), the best rows for each search of one or two letters; ``first``: (key, rank),
    the first rows of all.
    """

    names: DataFrame
    counts: DataFrame
    short: DataFrame
    first: DataFrame


def _grams(text: Column, n: int) -> Column:
    """The different runs of ``n`` letters of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.char_length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _names(index: DataFrame) -> DataFrame:
    """(key, name, cost) of labels and aliases."""
    label = F.struct(F.lower("label").alias("name"), F.lit(0.0).alias("cost"))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("name"), F.lit(0.5).alias("cost")))
    return index.select("key", F.explode(F.concat(F.array(label), aliases)).alias("n")).select("key", "n.*").where("name is not null")


def substrings(index: DataFrame, asked: DataFrame | None = None) -> Substrings:
    """The lookup tables of an index (keys differ), written once to be kept.

    With ``asked`` (gram), for one batch of searches, they hold only these runs of letters, and only what is read twice
    is written.
    """
    names = _names(index)
    wanted = (lambda df: df) if asked is None else (lambda df: df.join(asked, "gram", "left_semi"))
    keep = cut if asked is None else (lambda df: df)
    long = cut(wanted(names.select(F.explode(_grams(F.col("name"), 3)).alias("gram"), "key", "name", "cost")))
    counts = keep(long.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    few = wanted(names.select(F.explode(F.array_union(_grams(F.col("name"), 1), _grams(F.col("name"), 2))).alias("gram"), "key", "name", "cost"))
    few = few.groupBy("gram", "key").agg(F.min(match_score(F.col("name"), F.col("gram")) + F.col("cost")).alias("score"))
    order = [*natural_order("label"), *_ORDER, "key"]
    # ranks up to a limit: every task keeps as many rows of a gram before the shuffle
    best = Window.partitionBy("gram").orderBy("score", *order)
    short = few.join(grown(index.select("key", "label", *_ORDER)), "key").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MOST_RANKS)
    first = index.select("key", "label", *_ORDER).orderBy(*order).limit(MOST_RANKS)
    return Substrings(long, counts, keep(short.select("gram", "key", "score", "rank")), keep(first.select("key")))


def search_many(index: DataFrame, queries: DataFrame, *, limit: int = 8, built: Substrings | None = None) -> DataFrame:
    """(query_id, query) to ranked rows of each: as :func:`search`, without the row for restrooms.

    A search of three letters and more meets the names under its rarest three letters, which then are compared;
    a shorter one its ready ranks; "room ..." also the names under the rest of it. All joins are by key, so
    neither searches nor index are broadcast or held whole. ``built``: tables of :func:`substrings`, to be kept where
    batches follow each other; without, the index is read for the letters of this batch alone.
    """
    if limit > MOST_RANKS:
        raise ValueError(f"limits go up to {MOST_RANKS}")
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where("q != ''")
    rest = q.where("startswith(q, 'room ')").select("query_id", "q", F.substring("q", 6, 1_000_000).alias("sought"))
    sought = q.select("query_id", "q", F.col("q").alias("sought")).union(rest).where("sought != ''")
    grams = sought.where("char_length(sought) >= 3").withColumn("gram", F.explode(_grams(F.col("sought"), 3)))
    short = sought.where("char_length(sought) < 3")
    t = built or substrings(index, grams.select("gram").union(short.select("sought")).distinct())
    # a gram that no name has is the rarest: no name has the search then
    rarest = grams.join(t.counts, "gram", "left").groupBy("query_id", "q", "sought").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    score = match_score(F.col("name"), F.col("q")) + F.col("cost")
    long = rarest.join(grown(t.names), "gram").where("contains(name, sought)").select("query_id", "key", score.alias("score"))
    exact = short.where("q = sought").join(t.short, F.col("sought") == F.col("gram")).select("query_id", "key", "score")
    begun = short.where("q != sought").join(grown(_names(index).select("key", "name", "cost", F.explode(F.array(F.substring("name", 1, 1), F.substring("name", 1, 2))).alias("gram"))), F.col("sought") == F.col("gram")).select("query_id", "key", score.alias("score"))
    # the beginnings of "room " find every row
    listed = t.first.agg(F.collect_list("key").alias("keys"))
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring(F.lit("room"), F.lit(1), n)))
    every = q.join(listed.select(begins.alias("q"), "keys"), "q").select("query_id", F.explode("keys").alias("key"), F.lit(2.0).alias("score"))
    found = long.union(exact).union(begun).union(every).where("score is not null").groupBy("query_id", "key").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", *natural_order("label"), *_ORDER, "key")
    ranked = found.join(grown(index), "key").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.join(queries.select("query_id", "query"), "query_id")


def resolve_places(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(place_id, text, key) to the one place each means, or null.

    A known key decides; else the text without ``room``: a label or alias that equals it, if exactly
    one label does, or if exactly one match does.
    """
    by_key = wanted.join(index.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left").select("place_id", "text", F.col("k").alias("direct"))
    names = index.select("key", F.lower("label").alias("name"), F.lit(True).alias("own")).union(index.select("key", F.explode("aliases").alias("a"), F.lit(False)).select("key", F.lower("a"), F.lit(False)))
    names = names.groupBy("name", "key").agg(F.max("own").alias("own"))
    found = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"), F.min(F.when(F.col("own"), F.col("key"))).alias("own_key"), F.min("key").alias("any_key"))
    text = by_key.withColumn("name", strip_room("text"))
    joined = text.join(found, "name", "left")
    exact = F.when(F.col("n_own") == 1, F.col("own_key")).when(F.col("n") == 1, F.col("any_key"))
    return joined.select("place_id", "text", F.coalesce("direct", F.when(F.col("name") != "", exact)).alias("resolved"))


def endpoints(index: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """The points a chosen row can mean: every restroom, an entrance on each floor, or one point."""
    if key == NEAREST_RESTROOM:
        return points.where("kind = 'poi' and poi_type = 'restroom'")
    item = index.where(F.col("key") == key).select(F.col("id").alias("__id"), F.col("floor").alias("__floor"), F.col("kind").alias("__kind"))
    same = (F.col("id") == F.col("__id")) & ((F.col("__kind") == "entrance") | (F.col("floor") == F.col("__floor")))
    return points.join(F.broadcast(item), same, "left_semi")


def endpoints_of(index: DataFrame, points: DataFrame, picks: DataFrame) -> DataFrame:
    """picks (pick_id, key) to (pick_id, floor, id) of all points that each can mean: as :func:`endpoints`, for any
    number of picks, by joins of keys."""
    item = picks.join(index.select("key", F.col("id").alias("__id"), F.col("floor").alias("__floor"), F.col("kind").alias("__kind")), "key")
    place = points.select("floor", "id")
    doors = item.where("__kind = 'entrance'").select("pick_id", F.col("__id").alias("id")).join(place, "id").select("pick_id", "floor", "id")
    one = item.where("__kind != 'entrance'").select("pick_id", F.col("__floor").alias("floor"), F.col("__id").alias("id")).join(place, ["floor", "id"]).select("pick_id", "floor", "id")
    rest = points.where("kind = 'poi' and poi_type = 'restroom'").select(F.lit(NEAREST_RESTROOM).alias("key"), "floor", "id")
    return doors.union(one).union(picks.join(rest, "key").select("pick_id", "floor", "id"))


def rooms_in_text(index: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, text) to the first known room number it says (with its letter, else its digits)."""
    said = texts.select("text_id", F.posexplode(room_tokens("text")).alias("at", "token"))
    tries = said.withColumn("try", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("token").alias("name")), F.struct(F.lit(1).alias("rank"), F.substring("token", 1, 3).alias("name")))))
    rooms = index.where("kind = 'room'").select("key", F.upper("label").alias("name"))
    hit = tries.select("text_id", "at", "try.rank", "try.name").join(rooms, "name")
    return hit.groupBy("text_id").agg(F.min_by("key", F.struct("at", "rank", "key")).alias("key"))


# Kinds of labels by rank, what is drawn first where two collide.
LABEL_RANK = ("landmark", "entrance", "restroom", "stairs", "room")


def label_items(points: DataFrame) -> DataFrame:
    """points (floor, id, kind, label, poi_type, ...) to (key, text, label_kind, rank) of every place that has a name.

    A room whose label says a word of three letters or more is a landmark; restrooms and stairs have
    names of their own; other points of interest and junctions have no label.
    """
    wordy = F.coalesce(F.col("label").rlike("(?i)[a-z]{3}"), F.lit(False))
    poi = F.when(F.col("poi_type").isin("restroom", "stairs"), F.col("poi_type"))
    kind = F.when(F.col("kind") == "room", F.when(wordy, "landmark").otherwise("room")).when(F.col("kind") == "poi", poi).when(F.col("kind").isin("landmark", "entrance"), F.col("kind"))
    named = points.withColumn("label_kind", kind).where("label_kind is not null")
    own = F.when(F.col("label_kind").isin("restroom", "stairs"), F.initcap("label_kind")).otherwise(F.col("id"))
    given = F.when(F.col("label_kind").isin("restroom", "stairs") & (F.col("label") == ""), None).otherwise(F.col("label"))
    rank = F.array_position(F.array(*map(F.lit, LABEL_RANK)), F.col("label_kind")).cast("int")
    return named.withColumns({"key": F.concat_ws(":", "floor", "id"), "text": F.coalesce(given, own), "rank": rank})


def all_links(marked: DataFrame, guessed: DataFrame) -> DataFrame:
    """Stair links that are marked and those guessed from marks, told apart by ``origin``."""
    return marked.withColumn("origin", F.lit("marked")).unionByName(guessed.withColumn("origin", F.lit("guessed")), allowMissingColumns=True)


def marks(points: DataFrame) -> DataFrame:
    """Stair markers in floor order."""
    return points.where("kind = 'poi' and poi_type = 'stairs'").orderBy("floor_idx", "ord")
