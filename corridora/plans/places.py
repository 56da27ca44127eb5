"""Search, naming, differences, reviews and votes. Parts, customers and suppliers stand for places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import review, search, validate, voting
from ..sources import outdoor
from .registry import query, table

_NATURAL = "list_transform(regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(regexp_replace(r, '^0+(.)', '\\1'), 20, '0') ELSE r END)"
_INDEX = """idx AS (SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS key, p_name AS label, [p_brand, p_type] AS aliases, p_size AS floor_idx, p_partkey AS ord FROM part)"""


def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_partkey").cast("string").alias("id"), F.lit("main").alias("floor"), F.col("p_size").alias("floor_idx"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("label"), F.lit("room").alias("kind"), F.array("p_brand", "p_type").alias("aliases"))


def _score(name: str, q: str) -> str:
    return f"CASE WHEN lower({name}) = {q} THEN 0.0 WHEN starts_with(lower({name}), {q}) THEN 1.0 WHEN contains(lower({name}), {q}) OR starts_with('room ' || lower({name}), {q}) THEN 2.0 END"


@query(f"""WITH {_INDEX}, s AS (SELECT *, CAST(least({_score('label', "'ring'")}, list_min(list_transform(aliases, lambda a: {_score('a', "'ring'")} + 0.5))) AS DOUBLE) AS score FROM idx)
SELECT key, label, score FROM s WHERE score IS NOT NULL ORDER BY score, {_NATURAL.format('label')}, label, floor_idx, ord LIMIT 8""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(part_index(spark, sf_dir), " Ring ").select("key", "label", "score")


@query(f"""WITH {_INDEX}, q AS (SELECT * FROM (VALUES (1, 'red'), (2, 'brand#2'), (3, 'room s'), (4, 'o')) t(query_id, q)),
s AS (SELECT query_id, idx.*, CAST(least({_score('label', 'q')}, list_min([{_score('p_b', 'q')} + 0.5, {_score('p_t', 'q')} + 0.5])) AS DOUBLE) AS score
  FROM (SELECT *, aliases[1] AS p_b, aliases[2] AS p_t FROM idx) idx, q)
SELECT query_id, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, {_NATURAL.format('label')}, label, floor_idx, ord) AS rank FROM s WHERE score IS NOT NULL) WHERE rank <= 8""")
def ranked_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "red"), (2, "Brand#2"), (3, "room s"), (4, "o")], "query_id int, query string")
    return search.search_many(part_index(spark, sf_dir), asked).select("query_id", "key", "score", "rank")


@query(f"SELECT c_name, c_custkey FROM customer WHERE contains(c_name, '24') ORDER BY {_NATURAL.format('c_name')}, c_name LIMIT 8")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_name").contains("24")).select("c_name", "c_custkey").orderBy(*text.natural_order("c_name")).limit(8)


_POINTS = """pts AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'lower' WHEN 1 THEN 'main' ELSE 'upper' END AS floor, c_custkey % 3 AS floor_idx, c_custkey AS ord, CAST(c_custkey AS VARCHAR) AS id,
  CASE c_nationkey % 5 WHEN 0 THEN 'entrance' WHEN 1 THEN 'landmark' WHEN 2 THEN 'junction' WHEN 3 THEN 'poi' ELSE 'room' END AS kind,
  CASE WHEN c_nationkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 0 THEN c_name END AS label, CASE WHEN c_custkey % 2 = 0 THEN 'restroom' ELSE 'stairs' END AS poi_type,
  CAST(c_custkey * 37 % 3000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 2400 AS DOUBLE) AS y FROM customer)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    third, fifth = F.pmod("c_custkey", F.lit(3)), F.pmod("c_nationkey", F.lit(5))
    kind = F.when(fifth == 0, "entrance").when(fifth == 1, "landmark").when(fifth == 2, "junction").when(fifth == 3, "poi").otherwise("room")
    return c.select(
        F.when(third == 0, "lower").when(third == 1, "main").otherwise("upper").alias("floor"), third.alias("floor_idx"), F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("id"), kind.alias("kind"),
        F.when(fifth == 0, F.col("c_mktsegment")).when(F.pmod("c_custkey", F.lit(4)) == 0, F.col("c_name")).alias("label"), F.lit(None).cast("array<string>").alias("aliases"),
        F.when(F.pmod("c_custkey", F.lit(2)) == 0, "restroom").otherwise("stairs").alias("poi_type"), F.pmod(F.col("c_custkey") * 37, F.lit(3000)).cast("double").alias("x"), F.pmod(F.col("c_custkey") * 91, F.lit(2400)).cast("double").alias("y"),
    )


_BUILT = f"""{_POINTS}, named AS (SELECT *, CASE WHEN kind = 'poi' THEN CASE WHEN poi_type = 'restroom' THEN 'restroom' END WHEN kind = 'junction' THEN NULL ELSE kind END AS k,
  coalesce(label, CASE WHEN kind = 'poi' THEN 'Restroom' END, id) AS l FROM pts),
built AS (SELECT floor || ':' || id AS key, id, floor, l AS label, k AS kind FROM named WHERE k IS NOT NULL AND k <> 'entrance'
  UNION ALL SELECT 'entrance:' || l, id, floor, l, k FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY floor_idx, ord) AS rn FROM named WHERE k = 'entrance') WHERE rn = 1)"""


@query(f"WITH {_BUILT} SELECT * FROM built")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.build_index(points(spark, sf_dir)).select("key", "id", "floor", "label", "kind")


@query(f"""WITH {_BUILT}, wanted AS (SELECT o_orderkey AS place_id, CASE o_orderkey % 4 WHEN 0 THEN 'Room ' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN ' building ' WHEN 2 THEN 'Restroom' ELSE 'nowhere' END AS text,
  CASE WHEN o_orderkey % 5 = 0 THEN 'main:' || CAST(o_custkey AS VARCHAR) END AS key FROM orders),
n AS (SELECT lower(label) AS name, count(*) AS n, min(key) AS k FROM built GROUP BY 1)
SELECT place_id, coalesce(b.key, CASE WHEN n.n = 1 THEN n.k END) AS resolved FROM wanted w LEFT JOIN built b ON b.key = w.key
LEFT JOIN n ON n.name = regexp_replace(lower(trim(w.text)), '^room[ ]+', '')""")
def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    fourth = F.pmod("o_orderkey", F.lit(4))
    said = F.when(fourth == 0, F.concat(F.lit("Room "), F.col("o_custkey").cast("string"))).when(fourth == 1, " building ").when(fourth == 2, "Restroom").otherwise("nowhere")
    wanted = o.select(F.col("o_orderkey").alias("place_id"), said.alias("text"), F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.concat(F.lit("main:"), F.col("o_custkey").cast("string"))).alias("key"))
    return search.resolve_places(search.build_index(points(spark, sf_dir)), wanted).select("place_id", "resolved")


@query(f"WITH {_POINTS} SELECT id, floor FROM pts WHERE kind = 'poi' AND poi_type = 'restroom'")
def restroom_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return search.endpoints(search.build_index(p), p, search.NEAREST_RESTROOM).select("id", "floor")


#: Ids that three floors share.
_SHARED = _BUILT.replace("CAST(c_custkey AS VARCHAR) AS id", "CAST(c_custkey // 3 AS VARCHAR) AS id")


@query(f"""WITH {_SHARED} SELECT key AS pick_id, pts.floor, pts.id FROM built JOIN pts ON pts.id = built.id AND (built.kind = 'entrance' OR pts.floor = built.floor)
UNION ALL SELECT 'nearest', floor, id FROM pts WHERE kind = 'poi' AND poi_type = 'restroom'""")
def picked_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every row of the index, and the nearest restroom, can mean."""
    p = points(spark, sf_dir).withColumn("id", F.floor(F.col("ord") / 3).cast("string"))
    index = search.build_index(p)
    nearest = spark.range(1).select(F.lit("nearest").alias("pick_id"), F.lit(search.NEAREST_RESTROOM).alias("key"))
    return search.endpoints_of(index, p, index.select(F.col("key").alias("pick_id"), "key").union(nearest))


@query(f"WITH {_POINTS} SELECT id, floor FROM pts WHERE kind = 'poi' AND poi_type = 'stairs'")
def stair_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.marks(points(spark, sf_dir)).select("id", "floor")


_TOKENS = "regexp_extract_all(translate(upper({0}), 'O', '0'), '\\b[0-9]{{3}}[A-Z]?\\b')"


@query(f"SELECT page_id, CAST(len({_TOKENS.format('url')}) AS INTEGER) AS n, array_to_string({_TOKENS.format('url')}, ',') AS tokens FROM pages")
def room_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.room_tokens("url")
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n"), F.array_join(found, ",").alias("tokens"))


@query(f"""WITH rooms AS (SELECT 'r:' || CAST(p_partkey AS VARCHAR) AS key, CAST(p_partkey AS VARCHAR) AS name FROM part),
t AS (SELECT page_id, generate_subscripts({_TOKENS.format('url')}, 1) AS pos, unnest({_TOKENS.format('url')}) AS token FROM pages),
tries AS (SELECT page_id, pos, 0 AS rank, token AS name FROM t UNION ALL SELECT page_id, pos, 1, substr(token, 1, 3) FROM t)
SELECT page_id AS text_id, arg_min(key, (pos, rank, key)) AS key FROM tries JOIN rooms USING (name) GROUP BY 1""")
def rooms_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.lit("room").alias("kind"), F.concat(F.lit("r:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_partkey").cast("string").alias("label"))
    return search.rooms_in_text(p, table(spark, sf_dir, "pages").select(F.col("page_id").alias("text_id"), F.col("url").alias("text")))


_CASES = " ".join(f"WHEN regexp_matches(lower(p_name || ' ' || p_type), '{pattern}') THEN '{kind}'" for kind, pattern in [("sports", "ring|gear"), ("food", "bolt"), ("office", "admin|small")])


@query(f"SELECT CASE {_CASES} ELSE 'other' END AS category, count(*) AS n FROM part GROUP BY 1")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = text.category(F.concat_ws(" ", "p_name", "p_type"), [("sports", "ring|gear"), ("food", "bolt"), ("office", "admin|small")])
    return table(spark, sf_dir, "part").groupBy(kinds.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda h, c: (((h * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648)) AS hash FROM part""")
def hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", numbers.hash31("p_name").alias("hash"))


@query("SELECT s_suppkey, CASE WHEN regexp_matches(l, '^[0-9]') AND k = 'room' THEN 'Room ' || l ELSE l END AS said, regexp_matches(l, '^[1-4][0-9][0-9][A-Z]?$') AS valid, sha256(l) AS digest FROM (SELECT s_suppkey, CAST(s_suppkey * 13 AS VARCHAR) || CASE WHEN s_suppkey % 3 = 0 THEN 'B' ELSE '' END AS l, CASE WHEN s_suppkey % 2 = 0 THEN 'room' ELSE 'landmark' END AS k FROM supplier)")
def room_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat((F.col("s_suppkey") * 13).cast("string"), F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "B").otherwise("")).alias("l"), F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "room").otherwise("landmark").alias("k"))
    return s.select("s_suppkey", text.room_label("l", "k").alias("said"), text.room_grammar("l").alias("valid"), F.sha2("l", 256).alias("digest"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 3 = 1)")
def valid_sponsors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    url = F.when(F.pmod("s_suppkey", F.lit(3)) == 1, "https://a.example").when(F.pmod("s_suppkey", F.lit(3)) == 2, "http://a.example")
    rows = s.select(F.col("s_suppkey").alias("id"), F.when(F.pmod("s_suppkey", F.lit(7)) != 0, F.col("s_name")).alias("name"), F.lit("t").alias("text"), url.alias("url"))
    return validate.valid_sponsors(rows).select("id")


_DIFF = """a AS (SELECT c_custkey AS id, c_acctbal AS x, c_acctbal * 2 AS y, c_name AS label FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT c_custkey AS id, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 0 END AS x, c_acctbal * 2 AS y, CASE WHEN c_custkey % 13 = 0 THEN 'new' ELSE c_name END AS label FROM customer WHERE c_custkey % 11 <> 0),
j AS (SELECT coalesce(a.id, b.id) AS id, a.id AS ai, b.id AS bi, a.label AS al, b.label AS bl,
  CAST(CAST(floor(a.x + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(a.y + 0.5) AS BIGINT) AS VARCHAR) AS pa, CAST(CAST(floor(b.x + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(b.y + 0.5) AS BIGINT) AS VARCHAR) AS pb
  FROM a FULL JOIN b ON a.id = b.id)"""


@query(f"""WITH {_DIFF} SELECT 'added' AS kind, id, pb AS detail FROM j WHERE ai IS NULL UNION ALL SELECT 'removed', id, pa FROM j WHERE bi IS NULL
  UNION ALL SELECT 'moved', id, pa || ' -> ' || pb FROM j WHERE pa <> pb UNION ALL SELECT 'renamed', id, al || ' -> ' || bl FROM j WHERE al <> bl""")
def dataset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    base = c.where(key % 7 != 0).select(key.alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_acctbal") * 2).alias("y"), F.col("c_name").alias("label"))
    following = c.where(key % 11 != 0).select(key.alias("id"), (F.col("c_acctbal") + F.when(key % 5 == 0, 3).otherwise(0)).alias("x"), (F.col("c_acctbal") * 2).alias("y"), F.when(key % 13 == 0, "new").otherwise(F.col("c_name")).alias("label"))
    return review.diff_points(base, following)


@query("""WITH o AS (SELECT DISTINCT least(o_custkey, o_orderkey % 50) AS a, greatest(o_custkey, o_orderkey % 50) AS b FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT DISTINCT least(o_custkey, o_orderkey % 50) AS a, greatest(o_custkey, o_orderkey % 50) AS b FROM orders WHERE o_orderkey % 3 <> 0)
SELECT 'added' AS kind, a, b FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', a, b FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).alias("a"), F.col("o_custkey").alias("b"))
    return review.diff_edges(e.where("o_orderkey % 2 = 0"), e.where("o_orderkey % 3 != 0"))


@query("""WITH c AS (SELECT o_orderkey AS ord, o_orderkey % 2 AS bucket, CAST(o_custkey AS VARCHAR) AS text, (o_orderkey % 100) / 100.0 AS conf FROM orders),
r AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 3 = 0)
SELECT text, CAST(conf AS DOUBLE) AS conf, bucket, ord FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY bucket, ord) AS rn FROM c WHERE conf < 0.5 AND text NOT IN (SELECT id FROM r)) WHERE rn = 1""")
def review_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 2).alias("bucket"), F.col("o_custkey").cast("string").alias("text"), ((F.col("o_orderkey") % 100) / 100.0).alias("conf"))
    rooms = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    return review.suggestions(c, rooms).select("text", "conf", "bucket", "ord")


@query("""SELECT DISTINCT CAST(doc_id AS VARCHAR) AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 10 <> 0""")
def missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("label"), "doc_id")
    rooms = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return review.missing(d.select("label"), rooms, d.where("doc_id % 10 = 0").select(F.col("label").alias("text")))


_READS = """reads AS (SELECT c_custkey AS read_id, CAST(c_custkey % 200 AS VARCHAR) AS text, CAST(c_custkey * 37 % 3000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 2400 AS DOUBLE) AS y,
  (c_custkey % 10) / 10.0 AS conf, c_custkey % 6 <> 0 AS valid FROM customer)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("read_id"), (k % 200).cast("string").alias("text"), (k * 37 % 3000).cast("double").alias("x"), (k * 91 % 2400).cast("double").alias("y"), ((k % 10) / 10.0).alias("conf"), (k % 6 != 0).alias("valid"))


@query(f"""WITH {_READS}, s AS (SELECT * FROM reads WHERE valid AND conf >= 0.5),
bad AS (SELECT DISTINCT a.read_id FROM s a JOIN s b ON a.read_id <> b.read_id AND ((a.text = b.text AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) > 60) OR (a.text <> b.text AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 20)))
SELECT read_id, CAST(CASE WHEN b.read_id IS NOT NULL THEN least(conf, 0.3) ELSE conf END AS DOUBLE) AS conf, CASE WHEN b.read_id IS NOT NULL THEN 'conflict' END AS opinion
FROM reads LEFT JOIN bad b USING (read_id)""")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.settle_conflicts(reads(spark, sf_dir)).select("read_id", "conf", "opinion")


@query(f"""WITH {_READS}, claims AS (SELECT read_id, CAST(read_id * 3 % 300 AS VARCHAR) AS point_id FROM reads WHERE read_id % 4 <> 0 UNION SELECT read_id, text FROM reads WHERE read_id % 8 = 1),
traced AS (SELECT CAST(i AS VARCHAR) AS point_id, CASE WHEN i % 9 = 0 THEN 'L' || CAST(i AS VARCHAR) END AS label, CAST(i AS DOUBLE) AS x, CAST(i * 2 AS DOUBLE) AS y FROM range(320) t(i)),
rej AS (SELECT text, x + 50 AS x, y AS y FROM reads WHERE read_id % 12 = 1),
named AS (SELECT c.read_id, list_sort(list(DISTINCT coalesce(t.label, t.point_id))) AS was FROM claims c JOIN traced t USING (point_id) GROUP BY 1),
told AS (SELECT r.*, n.was, CASE WHEN EXISTS (SELECT 1 FROM rej d WHERE d.text = r.text AND sqrt((r.x-d.x)*(r.x-d.x)+(r.y-d.y)*(r.y-d.y)) <= 120) THEN 'rejected' WHEN list_contains(n.was, r.text) THEN 'confirmed' WHEN len(n.was) > 0 THEN 'corrected' ELSE 'found' END AS bucket
  FROM reads r LEFT JOIN named n USING (read_id) WHERE valid)
SELECT bucket, text, x, y, array_to_string(CASE WHEN bucket = 'corrected' THEN was END, ',') AS was FROM told
UNION ALL SELECT 'unread', coalesce(label, point_id), x, y, NULL FROM traced WHERE point_id NOT IN (SELECT c.point_id FROM claims c JOIN told USING (read_id) WHERE bucket IN ('confirmed', 'corrected'))""")
def reconciled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    claims = r.where("read_id % 4 != 0").select("read_id", (F.col("read_id") * 3 % 300).cast("string").alias("point_id")).union(r.where("read_id % 8 = 1").select("read_id", "text")).distinct()
    i = F.col("id")
    traced = spark.range(320).select(i.cast("string").alias("point_id"), F.when(i % 9 == 0, F.concat(F.lit("L"), i.cast("string"))).alias("label"), i.cast("double").alias("x"), (i * 2).cast("double").alias("y"))
    rejects = r.where("read_id % 12 = 1").select("text", (F.col("x") + 50).alias("x"), "y")
    return review.reconcile(r, claims, traced, rejects).select("bucket", "text", "x", "y", F.array_join("was", ",").alias("was"))


@query(f"WITH {_READS} SELECT text, read_id AS ord, CAST(conf AS DOUBLE) AS conf, bucket FROM (SELECT *, read_id % 3 AS bucket, row_number() OVER (PARTITION BY text ORDER BY conf DESC, read_id % 3, read_id) AS rn FROM reads) WHERE rn = 1")
def best_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).select("text", F.col("read_id").alias("ord"), "conf", (F.col("read_id") % 3).alias("bucket"))
    return review.best_per_text(r)


@query(f"""WITH {_POINTS}, o AS (SELECT id, x, y, kind, label, 0 AS rank FROM pts WHERE kind <> 'room' OR label IS NOT NULL
UNION ALL SELECT id, x + 1, y, 'room', NULL, 1 FROM pts WHERE ord % 10 = 4 UNION ALL SELECT CAST(ord + 5 AS VARCHAR), x + 2, y, 'room', NULL, 2 FROM pts WHERE ord % 9 = 0
UNION ALL SELECT id, x, y, kind, label, 3 FROM pts WHERE kind = 'room' AND label IS NULL AND ord % 6 <> 1)
SELECT id, x, y, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, x, y) AS rn FROM o) WHERE rn = 1""")
def rebuilt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", "x", "y", "kind", "label", F.lit("traced").alias("source"), "ord")
    new = lambda df, idc, dx: df.select(idc.alias("id"), (F.col("x") + dx).alias("x"), "y", F.lit("room").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit("scan").alias("source"))
    kept = p.drop("ord")
    return review.overlay(kept, new(p.where("ord % 10 = 4"), F.col("id"), 1), new(p.where("ord % 9 = 0"), (F.col("ord") + 5).cast("string"), 2), p.where("ord % 6 = 1").select("id")).drop("source")


@query("SELECT l_orderkey AS a, l_suppkey AS b FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) AND l_suppkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")
def pruned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"))
    return review.prune_edges(e, table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"))).select("a", "b")


@query("""WITH v AS (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE CAST(100 + CAST(value AS INTEGER) % 30 AS VARCHAR) END AS text FROM events),
s AS (SELECT user_id, text, regexp_matches(text, '^[1-4][0-9][0-9][A-Z]?$') AS valid, sum(CASE WHEN regexp_matches(text, '^[1-4][0-9][0-9][A-Z]?$') THEN 2 ELSE 1 END) AS score FROM v GROUP BY 1, 2)
SELECT user_id, text, valid, CAST(score AS BIGINT) AS score, CAST(least(1.0, score / 24.0) AS DOUBLE) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid DESC, score DESC, text) AS rn FROM s) WHERE rn = 1""")
def weighted_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.bround("value", 0).cast("int")
    v = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 4 == 0, "bad").otherwise((100 + whole % 30).cast("string")).alias("said"))
    return voting.weighted_vote(v, ["user_id"], "said", text.room_grammar("said"))


@query(f"WITH {_READS} SELECT text AS crop, read_id AS ord, CAST(conf AS DOUBLE) AS conf, valid FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY valid DESC, conf DESC, read_id) AS rn FROM reads) WHERE rn = 1")
def best_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.best_read(reads(spark, sf_dir).select(F.col("text").alias("crop"), F.col("read_id").alias("ord"), "conf", "valid"), ["crop"])


_DOT = "list_sum(list_transform(range(1, len(q.e) + 1), lambda i: CAST(q.e[i] AS DOUBLE) * CAST(t.e[i] AS DOUBLE)))"
_NEIGHBOURS = """e AS (SELECT vec_id AS id, embedding AS e, label FROM embeddings),
s AS (SELECT q.id AS q_id, t.label, max(""" + _DOT + """) AS score FROM e q JOIN e t ON q.id <> t.id WHERE {where} GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, label) AS rn, lead(score) OVER (PARTITION BY q_id ORDER BY score DESC, label) AS nxt FROM s)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t_id"), F.col("embedding").alias("t"), "label")


@query(f"WITH {_NEIGHBOURS.replace('{where}', 'q.id % 50 = 0')} SELECT q_id, label, round(score, 6) AS score, round(score - nxt, 6) AS margin FROM k WHERE rn = 1")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    # a stated query set, every fiftieth id, against all rows
    found = voting.classify(v.where("t_id % 50 = 0").select(F.col("t_id").alias("q_id"), F.col("t").alias("q")), v)
    return found.select("q_id", "label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(f"WITH {_NEIGHBOURS.replace('{where}', 'true')} SELECT count(*) AS n, round(avg(CASE WHEN k.label = e.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM k JOIN e ON e.id = q_id WHERE rn = 1")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.leave_one_out(_vectors(spark, sf_dir)).select("n", F.round("accuracy", 6).alias("accuracy"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(100 + l_partkey % 50 AS VARCHAR) || CASE WHEN l_linenumber = 3 THEN 'B' ELSE '' END AS text, CAST(100 + l_suppkey % 50 AS VARCHAR) AS template, l_discount * 8 AS conf, 0.7 + l_tax * 4 AS score, l_discount AS margin FROM lineitem),
o AS (SELECT *, CASE WHEN substr(text, 1, 3) = template AND score >= 0.75 THEN 'agree' WHEN substr(text, 1, 3) <> template AND score >= 0.9 AND margin >= 0.1 THEN 'dispute' ELSE 'silent' END AS opinion FROM r)
SELECT opinion, count(*) AS n, round(sum(CASE WHEN opinion = 'agree' AND length(text) = 3 THEN greatest(conf, 0.75) WHEN opinion = 'dispute' THEN least(conf, 0.25) ELSE conf END), 4) AS conf FROM o GROUP BY 1""")
def second_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    said = F.concat((100 + F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_linenumber") == 3, "B").otherwise(""))
    r = l.select(said.alias("text"), (100 + F.col("l_suppkey") % 50).cast("string").alias("template"), (F.col("l_discount") * 8).alias("conf"), (0.7 + F.col("l_tax") * 4).alias("score"), F.col("l_discount").alias("margin"))
    return voting.second_opinion(r).groupBy("opinion").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("conf"), 4).alias("conf"))


@query("SELECT p_brand AS name, p_partkey AS id, p_retailprice AS feet FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1 AND p_retailprice >= 950")
def longest_named_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("id"), F.col("p_partkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("p_retailprice").alias("feet"))
    return outdoor.longest_named(roads, 950.0).select("name", F.col("x").cast("long").alias("id"), "feet")


@query("SELECT p_name AS text, p_partkey AS id, CAST(p_size AS DOUBLE) AS area FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def largest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.col("p_partkey").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("p_size").cast("double").alias("area"))
    return outdoor.largest_label(labels).select("text", "id", "area")


@query("SELECT p_partkey AS id, kind, rank FROM part JOIN (VALUES ('ECONOMY', 'grass', 1), ('SMALL', 'water', 2), ('PROMO', 'path', 3)) k(class, kind, rank) ON p_type = class")
def classified_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("ECONOMY", "grass", 1), ("SMALL", "water", 2), ("PROMO", "path", 3)], "class string, kind string, rank int")
    return outdoor.classify(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("class"), F.col("p_size").alias("area")), kinds).select("id", "kind", "rank")
