"""Walk reports: validation, estimates, logs, transitions. ``events`` rows stand for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import estimates, review, validate
from ..sources import reports as logs
from .registry import query, table

NOW = 1_704_110_400_000  # 2024-01-01 12:00:00 UTC

_REPORTS = """reports AS (SELECT 'p' || CAST(user_id % 40 AS VARCHAR) AS "from", 'p' || CAST(event_id % 40 AS VARCHAR) AS "to", value * 10 + 20 AS feet,
  event_id % 3 AS flights, CAST(5 + event_id * 7 % 600 AS DOUBLE) AS seconds, epoch_us(ts) // 1000 AS "at", event_id AS ord FROM events),
paced AS (SELECT *, feet / greatest(seconds - 25 * flights, 1) AS pace FROM reports),
judged AS (SELECT *, CASE WHEN seconds < 10 THEN 'too_quick' WHEN seconds > 1200 THEN 'too_long' WHEN pace > 10 THEN 'too_fast' WHEN pace < 1 THEN 'too_slow' END AS reason FROM paced),
valid AS (SELECT *, ("at" // 60000) % 1440 AS minute, least("from", "to") AS a, greatest("from", "to") AS b FROM judged WHERE reason IS NULL AND length("from") BETWEEN 1 AND 64 AND length("to") BETWEEN 1 AND 64 AND feet > 0 AND flights >= 0)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    place = lambda c: F.concat(F.lit("p"), F.pmod(F.col(c), F.lit(40)).cast("string"))
    return e.select(
        place("user_id").alias("from"), place("event_id").alias("to"), (F.col("value") * 10 + 20).alias("feet"), F.pmod("event_id", F.lit(3)).alias("flights"),
        (5 + F.pmod(F.col("event_id") * 7, F.lit(600))).cast("double").alias("seconds"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("ord"),
    )


@query(f"WITH {_REPORTS} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM judged GROUP BY 1")
def report_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).groupBy(F.coalesce(validate.reject_reason(), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_REPORTS} SELECT \"from\", \"to\", ord, round(pace, 6) AS pace FROM valid")
def valid_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.valid_reports(reports(spark, sf_dir)).select("from", "to", "ord", F.round(validate.pace(), 6).alias("pace"))


@query(f"""WITH {_REPORTS} SELECT ord, CAST(floor(feet + 0.5) AS BIGINT) AS feet, CAST(flights AS BIGINT) AS flights, CAST(floor(seconds + 0.5) AS BIGINT) AS seconds,
  CASE WHEN abs({NOW} - "at") < 86400000 THEN "at" ELSE {NOW} END AS "at" FROM valid WHERE feet <= 5000 AND flights <= 4""")
def cleaned_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.clean_reports(reports(spark, sf_dir), NOW).select("ord", "feet", "flights", "seconds", "at")


@query(f"WITH {_REPORTS} SELECT \"from\", count(*) AS n, round(median(pace), 6) AS pace FROM valid GROUP BY 1")
def pace_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates.exact_medians(validate.valid_reports(reports(spark, sf_dir)), ["from"], validate.pace()).select("from", "n", F.round("median", 6).alias("pace"))


@query(f"""WITH {_REPORTS} SELECT m.minute, count(*) AS n_now, round(median(pace), 6) AS pace_now FROM valid v JOIN (SELECT unnest([0, 5, 710, 1430]) AS minute) m
  ON least(abs(v.minute - m.minute), 1440 - abs(v.minute - m.minute)) <= 30 GROUP BY 1""")
def circular_time_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(0,), (5,), (710,), (1430,)], "minute int")
    found = estimates.pace_by_minute(validate.valid_reports(reports(spark, sf_dir)), asked)
    return found.select("minute", "n_now", F.round("pace_now", 6).alias("pace_now"))


@query(f"WITH {_REPORTS} SELECT a, b, count(*) AS n, median(seconds) AS seconds FROM valid GROUP BY a, b HAVING count(*) >= 2")
def unordered_pair_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = validate.valid_reports(reports(spark, sf_dir)).select(*estimates.pair_key(), "seconds")
    g = estimates.exact_medians(r, ["pair_a", "pair_b"], F.col("seconds")).where("n >= 2")
    return g.select(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"), "n", F.col("median").alias("seconds"))


_WANTED = f"""wanted AS (SELECT c_custkey AS walk_id, 'p' || CAST(c_custkey % 45 AS VARCHAR) AS "from", 'p' || CAST(c_nationkey AS VARCHAR) AS "to", 100.0 + c_custkey % 900 AS feet,
  c_custkey % 4 AS flights, {NOW} + c_custkey * 600000 AS now FROM customer),
asked AS (SELECT *, (now // 60000) % 1440 AS minute, least("from", "to") AS a, greatest("from", "to") AS b FROM wanted)"""


@query(f"""WITH {_REPORTS}, {_WANTED},
allp AS (SELECT count(*) AS n_all, median(pace) AS pace_all FROM valid),
nowp AS (SELECT m.minute, count(*) AS n_now, median(pace) AS pace_now FROM valid v JOIN (SELECT DISTINCT minute FROM asked) m ON least(abs(v.minute - m.minute), 1440 - abs(v.minute - m.minute)) <= 30 GROUP BY 1),
base AS (SELECT asked.*, n_all, pace_all, coalesce(n_now, 0) AS n_now, pace_now,
  CASE WHEN coalesce(n_now, 0) >= 3 AND n_all >= 3 AND pace_all / pace_now - 1 >= 0.15 THEN pace_all / pace_now - 1 END AS busier FROM asked LEFT JOIN nowp USING (minute), allp),
route AS (SELECT q.a, q.b, q.minute, count(*) AS n, median(seconds) AS s_all, count(*) FILTER (least(abs(v.minute - q.minute), 1440 - abs(v.minute - q.minute)) <= 30) AS n_near,
  median(seconds) FILTER (least(abs(v.minute - q.minute), 1440 - abs(v.minute - q.minute)) <= 30) AS s_near
  FROM (SELECT DISTINCT a, b, minute FROM asked) q JOIN valid v ON q.a = v.a AND q.b = v.b GROUP BY 1, 2, 3),
picked AS (SELECT base.*, n, CASE WHEN n >= 2 THEN 'route' WHEN n_all >= 3 THEN 'pace' ELSE 'default' END AS basis,
  CASE WHEN n >= 2 THEN CASE WHEN n_near >= 2 THEN s_near ELSE s_all * (1 + coalesce(busier, 0)) END
  WHEN n_all >= 3 THEN feet / CASE WHEN n_now >= 3 THEN pace_now ELSE pace_all END + flights * 25 ELSE feet / 4.0 + flights * 25 END AS s
  FROM base LEFT JOIN route USING (a, b, minute))
SELECT walk_id, CAST(greatest(1, floor(s / 60 + 0.5)) AS INTEGER) AS minutes, basis, CAST(CASE basis WHEN 'route' THEN n WHEN 'pace' THEN n_all ELSE 0 END AS BIGINT) AS count,
  round(CASE WHEN basis <> 'default' THEN busier END, 6) AS busier FROM picked""")
def travel_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    place = lambda x: F.concat(F.lit("p"), x.cast("string"))
    wanted = c.select(
        F.col("c_custkey").alias("walk_id"), place(F.pmod("c_custkey", F.lit(45))).alias("from"), place(F.col("c_nationkey")).alias("to"), (100.0 + F.pmod("c_custkey", F.lit(900))).alias("feet"),
        F.pmod("c_custkey", F.lit(4)).alias("flights"), (NOW + F.col("c_custkey") * 600_000).alias("now"),
    )
    return estimates.estimate(wanted, reports(spark, sf_dir)).withColumn("busier", F.round("busier", 6))


@query(f"""WITH {_REPORTS}, parts AS (SELECT *, 0 AS src FROM reports WHERE ord % 2 = 0 UNION ALL SELECT * REPLACE (ord + 100000 AS ord), 1 AS src FROM reports WHERE ord % 3 = 0)
SELECT "from", "to", "at", seconds, feet, flights, ord FROM (SELECT *, row_number() OVER (PARTITION BY "from", "to", "at", seconds ORDER BY src, ord) AS rn FROM parts) WHERE rn = 1""")
def merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    return estimates.merge_reports(r.where("ord % 2 = 0"), r.where("ord % 3 = 0").withColumn("ord", F.col("ord") + 100_000))


@query(f"WITH {_REPORTS} SELECT ord, \"from\", seconds FROM reports ORDER BY ord DESC LIMIT 2000")
def newest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates.newest(reports(spark, sf_dir), logs.MAX_SHARED).select("ord", "from", "seconds")


@query(f"""WITH {_REPORTS} SELECT "from", ord FROM (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY ord DESC) AS rn FROM reports) WHERE rn <= 3""")
def bounded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.bounded_log(reports(spark, sf_dir), 3, group="from").select("from", "ord")


@query("""SELECT day, seq, from_place, to_place FROM (SELECT user_id AS day, event_id AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_place, event_type AS to_place
  FROM events WHERE trim(event_type) <> '') WHERE from_place IS NOT NULL""")
def day_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = table(spark, sf_dir, "events").select(F.col("user_id").alias("day"), F.col("event_id").alias("seq"), F.col("event_type").alias("place"))
    return review.transitions(stops)


@query("""WITH legs AS (SELECT o_orderkey AS leg, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 7 END AS from_key, o_orderkey % 7 AS to_key FROM orders),
routes AS (SELECT a AS from_key, b AS to_key, (a * 3 + b * 2) % 12 AS minutes FROM range(7) t(a), range(7) u(b) WHERE (a + b) % 4 <> 0)
SELECT status, tight, count(*) AS n FROM (SELECT *, coalesce(status = 'ok' AND minutes > 7, false) AS tight FROM (SELECT l.*, r.minutes,
  CASE WHEN l.from_key IS NULL OR l.to_key IS NULL THEN 'unknown-room' WHEN l.from_key = l.to_key THEN 'same-room' WHEN r.minutes IS NULL THEN 'no-route' ELSE 'ok' END AS status
  FROM legs l LEFT JOIN routes r USING (from_key, to_key))) GROUP BY 1, 2""")
def day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    legs = o.select(F.when(F.pmod("o_custkey", F.lit(10)) != 0, F.pmod("o_custkey", F.lit(7))).alias("from_key"), F.pmod("o_orderkey", F.lit(7)).alias("to_key"))
    sevens = spark.range(7)
    routes = sevens.select(F.col("id").alias("from_key")).join(sevens.select(F.col("id").alias("to_key")), (F.col("from_key") + F.col("to_key")) % 4 != 0)
    routes = routes.withColumn("minutes", F.pmod(F.col("from_key") * 3 + F.col("to_key") * 2, F.lit(12)))
    return review.summarize(legs, routes).groupBy("status", F.coalesce("tight", F.lit(False)).alias("tight")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_REPORTS} SELECT ord, \"from\", CAST(seconds AS DOUBLE) AS seconds, \"at\" FROM valid WHERE ord % 5 <> 0")
def parsed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("ord") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("from", "to", "feet", "flights", "seconds", "at")))
    lines = reports(spark, sf_dir).select("ord", said.alias("value"))
    rows = logs.parse_reports(lines.select("value"))
    # ids are not part of a report: found again by the rest
    keys = reports(spark, sf_dir).select("ord", "from", "to", "at")
    return rows.join(keys, ["from", "to", "at"]).select("ord", "from", "seconds", "at")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT c_custkey AS schedule_id, i AS seq, CASE WHEN i = 0 THEN 'Arrive' WHEN i = 1 THEN 'Period 1' ELSE 'P' || CAST(i AS VARCHAR) END AS name,
  CASE WHEN i = 0 THEN 'Door' WHEN i = 2 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS place FROM customer, range(4) t(i)""")
def schedule_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    one = '{"periods":[{"room":"%s"},{"name":"P2"},{"name":"P3","room":"%s"}],"arriveFrom":{"label":"Door","key":"d"}}'
    said = c.select(F.col("c_custkey").alias("schedule_id"), F.format_string(one, F.col("c_custkey").cast("string"), F.col("c_custkey").cast("string")).alias("value"))
    return logs.schedule_stops(said).select("schedule_id", "seq", "name", "place")


@query("""SELECT event_id, CAST(floor(s / 60) AS BIGINT) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, hour(ts) * 60 + minute(ts) AS minute,
  CAST(CASE WHEN value >= 100 THEN floor(value / 10 + 0.5) * 10 ELSE floor(value / 5 + 0.5) * 5 END AS DOUBLE) AS spoken FROM (SELECT *, CAST(floor(value) AS BIGINT) AS s FROM events)""")
def spoken_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.clock("value").alias("clock"), numbers.minute_of_day("ts").alias("minute"), numbers.round_feet("value").cast("double").alias("spoken"))


@query("SELECT user_id AS walk_id, max(epoch_us(ts) // 1000) AS started_at FROM events GROUP BY 1 HAVING 1706745600000 - max(epoch_us(ts) // 1000) <= 259200000")
def open_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("walk_id")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("started_at"))
    return estimates.open_walk(w, 1_706_745_600_000, 4320)
