"""Files, stores and streams: what is written to the shared folder is read back by each source."""

from __future__ import annotations

import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import signed_area
from ..operators.lineage import cut, materialize, shared_folder
from ..sources import floors, images, outdoor, store
from ..sources import reports as logs
from ..streaming import reports as streams
from .registry import query, table
from .walks import _REPORTS, NOW, reports


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corridora-{name}-{uuid.uuid4().hex}"


_FLOORS = """SELECT 'f' || CAST(c_custkey // 50 AS VARCHAR) AS floor, CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, CAST(c_custkey * 37 % 3000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 2400 AS DOUBLE) AS y, CASE WHEN c_nationkey % 2 = 0 THEN 'room' ELSE 'landmark' END AS kind, c_name AS label FROM customer"""


def _floor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor files of 50 points each, written as JSON and read by their schema."""
    k = F.col("c_custkey")
    value = F.struct((k * 37 % 3000).cast("double").alias("x"), (k * 91 % 2400).cast("double").alias("y"), F.when(F.col("c_nationkey") % 2 == 0, "room").otherwise("landmark").alias("kind"), F.col("c_name").alias("label"))
    edge = F.struct(k.cast("string").alias("a"), (k + 1).cast("string").alias("b"))
    g = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("f"), F.floor(k / 50).cast("string")).alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k.cast("string").alias("key"), value.alias("value"))))).alias("points"), F.sort_array(F.collect_list(edge)).alias("edges"))
    path = _scratch(spark, "floors")
    logs.write_json(g, path)
    return floors.read_json(spark, path, floors.FLOOR, lines=True)


@query(f"SELECT floor, id, k AS ord, x, y, kind, label FROM ({_FLOORS})")
def floor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floors.points(_floor_files(spark, sf_dir)).select("floor", "id", "ord", "x", "y", "kind", "label")


@query("SELECT 'f' || CAST(c_custkey // 50 AS VARCHAR) AS floor, CAST(c_custkey AS VARCHAR) AS a, CAST(c_custkey + 1 AS VARCHAR) AS b, false AS auto FROM customer")
def floor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floors.edges(_floor_files(spark, sf_dir))


@query(f"SELECT floor, id AS point_id, label, x, y FROM ({_FLOORS}) WHERE kind = 'room'")
def traced_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floors.traced_rooms(floors.points(_floor_files(spark, sf_dir)))


_ROOMS = "SELECT 'f' || CAST(s_suppkey // 40 AS VARCHAR) AS floor, CAST(s_suppkey AS VARCHAR) AS id, s_suppkey % 97 AS x0, s_suppkey % 89 AS y0, 5 + s_suppkey % 11 AS w, 4 + s_suppkey % 7 AS h FROM supplier"


@query(f"SELECT floor, id, CAST(w * h AS INTEGER) AS area, CAST(w * h AS DOUBLE) AS traced FROM ({_ROOMS})")
def room_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms written as each floor's JSON file, and read again with their outlines."""
    k = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.floor(k / 40).cast("string")).alias("floor"), k.cast("string").alias("id"), (k % 97).alias("x"), (k % 89).alias("y"), (5 + k % 11).alias("w"), (4 + k % 7).alias("h"))
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    rooms = b.select("floor", "id", F.concat(F.lit("R"), "id").alias("label"), F.lit("room").alias("kind"), "x", "y", (F.col("w") * F.col("h")).alias("area"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring"))
    path = _scratch(spark, "rooms")
    floors.rooms_file(rooms).select("value").write.text(path)
    read = floors.rooms(floors.read_json(spark, path, floors.ROOMS, lines=True))
    return read.select("floor", "id", "area", F.abs(signed_area("ring")).alias("traced"))


@query(f"WITH {_REPORTS} SELECT ord // 20 AS log, \"from\", seconds, \"at\" FROM valid")
def report_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON arrays of twenty reports; one that cannot be read has none."""
    r = reports(spark, sf_dir).withColumn("log", F.floor(F.col("ord") / 20))
    said = r.groupBy("log").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "from", "to", "feet", "flights", "seconds", "at")))).alias("value"))
    texts = said.select("value").unionByName(spark.createDataFrame([("[{broken",), (None,)], "value string"))
    rows = logs.parse_report_array(texts)
    keys = r.select("log", "from", "to", "at", "seconds")
    return rows.select("from", "to", "at", "seconds").join(keys, ["from", "to", "at", "seconds"]).select("log", "from", "seconds", "at")


@query(f"WITH {_REPORTS} SELECT ord FROM reports ORDER BY ord DESC LIMIT 2000")
def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that two ingests append to, empty before, compacted to its newest rows."""
    path, to = _scratch(spark, "log"), _scratch(spark, "compact")
    r = reports(spark, sf_dir)
    for part in (r.where("ord % 2 = 0"), r.where("ord % 2 = 1")):
        logs.append(part, path)
    logs.compact(spark, path, to, order="ord")
    return logs.read_or_empty(spark, to, "ord long").select("ord").unionByName(logs.read_or_empty(spark, f"{to}-never", "ord long"))


@query("SELECT CAST(user_id % 5 AS VARCHAR) AS key, CASE WHEN user_id % 5 = 2 THEN -event_id ELSE event_id END AS event_id FROM events WHERE user_id % 5 <> 3")
def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key: one key overwritten, one deleted, the others as they were."""
    path = _scratch(spark, "store")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("key"), "event_id")
    store.put(rows, path)
    store.put(rows.where("key = '2'").withColumn("event_id", -F.col("event_id")), path)
    store.remove(spark, path, "3")
    return spark.read.schema("event_id long, key string").parquet(path)


@query("SELECT c_custkey, 'https://example.org/new?title=' || replace(url_encode(c_name), '%20', '+') || '&body=' || replace(url_encode('in ' || c_mktsegment), '%20', '+') AS url FROM customer")
def issue_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title"), F.concat(F.lit("in "), "c_mktsegment").alias("body"))
    return c.select("c_custkey", logs.issue_url("https://example.org/new").alias("url"))


@query("""WITH r AS (SELECT 'f' || CAST(o_custkey % 6 AS VARCHAR) AS floor, CASE o_orderkey % 4 WHEN 0 THEN 'corrected' WHEN 1 THEN 'found' WHEN 2 THEN 'unread' ELSE 'confirmed' END AS bucket FROM orders)
SELECT floor, count(*) FILTER (bucket = 'corrected') AS corrected, count(*) FILTER (bucket = 'found') AS found, count(*) FILTER (bucket = 'unread') AS unread, count(*) FILTER (bucket = 'confirmed') AS confirmed FROM r GROUP BY 1""")
def scan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files by floor, read again as counts of their lists."""
    k = F.col("o_orderkey")
    bucket = F.element_at(F.array(*map(F.lit, ("corrected", "found", "unread", "confirmed"))), (k % 4 + 1).cast("int"))
    r = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 6).cast("string")).alias("floor"), bucket.alias("bucket"), k.cast("string").alias("text"), (k % 100).cast("double").alias("x"), (k % 90).cast("double").alias("y"), F.lit(0.5).alias("conf"), F.lit(None).cast("array<string>").alias("was"))
    entry = "array<struct<text:string,x:double,y:double,conf:double,was:array<string>>>"
    read = floors.report_file(r).select("floor", F.from_json("value", f"corrected {entry}, found {entry}, unread {entry}, confirmed long").alias("v"))
    return read.select("floor", *[F.size(f"v.{c}").cast("long").alias(c) for c in ("corrected", "found", "unread")], "v.confirmed")


@query("SELECT 'f' || CAST(n_regionkey AS VARCHAR) AS floor, CASE WHEN n_nationkey % 2 = 0 THEN 'reject' ELSE 'place' END AS verdict, n_name AS text, CAST(n_nationkey AS DOUBLE) AS x FROM nation")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    row = F.struct(F.col("n_name").alias("text"), F.col("n_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit("seen").alias("why"))
    of = lambda cond: F.sort_array(F.collect_list(F.when(cond, row)))
    even = F.col("n_nationkey") % 2 == 0
    said = n.groupBy(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("floor")).agg(F.to_json(F.struct(of(even).alias("reject"), of(~even).alias("place"))).alias("value"))
    return floors.decisions(said).select("floor", "verdict", "text", "x")


@F.arrow_udf(T.BinaryType())
def _as_wkb(rings: pa.Array) -> pa.Array:
    """Rings as well-known binary polygons, every other one with its bytes the other way round."""
    out = []
    for i, ring in enumerate(rings.to_pylist()):
        order = "<" if i % 2 else ">"
        out.append(struct.pack(f"{order}BIII", i % 2, 3, 1, len(ring)) + b"".join(struct.pack(f"{order}2d", p["x"], p["y"]) for p in ring))
    return pa.array(out, pa.binary())


@query("""SELECT s_suppkey, i AS at, round(CAST((s_suppkey % 50 + i) * 0.001 * 364000 * cos(radians(30.25)) AS DOUBLE), 4) AS x, round(CAST(-(s_suppkey % 40 - i) * 0.001 * 364000 AS DOUBLE), 4) AS y FROM supplier, range(4) t(i)""")
def wkb_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    ring = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(((k % 50 + i) * 0.001 - 97.5).alias("x"), ((k % 40 - i) * 0.001 + 30.25).alias("y")))
    read = table(spark, sf_dir, "supplier").select("s_suppkey", outdoor.read_wkb(_as_wkb(ring)).alias("g")).where("g.kind = 'polygon'")
    flat = read.select("s_suppkey", F.posexplode(outdoor.to_feet("g.parts", -97.5, 30.25)[0]).alias("at", "p"))
    return flat.select("s_suppkey", F.col("at").cast("long").alias("at"), F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 100 <= 60 AND c_custkey % 100 + 5 >= 20 AND c_custkey % 70 <= 45 AND c_custkey % 70 + 5 >= 30")
def overlapping_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = lambda c: c.cast("double")
    box = F.struct(at(k % 100).alias("xmin"), at(k % 100 + 5).alias("xmax"), at(k % 70).alias("ymin"), at(k % 70 + 5).alias("ymax"))
    path = _scratch(spark, "features")
    table(spark, sf_dir, "customer").select("c_custkey", box.alias("bbox")).write.parquet(path)
    return outdoor.read_overlapping(spark, path, (20.0, 30.0, 60.0, 45.0)).select("c_custkey")


@F.arrow_udf(T.BinaryType())
def _as_png(rows: pa.Array) -> pa.Array:
    """16 x 16 images whose lines take all of the format's filters in turn."""
    out = []
    for (base,) in ((x,) for x in rows.to_pylist()):
        lines, above = [], bytes(16)
        for r in range(16):
            line = bytes((base * 7 + r * 13 + c * 29) % 256 for c in range(16))
            left, corner = bytes(1) + line[:-1], bytes(1) + above[:-1]
            near = [min((a, b, c), key=lambda v, w=a + b - c: abs(w - v)) for a, b, c in zip(left, above, corner)]
            guess = [bytes(16), left, above, bytes((a + b) // 2 for a, b in zip(left, above)), bytes(near)][r % 5]
            lines.append(bytes([r % 5]) + bytes((v - g) % 256 for v, g in zip(line, guess)))
            above = line
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b""))
    return pa.array(out, pa.binary())


@query("SELECT 'p' || CAST(s_suppkey AS VARCHAR) AS layer, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM supplier, range(16) t(r), range(16) u(c) WHERE (s_suppkey * 7 + r * 13 + c * 29) % 256 < 170")
def page_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("name"), _as_png("s_suppkey").alias("content"))
    return images.ink(images.pixel_rows(pages))


@query("SELECT p_partkey, CASE WHEN p_type[1] = 'S' THEN 'kept' ELSE upper(p_type) END AS result FROM part")
def cached_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that is done once a digest: results that the cache has are not asked for again."""
    work = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.sha1(F.col("p_type").cast("binary")).alias("sha1"))
    cache = materialize(work.where("p_type like 'S%'").select("sha1", F.lit("kept").alias("result")).distinct(), "cache")
    found, _ = images.once_per_digest(work, cache, lambda lacking: lacking.withColumn("result", F.upper("p_type")))
    return found.select("p_partkey", "result")


_STREAMED = f"""WITH {_REPORTS} SELECT "from", "to", CAST(floor(feet + 0.5) AS BIGINT) AS feet, CAST(flights AS BIGINT) AS flights, CAST(floor(seconds + 0.5) AS BIGINT) AS seconds, CASE WHEN abs({NOW} - "at") < 86400000 THEN "at" ELSE {NOW} END AS "at" FROM valid WHERE feet <= 5000 AND flights <= 4"""


def _report_folder(spark: SparkSession, rows: DataFrame) -> str:
    path = _scratch(spark, "incoming")
    rows.select(F.to_json(F.struct("from", "to", "feet", "flights", "seconds", "at")).alias("value")).write.text(path)
    return path


@query(_STREAMED)
def streamed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that arrive as files: cleaned, late clocks set to the present, appended once to a log."""
    stream = streams.cleaned(streams.read_stream(spark, _report_folder(spark, reports(spark, sf_dir))), NOW)
    path = _scratch(spark, "ingested")
    streams.append_log(stream.select("from", "to", "feet", "flights", "seconds", "at"), path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema("`from` string, `to` string, feet long, flights long, seconds long, at long").parquet(path)


@query(f"WITH {_REPORTS}, c AS (SELECT CASE WHEN abs({NOW} - \"at\") < 86400000 THEN \"at\" ELSE {NOW} END AS t FROM valid WHERE feet <= 5000 AND flights <= 4) SELECT count(*) AS n, min(t) AS first, max(t) AS last FROM (SELECT t FROM c ORDER BY t DESC LIMIT 50)")
def streamed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of the 50 newest reports, kept by a stream that reads one file a batch."""
    incoming = _report_folder(spark, reports(spark, sf_dir).repartition(3, "ord"))
    stream = streams.cleaned(spark.readStream.schema(logs.REPORT).option("maxFilesPerTrigger", 1).json(incoming), NOW)
    path = _scratch(spark, "bounded")
    streams.ingest(stream, path, f"{path}-checkpoint", most=50).awaitTermination()
    return streams.read_log(spark, path).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


@query(f"WITH {_REPORTS} SELECT DISTINCT \"from\", \"to\", \"at\", CAST(floor(seconds + 0.5) AS BIGINT) AS seconds FROM valid WHERE feet <= 5000 AND flights <= 4 AND abs({NOW} - \"at\") < 86400000")
def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one day that arrive twice, kept once."""
    r = reports(spark, sf_dir).where(F.abs(F.col("at") - NOW) < 86_400_000)
    stream = streams.cleaned(streams.read_stream(spark, _report_folder(spark, r.unionByName(r))), NOW)
    path = _scratch(spark, "once")
    streams.append_log(streams.deduplicated(stream, "3 days").select("from", "to", "at", "seconds"), path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema("`from` string, `to` string, at long, seconds long").parquet(path)


@query("""WITH e AS (SELECT user_id AS walk_id, (event_id + 1) * 1000 AS t, event_id % 3 < 2 AS opens FROM events), l AS (SELECT *, lag(t) OVER w AS t0, lag(opens) OVER w AS was, lead(t) OVER w AS t1 FROM e WINDOW w AS (PARTITION BY walk_id ORDER BY t))
SELECT CAST(walk_id AS VARCHAR) AS walk_id, t0 AS started_at, t AS ended_at, 'arrived' AS outcome FROM l WHERE NOT opens AND was UNION ALL SELECT CAST(walk_id AS VARCHAR), t, NULL, 'expired' FROM l WHERE opens AND t1 IS NULL""")
def streamed_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks from a stream of starts and arrivals; a later event moves the clock on, by which walks without an arrival expire."""
    path, out = _scratch(spark, "walks"), _scratch(spark, "closed")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("walk_id"), F.when(F.col("event_id") % 3 < 2, "start").otherwise("arrive").alias("kind"), ((F.col("event_id") + 1) * 1000).alias("at"))
    e.write.json(path)
    late = e.agg(F.lit("clock").alias("walk_id"), F.lit("arrive").alias("kind"), (F.max("at") + 10 * 3_600_000).alias("at"))
    for more in (None, late):  # the same stream goes on where it stopped
        if more is not None:
            more.write.mode("append").json(path)
        stream = spark.readStream.schema("walk_id string, kind string, at long").json(path)
        streams.append_log(streams.closed_walks(stream), out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(streams.CLOSED).parquet(out)


@query("SELECT o_orderkey AS id, 'added' AS kind, '2024-01-01' AS submitted_at FROM orders WHERE o_orderkey % 9 = 0")
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with the moment they are handed in, written as JSON lines and read back."""
    changes = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("id"), F.lit("added").alias("kind"))
    folder = _scratch(spark, "saved")
    path = store.save_named(logs.proposal(changes, "2024-01-01"), folder, "main")
    return cut(spark.read.schema("id long, kind string, submitted_at string").json(path))


@query("""WITH t(moment, upto) AS (VALUES (0, 2), (59, 2), (60, 3), (119, 3), (200, 4)) SELECT moment, o_orderpriority AS priority, count(*) AS n FROM t JOIN orders ON o_orderkey % 5 < upto GROUP BY 1, 2""")
def kept_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows with every read: what is read is as it was up to a minute ago."""
    log, path, orders, out = _scratch(spark, "log"), _scratch(spark, "kept"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority")), None
    for moment, part in ((0, "o_orderkey % 5 < 2"), (59, "o_orderkey % 5 = 2"), (60, None), (119, "o_orderkey % 5 = 3"), (200, None)):
        if part is not None:
            orders.where(part).write.mode("append").parquet(log)
        counted = spark.read.parquet(log).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
        read = cut(streams.kept_read(counted, path, now=moment)).select(F.lit(moment).alias("moment"), "priority", "n")
        out = read if out is None else out.union(read)
    return out


@query("""SELECT 'f' || CAST(p_partkey % 7 AS VARCHAR) AS layer, CAST(p_partkey * 13 % 900 AS INTEGER) AS x, CAST(p_partkey * 29 % 700 AS INTEGER) AS y, CAST(1 + p_size AS INTEGER) AS w, CAST(1 + p_partkey % 11 AS INTEGER) AS h FROM part""")
def wall_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of wall files, written as JSON and read by their schema."""
    k = F.col("p_partkey")
    box = F.struct(k, (k * 13 % 900).cast("int").alias("x"), (k * 29 % 700).cast("int").alias("y"), (1 + F.col("p_size")).cast("int").alias("w"), (1 + k % 11).cast("int").alias("h"))
    g = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("f"), (k % 7).cast("string")).alias("floor")).agg(F.sort_array(F.collect_list(box)).alias("b"))
    flat = g.select("floor", F.lit(900).alias("w"), F.lit(700).alias("h"), F.lit(2).alias("quant"), F.flatten(F.transform("b", lambda x: F.array(x["x"], x["y"], x["w"], x["h"]))).alias("boxes"))
    path = _scratch(spark, "walls")
    logs.write_json(flat, path)
    return floors.wall_boxes(spark.read.schema(floors.WALLS).json(path))
