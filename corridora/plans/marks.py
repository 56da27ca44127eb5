"""Masks, glyphs, outlines and views: queries over cells and boxes made from parts, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geometry import pairs, signed_area
from ..operators import alignment, raster, reading, search, sequence, shapes, spatial, validate
from ..sources import outdoor
from .places import points
from .registry import query, table
from .space import _C, _GRID, _MASK, _REACH, _S, _customers, _grid, _mask, _suppliers

_SIDES = "a AS (SELECT * FROM m WHERE c < 25), b AS (SELECT * FROM m WHERE (r + c) % 3 <> 0)"


def _two_masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = _mask(spark, sf_dir)
    return m.where("c < 25"), m.where("(r + c) % 3 != 0")


@query(f"""WITH {_MASK}, {_SIDES}, pg AS (SELECT layer, r, c FROM (SELECT layer, max(r) AS h FROM m GROUP BY 1), range(0, 25) t(r), range(0, 40) u(c) WHERE r <= h)
SELECT 'both' AS op, layer, r, c FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', layer, r, c FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'without', layer, r, c FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'inverse', layer, r, c FROM (SELECT * FROM pg EXCEPT SELECT * FROM a)""")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_masks(spark, sf_dir)
    page = _mask(spark, sf_dir).groupBy("layer").agg(F.max("r").alias("r1")).select("layer", F.lit(0).alias("r0"), F.lit(0).alias("c0"), "r1", F.lit(39).alias("c1"))
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "layer", "r", "c")
    return tag("both", raster.both(a, b)).union(tag("either", raster.either(a, b))).union(tag("without", raster.without(a, b))).union(tag("inverse", raster.inverse(a, page)))


@query(f"""WITH {_MASK}, o(i, j) AS (SELECT a, b FROM range(-2, 3) t(a), range(-2, 3) u(b)), gr AS (SELECT DISTINCT layer, r + i AS r, c + j AS c FROM m, o)
SELECT 'grown' AS op, layer, r, c FROM gr UNION ALL SELECT 'sealed', gr.layer, gr.r, gr.c FROM gr CROSS JOIN o JOIN gr n ON n.layer = gr.layer AND n.r = gr.r + i AND n.c = gr.c + j GROUP BY ALL HAVING count(*) = 25""")
def grown_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mask(spark, sf_dir)
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "layer", "r", "c")
    return tag("grown", raster.grow(m, 2)).union(tag("sealed", raster.seal(m, 2)))


@query(f"""WITH {_MASK}, o(i, j) AS (SELECT a, b FROM range(-3, 4) t(a), range(-3, 4) u(b)) SELECT layer, r + i AS r, c + j AS c, round(count(*) / 49.0, 6) AS share FROM m, o GROUP BY 1, 2, 3""")
def window_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.density(_mask(spark, sf_dir), 3).withColumn("share", F.round("share", 6))


@query(f"""WITH {_MASK}, l(angle, i, j) AS (VALUES (0, 0, -1), (0, 0, 0), (0, 0, 1), (1, -1, -1), (1, 0, 0), (1, 1, 1), (2, -1, 0), (2, 0, 0), (2, 1, 0), (3, -1, 1), (3, 0, 0), (3, 1, -1)),
mid AS (SELECT l.angle, m.layer, m.r - l.i AS r, m.c - l.j AS c FROM m, l GROUP BY ALL HAVING count(*) = 3) SELECT DISTINCT mid.angle, layer, r + i AS r, c + j AS c FROM mid JOIN l ON l.angle = mid.angle""")
def line_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.line_openings(_mask(spark, sf_dir), 3, 4)


@query(f"""WITH RECURSIVE {_MASK}, k AS (SELECT layer, r, c, layer * 1000000 + r * 1000 + c AS id FROM m), e AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.layer = y.layer AND greatest(abs(x.r - y.r), abs(x.c - y.c)) = 1),
t AS (SELECT id, id AS o FROM k UNION SELECT t.id, b FROM t JOIN e ON a = t.o), n AS (SELECT id, min(o) AS comp FROM t GROUP BY 1)
SELECT layer, n, count(*) AS components FROM (SELECT layer, comp, count(*) AS n FROM n JOIN k USING (id) GROUP BY 1, 2) GROUP BY 1, 2""")
def eight_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = raster.label(_mask(spark, sf_dir), eight=True).groupBy("layer", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("layer", "n").agg(F.count(F.lit(1)).alias("components"))


@query(f"""WITH RECURSIVE {_MASK}, {_REACH}, s AS (SELECT layer, comp, count(*) AS n FROM cc GROUP BY 1, 2), b AS (SELECT layer, arg_min(comp, (-n, comp)) AS comp FROM s GROUP BY 1) SELECT cc.layer, r, c FROM cc JOIN b ON b.layer = cc.layer AND b.comp = cc.comp""")
def largest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.largest(_mask(spark, sf_dir))


@query(f"""WITH RECURSIVE {_GRID}, w AS (SELECT floor, r, c, r * 100 + c AS id, east, south FROM g WHERE walk), h AS (SELECT floor, id AS a, id + 1 AS b FROM w WHERE east UNION ALL SELECT floor, id, id + 100 FROM w WHERE south),
e AS MATERIALIZED (SELECT floor, a, b FROM h UNION SELECT floor, b, a FROM h), t AS (SELECT floor, id, id AS o FROM w UNION SELECT t.floor, t.id, e.b FROM t JOIN e ON e.floor = t.floor AND e.a = t.o),
n AS (SELECT floor, id, min(o) AS comp FROM t GROUP BY 1, 2), s AS (SELECT floor, comp, count(*) AS n FROM n GROUP BY 1, 2), b AS (SELECT floor, arg_min(comp, (-n, comp)) AS comp FROM s GROUP BY 1)
SELECT g.floor AS layer, g.r, g.c, g.near_wall, b.comp IS NOT NULL AS net FROM g LEFT JOIN n ON n.floor = g.floor AND n.id = g.r * 100 + g.c LEFT JOIN b ON b.floor = n.floor AND b.comp = n.comp""")
def derived_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _grid(spark, sf_dir).withColumnRenamed("floor", "layer").select("layer", "r", "c", "walk", "east", "south")
    return raster.derived_planes(cells).select("layer", "r", "c", "near_wall", "net")


_TRIANGLES = """tri AS (SELECT s_suppkey // 20 AS layer, s_suppkey AS pid, s_suppkey % 20 * 13.0 AS x1, s_suppkey % 7 * 5.3 AS y1, s_suppkey % 20 * 13.0 + 17.4 AS x2, s_suppkey % 5 * 4.1 AS y2, s_suppkey % 20 * 13.0 + 6.2 AS x3, 31.7 AS y3 FROM supplier),
te AS (SELECT layer, pid, x1, y1, x2, y2 FROM tri UNION ALL SELECT layer, pid, x2, y2, x3, y3 FROM tri UNION ALL SELECT layer, pid, x3, y3, x1, y1 FROM tri),
tc AS (SELECT te.layer, te.pid, r, c FROM te, range(0, 32) t(r), range(0, 280) u(c) WHERE c BETWEEN te.pid % 20 * 13 - 1 AND te.pid % 20 * 13 + 19 AND (te.y1 > r + 0.5) <> (te.y2 > r + 0.5) AND c + 0.5 < (te.x2 - te.x1) * (r + 0.5 - te.y1) / (te.y2 - te.y1) + te.x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x = (k % 20) * 13.0
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(corner(x, (k % 7) * 5.3), corner(x + 17.4, (k % 5) * 4.1), corner(x + 6.2, F.lit(31.7)))
    return table(spark, sf_dir, "supplier").select(F.floor(k / 20).alias("layer"), k.alias("poly_id"), ring.alias("ring"))


@query(f"WITH {_TRIANGLES} SELECT layer, pid AS poly_id, r, c FROM tc")
def polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triangles(spark, sf_dir)
    return raster.polygon_cells(spatial.ring_edges(t).join(t.select("layer", "poly_id"), "poly_id"))


@query(f"""WITH {_TRIANGLES}, a AS (SELECT DISTINCT layer, r, c FROM tc WHERE pid % 2 = 0), b AS (SELECT DISTINCT layer, r, c FROM tc WHERE pid % 2 = 1)
SELECT op, layer, CAST(count(*) AS DOUBLE) AS area FROM (SELECT 'union' AS op, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'difference', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY 1, 2""")
def polygon_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the outlines of two sets of polygons together, holes taken off."""
    t = _triangles(spark, sf_dir)
    found = shapes.combine_polygons(t.where("poly_id % 2 = 0"), t.where("poly_id % 2 = 1"))
    return found.groupBy(F.col("how").alias("op"), "layer").agg(F.round(F.sum(signed_area("ring")), 6).alias("area"))


@query("""SELECT DISTINCT s_suppkey // 50 AS layer, r, c FROM supplier, range(0, 60) t(r), range(0, 60) u(c) WHERE r >= floor(s_suppkey % 9 * 7 * 0.7) AND r <= greatest(ceil((s_suppkey % 9 * 7 + s_suppkey % 4) * 0.7) - 1, floor(s_suppkey % 9 * 7 * 0.7))
  AND c >= floor(s_suppkey % 11 * 5 * 0.7) AND c <= greatest(ceil((s_suppkey % 11 * 5 + s_suppkey % 6) * 0.7) - 1, floor(s_suppkey % 11 * 5 * 0.7))""")
def box_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select(F.floor(k / 50).alias("layer"), ((k % 11) * 5).alias("x"), ((k % 9) * 7).alias("y"), (k % 6).alias("w"), (k % 4).alias("h"))
    return raster.box_cells(boxes, 0.7)


_GLYPHS = """gl AS (SELECT p_partkey // 40 AS pocket, p_partkey AS glyph, p_partkey % 40 * 11 AS x0, p_partkey % 3 * 4 AS y0, 5 + p_size % 6 AS w, 8 + p_size % 9 AS h FROM part),
gb AS (SELECT *, y0 + h AS y1, x0 + w AS x1, greatest(w, h) AS size, y0 + h / 2.0 AS cy, x0 + w / 2.0 AS cx FROM gl)"""


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    g = table(spark, sf_dir, "part").select(F.floor(k / 40).alias("pocket"), k.alias("glyph"), ((k % 40) * 11).alias("x0"), ((k % 3) * 4).alias("y0"), (5 + size % 6).alias("w"), (8 + size % 9).alias("h"))
    return g.withColumns({"layer": F.lit("page"), "y1": F.col("y0") + F.col("h"), "x1": F.col("x0") + F.col("w"), "size": F.greatest("w", "h"), "cy": F.col("y0") + F.col("h") / 2.0, "cx": F.col("x0") + F.col("w") / 2.0})


_WORDS = f"""{_GLYPHS}, pr AS (SELECT a.glyph AS a, b.glyph AS b FROM gb a JOIN gb b ON a.pocket = b.pocket AND a.glyph < b.glyph AND sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2) <= 70 AND greatest(a.size, b.size) <= 1.5 * least(a.size, b.size)
  AND sqrt(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) ** 2 + greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) ** 2) <= 0.7 * least(a.size, b.size)),
pe AS MATERIALIZED (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), t AS (SELECT glyph AS id, glyph AS o FROM gl UNION SELECT t.id, b FROM t JOIN pe ON a = t.o), nm AS (SELECT id AS glyph, min(o) AS word FROM t GROUP BY 1),
kept AS MATERIALIZED (SELECT * FROM nm WHERE word IN (SELECT word FROM nm GROUP BY 1 HAVING count(*) <= 6))"""


@query(f"WITH RECURSIVE {_WORDS} SELECT glyph, word FROM kept")
def glyph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.words(_glyphs(spark, sf_dir))


@query(f"WITH RECURSIVE {_WORDS} SELECT word, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1, count(*) AS glyphs FROM kept JOIN gb USING (glyph) GROUP BY 1")
def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _glyphs(spark, sf_dir)
    return reading.word_boxes(g, reading.words(g))


@query(f"""WITH RECURSIVE {_WORDS}, s AS (SELECT word, count(*) AS n, covar_pop(cx, cx) AS xx, covar_pop(cy, cy) AS yy, covar_pop(cx, cy) AS xy, max(y1) - min(y0) AS h, max(x1) - min(x0) AS w FROM kept JOIN gb USING (glyph) GROUP BY 1),
a AS (SELECT word, CASE WHEN n > 1 THEN degrees(atan2(2 * xy, xx - yy) / 2) WHEN h > w * 1.3 THEN 90 ELSE 0 END AS angle FROM s) SELECT word, round(CASE WHEN abs(angle) < 10 THEN 0 WHEN 90 - abs(angle) < 10 THEN 90 ELSE angle END, 4) AS angle FROM a""")
def word_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _glyphs(spark, sf_dir)
    return reading.word_angles(g, reading.words(g)).select("word", F.round("angle", 4).alias("angle"))


@query(f"WITH {_GLYPHS}, md AS (SELECT pocket, median(h) AS mid FROM gb GROUP BY 1) SELECT glyph FROM gb JOIN md USING (pocket) WHERE abs(h - mid) <= 0.35 * mid")
def glyphs_of_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.of_one_height(_glyphs(spark, sf_dir), ["pocket"]).select("glyph")


@query(f"""WITH {_C}_pts, w AS (SELECT p_id AS read_id, x, y, p_id % 1000 AS pocket, p_id % 3 = 0 AS leaky FROM c), s AS ({_S}), n AS (SELECT read_id, q_id AS point_id, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS dist, leaky FROM w, s WHERE sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) <= 60),
o AS (SELECT read_id, q_id AS point_id FROM w JOIN s ON q_id % 1000 = pocket WHERE NOT leaky)
SELECT coalesce(n.read_id, o.read_id) AS read_id, coalesce(n.point_id, o.point_id) AS point_id, round(n.dist, 6) AS dist, o.read_id IS NOT NULL OR coalesce(n.leaky AND n.dist <= 30, false) AS claimed FROM n FULL JOIN o ON n.read_id = o.read_id AND n.point_id = o.point_id""".replace(f"{_C}_pts", f"c AS ({_C})"))
def claimed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _customers(spark, sf_dir), _suppliers(spark, sf_dir)
    words = c.select(F.col("p_id").alias("read_id"), "x", "y", (F.col("p_id") % 1000).alias("pocket"), (F.col("p_id") % 3 == 0).alias("leaky"))
    known = s.select(F.col("q_id").alias("point_id"), F.col("qx").alias("px"), F.col("qy").alias("py"))
    owners = s.select((F.col("q_id") % 1000).alias("pocket"), F.col("q_id").alias("point_id"))
    return spatial.claims(words, known, owners).select("read_id", "point_id", F.round("dist", 6).alias("dist"), F.coalesce("claimed", F.lit(False)).alias("claimed"))


@query("""WITH p AS (SELECT l_suppkey AS k, CAST(l_partkey % 97 AS DOUBLE) AS ax, CAST(l_orderkey % 89 AS DOUBLE) AS ay, l_quantity AS bx, l_extendedprice / 1000 AS by_ FROM lineitem), m AS (SELECT k, count(*) AS n, avg(ax) AS ma, avg(ay) AS na, avg(bx) AS mb, avg(by_) AS nb FROM p GROUP BY 1),
s AS (SELECT p.k, any_value(n) AS n, any_value(ma) AS ma, any_value(na) AS na, any_value(mb) AS mb, any_value(nb) AS nb, sum((ax - ma) * (bx - mb) + (ay - na) * (by_ - nb)) / sum((ax - ma) ** 2 + (ay - na) ** 2) AS scale FROM p JOIN m ON p.k = m.k GROUP BY 1)
SELECT k, n, round(scale, 6) AS scale, round(mb - scale * ma, 5) AS tx, round(nb - scale * na, 5) AS ty FROM s WHERE n >= 2""")
def pinned_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    p = l.select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 97).cast("double").alias("ax"), (F.col("l_orderkey") % 89).cast("double").alias("ay"), F.col("l_quantity").alias("bx"), (F.col("l_extendedprice") / 1000).alias("by"))
    found = spatial.fit_pinned(p, ["k"]).where("n >= 2")
    return found.select("k", "n", F.round("scale", 6).alias("scale"), F.round("tx", 5).alias("tx"), F.round("ty", 5).alias("ty"))


@query("""WITH b AS (SELECT c_nationkey AS k, min(c_custkey * 37 % 3000) - 5.0 AS x0, min(c_custkey * 91 % 2400) - 5.0 AS y0, max(c_custkey * 37 % 3000) + 5.0 AS x1, max(c_custkey * 91 % 2400) + 5.0 AS y1 FROM customer GROUP BY 1)
SELECT k, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1, CAST((x0 + x1) / 2 AS DOUBLE) AS cx, CAST((y0 + y1) / 2 AS DOUBLE) AS cy, round(CAST(least(1280 / (greatest(x1 - x0, 1) * 1.2), 800 / (greatest(y1 - y0, 1) * 1.2), 4.0) AS DOUBLE), 6) AS scale FROM b""")
def view_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), (k * 37 % 3000).alias("x"), (k * 91 % 2400).alias("y"))
    return shapes.frame(shapes.boxes(p, ["k"], margin=5.0), 1280.0, 800.0).select("k", "x0", "y1", "cx", "cy", F.round("scale", 6).alias("scale"))


_POINTS_SQL = """pts AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'lower' WHEN 1 THEN 'main' ELSE 'upper' END AS floor, CAST(c_custkey AS VARCHAR) AS id, CASE c_nationkey % 5 WHEN 0 THEN 'entrance' WHEN 1 THEN 'landmark' WHEN 2 THEN 'junction' WHEN 3 THEN 'poi' ELSE 'room' END AS kind,
  CASE WHEN c_nationkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 0 THEN c_name END AS label, CASE WHEN c_custkey % 2 = 0 THEN 'restroom' ELSE 'stairs' END AS poi_type FROM customer)"""


@query(f"""WITH {_POINTS_SQL}, k AS (SELECT *, CASE kind WHEN 'room' THEN CASE WHEN coalesce(regexp_matches(label, '[A-Za-z][A-Za-z][A-Za-z]'), false) THEN 'landmark' ELSE 'room' END WHEN 'poi' THEN poi_type WHEN 'junction' THEN NULL ELSE kind END AS label_kind FROM pts)
SELECT floor || ':' || id AS key, CASE WHEN label_kind IN ('restroom', 'stairs') THEN coalesce(nullif(label, ''), upper(label_kind[1]) || label_kind[2:]) ELSE coalesce(label, id) END AS text, label_kind, CAST(list_position(['landmark', 'entrance', 'restroom', 'stairs', 'room'], label_kind) AS INTEGER) AS rank FROM k WHERE label_kind IS NOT NULL""")
def label_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.label_items(points(spark, sf_dir)).select("key", "text", "label_kind", "rank")


@query("""SELECT 'm' || CAST(s_suppkey AS VARCHAR) AS link_id, 'marked' AS origin FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'g' || CAST(n_nationkey AS VARCHAR), 'guessed' FROM nation""")
def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("link_id"), F.lit(True).alias("verified"))
    guessed = table(spark, sf_dir, "nation").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("link_id"))
    return search.all_links(marked, guessed).select("link_id", "origin")


@query("""SELECT p_partkey, regexp_matches(t, '^[1-4][0-9][0-9][A-Z]?$') AND CASE f WHEN 'lower' THEN t[1] = '1' WHEN 'main' THEN t[1] = '2' ELSE t[1] IN ('3', '4') END AS valid
FROM (SELECT p_partkey, CAST(p_partkey * 7 % 600 AS VARCHAR) || CASE WHEN p_size % 3 = 0 THEN 'B' ELSE '' END AS t, CASE p_partkey % 3 WHEN 0 THEN 'lower' WHEN 1 THEN 'main' ELSE 'upper' END AS f FROM part)""")
def rooms_on_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    said = F.concat((k * 7 % 600).cast("string"), F.when(F.col("p_size") % 3 == 0, "B").otherwise(""))
    floor = F.when(k % 3 == 0, "lower").when(k % 3 == 1, "main").otherwise("upper")
    return table(spark, sf_dir, "part").select("p_partkey", text.room_on_floor(said, floor, {"lower": "1", "main": "2", "upper": "34"}).alias("valid"))


_BOXES = "bx AS (SELECT s_suppkey AS k, s_suppkey * 53 % 300 * 1.0 AS x0, s_suppkey * 29 % 240 * 1.0 AS y0, 10.0 + s_suppkey % 40 AS w, 8.0 + s_suppkey % 30 AS h FROM supplier)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(k.alias("k"), (k * 53 % 300 * 1.0).alias("x0"), (k * 29 % 240 * 1.0).alias("y0"), (10.0 + k % 40).alias("w"), (8.0 + k % 30).alias("h"))
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return b.withColumn("ring", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


@query(f"WITH {_BOXES} SELECT k, CAST(round(greatest(0, least(x0 + w, 200) - greatest(x0, 50)) * greatest(0, least(y0 + h, 180) - greatest(y0, 40)), 6) AS DOUBLE) AS area FROM bx")
def clipped_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("k", F.round(signed_area(shapes.clip_ring("ring", (50.0, 40.0, 200.0, 180.0))), 6).alias("area"))


@query(f"""WITH {_BOXES}, s AS (SELECT k, x0 AS x1, y0 AS y1, x0 + w * 5 AS x2, y0 + h * 4 - 90 AS y2 FROM bx), d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM s),
t AS (SELECT *, greatest(0, coalesce(least((50 - x1) / nullif(dx, 0), (200 - x1) / nullif(dx, 0)), 0), coalesce(least((40 - y1) / nullif(dy, 0), (180 - y1) / nullif(dy, 0)), 0)) AS a,
  least(1, coalesce(greatest((50 - x1) / nullif(dx, 0), (200 - x1) / nullif(dx, 0)), 1), coalesce(greatest((40 - y1) / nullif(dy, 0), (180 - y1) / nullif(dy, 0)), 1)) AS b FROM d WHERE (dx <> 0 OR x1 BETWEEN 50 AND 200) AND (dy <> 0 OR y1 BETWEEN 40 AND 180))
SELECT k, CAST(round(x1 + dx * a, 5) AS DOUBLE) AS x1, CAST(round(y1 + dy * a, 5) AS DOUBLE) AS y1, CAST(round(x1 + dx * b, 5) AS DOUBLE) AS x2, CAST(round(y1 + dy * b, 5) AS DOUBLE) AS y2 FROM t WHERE a <= b""")
def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    s = b.select("k", F.col("x0").cast("double").alias("x1"), F.col("y0").cast("double").alias("y1"), (F.col("x0") + F.col("w") * 5).cast("double").alias("x2"), (F.col("y0") + F.col("h") * 4 - 90).cast("double").alias("y2"))
    return shapes.clip_segments(s, (50.0, 40.0, 200.0, 180.0)).select("k", *[F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""WITH {_BOXES}, o AS (SELECT k AS poly_id, x0, y0, x0 + w AS x1, y0 + h AS y1, w * h AS area FROM bx WHERE k % 2 = 0), h AS (SELECT k AS hole_id, x0 + 1.5 AS hx, y0 + 0.5 AS hy FROM bx WHERE k % 2 = 1)
SELECT hole_id, poly_id FROM (SELECT hole_id, poly_id, row_number() OVER (PARTITION BY hole_id ORDER BY area, poly_id) AS rn FROM h JOIN o ON hx > x0 AND hx < x1 AND hy > y0 AND hy < y1) WHERE rn = 1""")
def hole_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    outers = b.where("k % 2 = 0").select(F.col("k").alias("poly_id"), "ring")
    corner = lambda dx: F.struct((F.col("x0") + dx).cast("double").alias("x"), (F.col("y0") + 0.5).cast("double").alias("y"))
    holes = b.where("k % 2 = 1").select(F.col("k").alias("hole_id"), F.array(corner(1.0), corner(2.0), corner(1.5)).alias("ring"))
    return shapes.hole_owners(outers, holes)


@query(f"""WITH {_BOXES}, s AS (SELECT i * 12 + j AS p_id, i * 18.0 + 4.3 AS x, j * 19.0 + 3.1 AS y, exp(-((i - 7.5) ** 2 + (j - 5.5) ** 2) / 40.0) AS weight FROM range(16) a(i), range(12) b(j)),
c AS (SELECT k % 3 AS idx, sum(weight) / (SELECT sum(weight) FROM s) AS share FROM bx JOIN s ON x > x0 AND x < x0 + w AND y > y0 AND y < y0 + h GROUP BY 1), f AS (SELECT i AS idx, coalesce(share, 0) AS share FROM range(3) t(i) LEFT JOIN c ON c.idx = i),
b AS (SELECT idx, share FROM f ORDER BY share DESC, abs(idx - 1), idx LIMIT 1) SELECT CAST(CASE WHEN share >= 0.2 AND share >= greatest(1.4 * (SELECT share FROM f WHERE idx = 1), (SELECT share FROM f WHERE idx = 1) + 0.12) THEN idx ELSE 1 END AS BIGINT) AS idx FROM b""")
def floor_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = spark.range(16).select(F.col("id").alias("i")), spark.range(12).select(F.col("id").alias("j"))
    s = i.join(F.broadcast(j)).select((F.col("i") * 12 + F.col("j")).alias("p_id"), (F.col("i") * 18.0 + 4.3).alias("x"), (F.col("j") * 19.0 + 3.1).alias("y"), F.exp(-(F.pow(F.col("i") - 7.5, 2.0) + F.pow(F.col("j") - 5.5, 2.0)) / 40.0).alias("weight"))
    outlines = _boxes(spark, sf_dir).select((F.col("k") % 3).alias("idx"), F.col("k").alias("poly_id"), "ring")
    return shapes.floor_in_view(s, outlines, 1).select(F.col("idx").cast("long").alias("idx"))


@query("""WITH p AS (SELECT 'f' || CAST(c_nationkey % 4 AS VARCHAR) AS floor, c_custkey AS id, CAST(c_custkey * 37 % 300 AS DOUBLE) AS x, CAST(c_custkey * 91 % 240 AS DOUBLE) AS y, c_name AS label FROM customer)
SELECT CASE WHEN id % 7 = 1 THEN 'f9' ELSE floor END AS floor, id, round(CASE WHEN id % 7 = 1 THEN 1.5 * (cos(0.2) * x - sin(0.2) * y) + 3 ELSE x END, 5) AS x, round(CASE WHEN id % 7 = 1 THEN 1.5 * (sin(0.2) * x + cos(0.2) * y) - 2 ELSE y END, 5) AS y,
  CASE WHEN id % 7 = 2 THEN 'landmark' ELSE 'room' END AS kind, CASE WHEN id % 7 = 2 THEN 'Hall ' || CAST(id AS VARCHAR) ELSE label END AS label FROM p WHERE id % 7 <> 0""")
def moved_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), (F.col("c_nationkey") % 4).cast("string")).alias("floor"), k.alias("id"), (k * 37 % 300).cast("double").alias("x"), (k * 91 % 240).cast("double").alias("y"), F.lit("room").alias("kind"), F.col("c_name").alias("label"))
    action = F.when(F.col("id") % 7 == 0, "drop").when(F.col("id") % 7 == 1, "move").otherwise("promote")
    moves = p.where("id % 7 <= 2").select("floor", "id", action.alias("action"), F.lit("f9").alias("to_floor"), F.lit(1.5).alias("scale"), F.lit(0.2).alias("angle"), F.lit(3.0).alias("tx"), F.lit(-2.0).alias("ty"), F.when(F.col("id") % 7 == 2, F.concat(F.lit("Hall "), F.col("id").cast("string"))).alias("label"))
    return shapes.moved_points(p, moves).select("floor", "id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "kind", "label")


@query("""WITH e AS (SELECT 'l' || CAST(s_suppkey // 3 AS VARCHAR) AS link_id, ['lower', 'main', 'upper'][CAST(s_suppkey % 3 AS INTEGER) + 1] AS floor, [-14.0, 0.0, 14.0][CAST(s_suppkey % 3 AS INTEGER) + 1] AS z, s_suppkey % 2 AS x FROM supplier)
SELECT link_id, string_agg(DISTINCT floor || ':' || CAST(x AS VARCHAR), '>' ORDER BY floor || ':' || CAST(x AS VARCHAR)) AS anchors FROM e GROUP BY 1""")
def column_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    floor = F.element_at(F.array(*map(F.lit, ("lower", "main", "upper"))), (k % 3 + 1).cast("int"))
    s = table(spark, sf_dir, "supplier")
    ends = s.select(F.concat(F.lit("l"), F.floor(k / 3).cast("string")).alias("link_id"), floor.alias("floor"), (k % 2).alias("x"), F.lit(0).alias("y"))
    heights = spark.createDataFrame([("lower", -14.0), ("main", 0.0), ("upper", 14.0)], "floor string, z double")
    # the floors' names happen to sort as their heights do
    named = F.transform("anchors", lambda a: F.concat_ws(":", a["floor"], a["x"].cast("string")))
    return alignment.column_anchors(ends, heights).select("link_id", F.array_join(named, ">").alias("anchors"))


@query("""SELECT n_name AS floor, concat_ws(', ', printf('%s: scale %.4f', n_name, 1.0 + n_regionkey * 0.01), CASE WHEN n_nationkey <> 0 THEN printf('turned %.2f degrees', n_nationkey * 1.5) END,
  CASE WHEN n_nationkey <> 0 THEN printf('moved by %.1f, %.1f', n_nationkey * 10.0, n_nationkey * -4.0) END, CASE WHEN n_nationkey % 2 = 0 THEN 'verified' END) AS said FROM nation""")
def described_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k, r = table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_regionkey")
    placed = n.select(F.col("n_name").alias("floor"), (1.0 + r * 0.01).alias("scale"), (k * 1.5).alias("rotation_deg"), (k * 10.0).alias("tx"), (k * -4.0).alias("ty"), (k % 2 == 0).alias("verified"))
    return alignment.for_file(placed).select("floor", alignment.describe().alias("said"))


@query("""SELECT p_partkey, round(-14 + 14 * CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 1 ELSE p * p * (3 - 2 * p) END + 13 * CASE WHEN p <= 1 THEN 0 WHEN p >= 2 THEN 1 ELSE (p - 1) * (p - 1) * (3 - 2 * (p - 1)) END, 6) AS z FROM (SELECT p_partkey, p_size / 20.0 - 0.2 AS p FROM part)""")
def elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(alignment.elevation(F.col("p_size") / 20.0 - 0.2, {0: -14.0, 1: 0.0, 2: 13.0}), 6).alias("z"))


@query("SELECT s_suppkey, i AS at, CAST(s_suppkey + 2 * i AS DOUBLE) AS x, CAST(s_suppkey + 2 * i + 1 AS DOUBLE) AS y FROM supplier, range(3) t(i)")
def flat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("s_suppkey") + i)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(pairs(flat)).alias("at", "p")).select("s_suppkey", F.col("at").cast("long").alias("at"), "p.x", "p.y")


@query("""WITH b AS (SELECT c_custkey AS k, c_custkey % 50 AS x0, c_custkey % 40 AS y0, c_custkey % 50 + 20 AS x1, c_custkey % 40 + 10 AS y1 FROM customer), q(x0, y0, x1, y1) AS (VALUES (12, 9, 32, 19), (40, 33, 60, 43))
SELECT k FROM b WHERE EXISTS (SELECT 1 FROM q WHERE abs(b.x0 - q.x0) <= 3 AND abs(b.y0 - q.y0) <= 3 AND abs(b.x1 - q.x1) <= 3 AND abs(b.y1 - q.y1) <= 3)""")
def known_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    b = table(spark, sf_dir, "customer").select(k.alias("k"), (k % 50).alias("x0"), (k % 40).alias("y0"), (k % 50 + 20).alias("x1"), (k % 40 + 10).alias("y1"))
    return validate.whole_bounds(b, spark.createDataFrame([(12, 9, 32, 19), (40, 33, 60, 43)], "x0 int, y0 int, x1 int, y1 int")).select("k")


@query("""WITH px AS (SELECT p_partkey // 324 AS layer, p_partkey % 324 // 18 AS r, p_partkey % 18 AS c, p_size > 6 AS walk, p_size > 20 AS pub FROM part), tl AS (SELECT layer, r // 3 AS tr, c // 3 AS tc, count(*) FILTER (walk) / 9.0 >= 0.55 AS walk, count(*) FILTER (pub) / 9.0 >= 0.45 AS pub FROM px GROUP BY 1, 2, 3),
e AS (SELECT t.*, n.walk AND NOT EXISTS (SELECT 1 FROM px WHERE px.layer = t.layer AND NOT px.walk AND px.r = t.tr * 3 + 1 AND px.c BETWEEN t.tc * 3 + 1 AND t.tc * 3 + 4) AS ok FROM tl t JOIN tl n ON n.layer = t.layer AND n.tr = t.tr AND n.tc = t.tc + 1),
s AS (SELECT t.*, n.walk AND NOT EXISTS (SELECT 1 FROM px WHERE px.layer = t.layer AND NOT px.walk AND px.c = t.tc * 3 + 1 AND px.r BETWEEN t.tr * 3 + 1 AND t.tr * 3 + 4) AS ok FROM tl t JOIN tl n ON n.layer = t.layer AND n.tr = t.tr + 1 AND n.tc = t.tc)
SELECT t.layer, CAST(t.tr AS INTEGER) AS r, CAST(t.tc AS INTEGER) AS c, t.walk, t.pub, t.walk AND coalesce(e.ok, false) AS east, t.walk AND coalesce(s.ok, false) AS south FROM tl t LEFT JOIN e ON e.layer = t.layer AND e.tr = t.tr AND e.tc = t.tc LEFT JOIN s ON s.layer = t.layer AND s.tr = t.tr AND s.tc = t.tc""")
def walk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    px = table(spark, sf_dir, "part").select(F.floor(k / 324).alias("layer"), F.floor(k % 324 / 18).alias("r"), (k % 18).alias("c"), (F.col("p_size") > 6).alias("walk"), (F.col("p_size") > 20).alias("pub"))
    return raster.walk_grid(px, 3)


@query("""WITH p AS (SELECT l_orderkey AS k, list(struct_pack(x := CAST(l_partkey % 300 AS DOUBLE), y := CAST(l_linenumber * 40 AS DOUBLE)) ORDER BY l_linenumber) AS p FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT k, p, unnest(range(1, len(p) + 1)) AS i FROM p), a AS (SELECT k, i, len(p) AS n, p[i] AS b, p[i - 1] AS a, p[i + 1] AS c FROM q),
d AS (SELECT *, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d1, sqrt((c.x - b.x) ** 2 + (c.y - b.y) ** 2) AS d2 FROM a), e AS (SELECT *, least(d1 / 3, d2 / 3, 18) AS cut FROM d)
SELECT k, CAST(i AS BIGINT) AS i, 0 AS part, round(CASE WHEN i = 1 OR i = n OR cut < 2 THEN b.x ELSE b.x + (a.x - b.x) * cut / d1 END, 5) AS x, round(CASE WHEN i = 1 OR i = n OR cut < 2 THEN b.y ELSE b.y + (a.y - b.y) * cut / d1 END, 5) AS y FROM e
UNION ALL SELECT k, i, 1, round(b.x + (c.x - b.x) * cut / d2, 5), round(b.y + (c.y - b.y) * cut / d2, 5) FROM e WHERE i > 1 AND i < n AND cut >= 2""")
def rounded_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners are numbered again by their order: a cut corner has two points."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    p = l.select("k", "l_linenumber", (F.col("l_partkey") % 300).cast("double").alias("x"), (F.col("l_linenumber") * 40).cast("double").alias("y"))
    rows = sequence.rounded_points(p, 18.0, group="k", seq="l_linenumber")
    return rows.select("k", F.col("i").cast("long").alias("i"), "part", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'grass' ELSE 'lot' END AS kind, CAST(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS rank, p_retailprice AS area FROM part WHERE p_size % 4 < 3""")
def drawn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("c0", "water", 1), ("c1", "grass", 2), ("c2", "lot", 3)], "class string, kind string, rank int")
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("c"), (F.col("p_size") % 4).cast("string")).alias("class"), F.col("p_retailprice").alias("area"))
    return outdoor.draw_order(outdoor.classify(f, kinds)).select("id", "kind", "rank", "area")
