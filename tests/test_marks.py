"""Operators whose rounds or folds SQL does not say, against plain readings of their definitions."""

import math
import statistics
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridora.operators import estimates, graph, lineage, raster, reading, registration, sequence, shapes, validate, voting
from corridora.sources import images, outdoor, store

CELLS = "layer string, r int, c int"


def mask(spark, cells, layer="m"):
    return spark.createDataFrame([(layer, r, c) for r, c in sorted(cells)], CELLS)


def got(df):
    return {(x.r, x.c) for x in df.collect()}


def block(r0, c0, r1, c1):
    return {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}


def planes(spark, walk):
    rows = [("m", r, c, True, (r, c + 1) in walk, (r + 1, c) in walk) for r, c in sorted(walk)]
    return spark.createDataFrame(rows, CELLS + ", walk boolean, east boolean, south boolean")


def reached(rows, start):
    """Cells that open steps join to a start."""
    steps = {}
    for x in rows:
        for flag, other in ((x.east, (x.r, x.c + 1)), (x.south, (x.r + 1, x.c))):
            if flag:
                steps.setdefault((x.r, x.c), []).append(other)
                steps.setdefault(other, []).append((x.r, x.c))
    seen, open_ = {start}, [start]
    while open_:
        for other in steps.get(open_.pop(), ()):
            if other not in seen:
                seen.add(other)
                open_.append(other)
    return seen


def test_connect_bridges_short_gaps_only(spark):
    main, pocket, corner, far, crumb, named = block(0, 0, 9, 9), block(0, 12, 3, 15), block(12, 12, 15, 15), block(0, 24, 3, 27), block(13, 0, 13, 1), block(16, 3, 16, 4)
    rows = raster.connect(planes(spark, main | pocket | corner | far | crumb | named), mask(spark, {(16, 3), (2, 2)}), reach=7.5).collect()
    seen = reached(rows, (0, 0))
    assert pocket <= seen and corner <= seen and named <= seen
    assert not far & seen and not crumb & seen  # too far, and too small without a point
    opened = {(x.r, x.c) for x in rows if x.walk} - (main | pocket | corner | far | crumb | named)
    assert {(0, 10), (0, 11)} <= opened and opened <= seen


def test_connect_ends_where_nothing_is_wanted(spark):
    walk = block(0, 0, 3, 3)
    assert {(x.r, x.c) for x in raster.connect(planes(spark, walk), mask(spark, {(1, 1)})).collect()} == walk


def test_carve_doors(spark):
    hall, room, inner, vault = block(0, 0, 5, 40), block(9, 0, 18, 9), block(9, 13, 18, 22), block(40, 0, 49, 9)
    free, doors = raster.carve_doors(mask(spark, hall | room | inner | vault), least=50, wall=6, radius=1)
    found = {(x.r, x.c): x.component for x in raster.label(free, eight=True).collect()}
    assert found[(0, 0)] == found[(9, 0)] == found[(9, 13)] != found[(40, 0)]
    assert got(doors) == {(9, 0), (9, 13)}


def test_footprint_keeps_true_courts_open(spark):
    ring = block(0, 0, 19, 19) - block(7, 7, 12, 12)
    outline = block(0, 0, 19, 19) - block(1, 1, 18, 18)
    make = lambda walls, court: got(raster.footprint(mask(spark, walls), mask(spark, ring), link=1, least=10, clear=1, court=court))
    assert make(outline, 9) == ring
    assert make(outline | {(9, 9)}, 30) == block(0, 0, 19, 19)  # a wall inside: a room, not a court


def test_ink_and_page_footprint(spark):
    outline = block(0, 0, 19, 19) - block(1, 1, 18, 18) - {(0, 7)}
    ink = mask(spark, outline | {(40, 40), (9, 60), (9, 61)})
    assert got(raster.clean_ink(ink, 3)) == outline | {(0, 7)}  # specks are gone, the gap is closed
    assert got(raster.page_footprint(mask(spark, outline | block(40, 40, 42, 42)), 2)) == block(0, 0, 19, 19)


def test_hatching_tells_parallel_from_crossing_lines(spark):
    ruled = {(r, c) for r in range(0, 30, 3) for c in range(30)}
    crossed = {(r, c + 60) for r in range(30) for c in range(30) if r % 3 == 0 or c % 3 == 0}
    ink = mask(spark, ruled | crossed)
    found = got(raster.hatching(ink, raster.line_openings(ink, 7, 4), reach=4, strong=0.15, dense=0.15, crossed=0.3, link=1, core=1, least=20, spread=0, angles=4))
    assert found and all(c < 40 for _, c in found) and {(12, 12), (15, 15)} <= found


def test_storey_needs_detail_near_a_point(spark):
    dots = {(r, c) for r in range(0, 20, 2) for c in range(0, 20, 2)}
    elsewhere = {(r, c + 100) for r, c in dots}
    none = mask(spark, set()).where("false") if False else spark.createDataFrame([], CELLS)
    found = got(raster.storey(mask(spark, dots | elsewhere), none, mask(spark, {(10, 10)}), reach=2, dense=0.2, near=2, link=1, spread=1))
    assert {(5, 5), (12, 12)} <= found and all(c < 60 for _, c in found)


def test_segments_cut_touching_glyphs(spark):
    word = block(0, 0, 13, 7) | block(6, 8, 6, 9) | block(0, 10, 13, 17)
    rows = [("w", 1, r, c) for r, c in word] + [("w", 2, 1, 30), ("w", 2, 1, 31)]
    out = reading.segments(spark.createDataFrame(rows, "crop string, blob int, r int, c int")).collect()
    assert {(x.blob, x.piece) for x in out} == {(1, 0), (1, 1)}  # the speck is gone
    assert {x.c for x in out if x.piece == 0} == set(range(8)) and {x.c for x in out if x.piece == 1} == set(range(8, 18))


def test_glyph_vectors_against_plain_overlaps(spark):
    shapes_ = {"a": block(3, 5, 12, 9) - {(4, 6)}, "b": block(0, 0, 40, 30) - block(5, 5, 20, 20), "c": {(0, 0)}}
    rows = [(k, r, c) for k, cells in shapes_.items() for r, c in cells]
    found = {x.k: x.vector for x in reading.glyph_vectors(spark.createDataFrame(rows, "k string, r int, c int"), ["k"]).collect()}
    for k, cells in shapes_.items():
        y0, x0 = min(r for r, _ in cells), min(c for _, c in cells)
        h, w = max(r for r, _ in cells) - y0 + 1, max(c for _, c in cells) - x0 + 1
        want = np.zeros((reading.ROWS, reading.COLUMNS))
        for r, c in cells:
            for i in range(reading.ROWS):
                for j in range(reading.COLUMNS):
                    high = min((r - y0 + 1) * reading.ROWS / h, i + 1) - max((r - y0) * reading.ROWS / h, i)
                    wide = min((c - x0 + 1) * reading.COLUMNS / w, j + 1) - max((c - x0) * reading.COLUMNS / w, j)
                    want[i, j] += max(0, high) * max(0, wide)
        whole = np.r_[want.reshape(-1), w / h * math.sqrt(reading.COLUMNS)]
        assert np.allclose(found[k], whole / np.linalg.norm(whole), atol=1e-9)


def test_upright_crops_turn_words(spark):
    rows = [("p", r, 4, "w") for r in range(12)] + [("p", 0, c, "flat") for c in range(12)]
    angles = spark.createDataFrame([("w", 90.0), ("flat", 0.0)], "word string, angle double")
    out = reading.upright_crops(spark.createDataFrame(rows, "layer string, r int, c int, word string"), angles).collect()
    sizes = Counter((x.word, x.turn) for x in out)
    assert sizes == {("w", 90.0): 12, ("w", -90.0): 12, ("flat", 0.0): 12}
    assert all(x.r == 0 and 0 <= x.c < 12 for x in out)


def test_pocket_marks_are_ink_in_holes(spark):
    pocket = block(0, 0, 9, 9) - block(3, 3, 4, 6)
    pockets = mask(spark, pocket).withColumn("component", F.lit("k"))
    ink = mask(spark, block(3, 3, 4, 6) | {(20, 20)})
    assert got(reading.pocket_marks(pockets, ink)) == block(3, 3, 4, 6)


def test_glyph_boxes_have_bounds(spark):
    cells = [("p", r, c, 1) for r, c in block(2, 3, 9, 7)] + [("p", r, c, 2) for r, c in block(0, 20, 1, 21)]
    out = reading.glyph_boxes(spark.createDataFrame(cells, "layer string, r int, c int, glyph int"), (4, 20), (2, 20), (10, 100)).collect()
    assert [(x.glyph, x.y0, x.y1, x.x0, x.x1, x.n, x.cy, x.cx) for x in out] == [(1, 2, 10, 3, 8, 40, 6.0, 5.5)]
    marks = spark.createDataFrame(cells, "layer string, r int, c int, glyph int")
    assert reading.glyph_boxes(marks, (1, 20), (1, 20), (1, 100), aspect=(0.9, 1.1)).first().glyph == 2
    assert reading.glyph_boxes(marks.where("not (glyph = 1 and r = 5)"), (1, 20), (1, 20), (1, 100), fill=(0.95, 1.0)).first().glyph == 2


def test_straighten_makes_bumpy_walls_straight(spark):
    ring = [(0, 0), (50, 1), (100, 0), (101, 40), (100, 80), (50, 79), (0, 80), (1, 40)]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in ring],), ([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}],), (None,)], "ring array<struct<x:double,y:double>>")
    out = [x[0] for x in df.select(shapes.straighten("ring")).collect()]
    square = out[0]
    assert len(square) == 4 and out[1] == [] and out[2] is None
    for a, b in zip(square, square[1:] + square[:1]):
        assert min(abs(a.x - b.x), abs(a.y - b.y)) < 1e-6  # every edge is along an axis
    assert {(round(p.x / 100), round(p.y / 80)) for p in square} == {(0, 0), (1, 0), (1, 1), (0, 1)}


def test_string_pull_against_a_plain_fold(spark):
    wall = {(4, y) for y in range(0, 6)}
    path = [(0, 0), (1, 1), (2, 3), (3, 6), (4, 7), (5, 6), (6, 4), (8, 2), (9, 0)]
    cell = lambda v: math.floor(v + 0.5)

    def sees(a, b):
        n = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)
        return all((cell(a[0] + (b[0] - a[0]) * i / n), cell(a[1] + (b[1] - a[1]) * i / n)) not in wall for i in range(n + 1))

    want, anchor, last = [path[0]], path[0], path[0]
    for q in path[1:]:
        if not sees(anchor, q):
            want.append(last)
            anchor = last
        last = q
    want.append(last)
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in path], [x * 65536 + y for x, y in wall])], "p array<struct<x:int,y:int>>, w array<bigint>")
    out = [(q.x, q.y) for q in df.select(sequence.string_pull("p", "w").alias("o")).first().o]
    assert out == want and len(out) < len(path)


def test_refine_finds_a_turn(spark):
    shape = block(-10, -3, 10, 3) | block(-10, -3, -6, 10)
    turned = {(round(math.sin(0.2) * c + math.cos(0.2) * r), round(math.cos(0.2) * c - math.sin(0.2) * r)) for r, c in shape}
    best = registration.refine(mask(spark, turned), mask(spark, shape), scale_step=0.1, angle_step=0.2, rounds=2, reach=2).first()
    assert abs(best.angle - 0.2) <= 0.1 and abs(best.scale - 1.0) <= 0.1


def test_estimates_do_not_depend_on_what_a_task_sorts(spark, monkeypatch):
    from corridora.operators import estimates
    from corridora.plans.walks import travel_estimates

    told = sorted(map(tuple, travel_estimates(spark, "/root/testdata/sf0.001").collect()), key=str)
    monkeypatch.setattr(estimates, "MOST_AT_ONCE", 20)
    assert sorted(map(tuple, travel_estimates(spark, "/root/testdata/sf0.001").collect()), key=str) == told and len(told) == 150


def test_exact_medians_with_a_hot_key(spark):
    values = [((7 * i) % 1009) / 8 for i in range(4001)] + [1e9] * 3
    rows = [("hot", v) for v in values] + [("few", 3.0), ("few", 1.0), ("one", 5.0), ("none", None), ("same", 2.0), ("same", 2.0)]
    out = {x.k: (x.n, x["median"]) for x in estimates.exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v")).collect()}
    assert out == {"hot": (4004, statistics.median(values)), "few": (2, 2.0), "one": (1, 5.0), "same": (2, 2.0)}
    assert estimates.exact_medians(spark.createDataFrame([], "k string, v double"), [], F.col("v")).count() == 0


def test_medians_of_heavy_keys_with_values_far_off(spark, monkeypatch):
    """A value far off costs a round: no task sorts more rows of a key than stated."""
    monkeypatch.setattr(estimates, "MOST_AT_ONCE", 60)
    monkeypatch.setattr(estimates, "VALUE_BINS", 16)
    rng = np.random.default_rng(1)
    values = {"far": [*rng.normal(size=900).tolist(), 1e12], "steep": np.exp(rng.normal(size=800) * 20).tolist(), "ties": [1.0] * 400 + [2.0] * 400, "few": [3.0, 1.0], "odd": [5.0] * 301}
    sorted_ = []
    real = estimates._sorted_out
    monkeypatch.setattr(estimates, "_sorted_out", lambda v, keys: (sorted_.extend(x["count"] for x in v.groupBy(*keys).count().collect()), real(v, keys))[1])
    rows = [(k, v) for k, vs in values.items() for v in vs]
    out = {x.k: (x.n, x["median"]) for x in estimates.exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v")).collect()}
    assert out == {k: (len(v), pytest.approx(statistics.median(v), rel=1e-12)) for k, v in values.items()}
    assert max(sorted_) <= 60


@pytest.mark.parametrize("most", [10, 100_000])
def test_pace_by_minute_around_midnight(spark, monkeypatch, most):
    monkeypatch.setattr(estimates, "MOST_AT_ONCE", most)
    monkeypatch.setattr(estimates, "VALUE_BINS", 32)
    rng = np.random.default_rng(2)
    at = [int(m) * 60_000 for m in rng.choice([0, 5, 20, 700, 729, 731, 1410, 1435, 1439], 400)]
    rows = [("a", "b", float(f), 0, 100.0, t) for f, t in zip(rng.integers(100, 900, 400), at)]
    reports = spark.createDataFrame(rows, "`from` string, `to` string, feet double, flights int, seconds double, at long")
    asked = [0, 5, 700, 1430, 300]
    got = {x.minute: (x.n_now, x.pace_now) for x in estimates.pace_by_minute(reports, spark.createDataFrame([(m,) for m in [*asked, 0]], "minute int")).collect()}
    paces = [x.p for x in reports.select(validate.pace().alias("p")).collect()]
    for m in asked:
        near = [p for p, t in zip(paces, at) if min((t // 60_000 - m) % 1440, (m - t // 60_000) % 1440) <= 30]
        assert got.get(m) == ((len(near), pytest.approx(statistics.median(near))) if near else None)


def test_queries_in_blocks_score_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(40)]
    t = spark.createDataFrame(rows, "t_id int, t array<double>, label int")
    whole = sorted(map(tuple, voting.class_scores(t.select(F.col("t_id").alias("q_id"), F.col("t").alias("q")), t).collect()))
    monkeypatch.setattr(voting, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, voting.class_scores(t.select(F.col("t_id").alias("q_id"), F.col("t").alias("q")), t).collect())) == whole


def test_stated_sides_are_checked(spark):
    assert lineage.stated(spark.range(5), "queries", 5).count() == 5
    with pytest.raises(ValueError, match="queries"):
        lineage.stated(spark.range(6), "queries", 5)


def test_landing_fields_are_built_once_a_version(spark, tmp_path):
    cells = spark.createDataFrame([("f", 0, c, True, True, False, c < 4, False) for c in range(5)], "floor string, r int, c int, walk boolean, pub boolean, near_wall boolean, east boolean, south boolean")
    ends = graph.landings(spark.createDataFrame([("s", "f", 0, 0)], "link_id string, floor string, r int, c int"))
    path = f"{tmp_path}/fields"
    first = {(x.c, x.dist) for x in graph.landing_fields(cells, ends, path, "1").collect()}
    assert first == {(c, float(c)) for c in range(5)}
    # another grid with the same version is not looked at, with a new one it is
    shorter = cells.where("c < 3")
    assert graph.landing_fields(shorter, ends, path, "1").count() == 5 and graph.landing_fields(shorter, ends, path, "2").count() == 3
    graph.drop_fields(spark, path, "1")
    assert graph.landing_fields(shorter, ends, path, "1").count() == 3


def test_box_filter_reaches_the_scan(spark, tmp_path):
    path = f"{tmp_path}/features"
    spark.range(9).select("id", F.struct(*[(F.col("id") * k).cast("double").alias(n) for k, n in enumerate(("xmin", "xmax", "ymin", "ymax"), 1)]).alias("bbox")).write.parquet(path)
    plan = outdoor.read_overlapping(spark, path, (1.0, 2.0, 3.0, 4.0)).select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert all(f"bbox.{c}" in pushed for c in ("xmin", "xmax", "ymin", "ymax"))


def test_wkb_collections(spark):
    point = struct.pack("<BI2d", 1, 1, 5.0, 6.0)
    line = struct.pack(">BII4d", 0, 2, 2, 1.0, 2.0, 3.0, 4.0)
    many = struct.pack("<BII", 1, 6, 2) + 2 * struct.pack("<BIII6d", 1, 3, 1, 3, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0)
    out = [x.g for x in spark.createDataFrame([(point,), (line,), (many,), (None,)], "b binary").select(outdoor.read_wkb("b").alias("g")).collect()]
    assert (out[0].kind, out[0].parts[0][0].x) == ("point", 5.0) and (out[1].kind, len(out[1].parts[0])) == ("line", 2)
    assert out[2].kind == "polygons" and len(out[2].parts) == 2 and out[3] is None


def test_pages_as_files(spark, tmp_path):
    raw = b"".join(b"\0" + bytes([10 * r + c for c in range(4)]) for r in range(3))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    pages = images.read_pages(spark, str(tmp_path))
    assert got(images.ink(images.pixel_rows(pages), 12)) == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)}
    with pytest.raises(ValueError, match="greyscale"):
        images.decode_grey(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)))


def test_only_listed_names_are_saved(spark, tmp_path):
    df = spark.range(2)
    assert spark.read.json(store.save_named(df, str(tmp_path), "main")).count() == 2
    with pytest.raises(ValueError, match="align"):
        store.save_named(df, str(tmp_path), "align")


def test_draw_order(spark):
    rows = [(1, "b", 2, 5.0), (2, "a", 1, 1.0), (3, "a", 1, 9.0), (4, "b", 2, 5.0)]
    f = spark.createDataFrame(rows, "id int, kind string, rank int, area double")
    assert [x.id for x in outdoor.draw_order(f).collect()] == [3, 2, 1, 4]
