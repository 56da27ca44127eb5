"""Known values, properties and second implementations of the operators."""

import heapq
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corridora.functions import geometry, numbers, text
from corridora.operators import estimates, graph, raster, review, routes, search, sequence, spatial, validate
from corridora.sources import floors, reports


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers(spark):
    assert value(spark, numbers.round_half_up(F.lit(-2.5))) == -2
    assert [value(spark, numbers.hash31(F.lit(s))) for s in ("main:245", "entrance:Entrance A", "lower:Cafeteria")] == [9264910, 1889805125, 1461135395]
    assert value(spark, numbers.circular_minutes(F.lit(23 * 60 + 50), F.lit(10))) == 20
    assert spark.createDataFrame([(1,), (2,), (10,), (20,)], "x int").agg(F.median("x")).first()[0] == 6.0
    assert value(spark, validate.pace(F.lit(400), F.lit(1), F.lit(125))) == 4.0
    assert [value(spark, numbers.round_feet(F.lit(x))) for x in (42.6, 104.9, 105.0)] == [45, 100, 110]


def test_text(spark):
    names = {"Cafeteria": "food", "Library": "learning", "Counseling": "learning", "Administration": "office", "Band Hall": "arts", "Long Court": "other", "Courtyard": "sports"}
    assert {n: value(spark, text.category(F.lit(n))) for n in names} == names
    assert value(spark, text.room_tokens(F.lit("near 2O4b, not 12345 or 77"))) == ["204B"]
    assert [value(spark, text.clock(F.lit(s))) for s in (0, 61, 3599)] == ["0:00", "1:01", "59:59"]
    labels = spark.createDataFrame([(x,) for x in ("Room 10", "room 9", "2B", "10", "2", None, "A02", "A1")], "l string")
    assert [r.l for r in labels.orderBy(*text.natural_order("l")).collect()] == ["2", "2B", "10", "A1", "A02", "room 9", "Room 10", None]


def test_report_bounds(spark):
    def reason(feet, flights, seconds):
        return value(spark, validate.reject_reason(F.lit(float(feet)), F.lit(flights), F.lit(float(seconds))))

    assert [reason(40, 0, 9.9), reason(40, 0, 10), reason(1200, 0, 1200), reason(1200, 0, 1200.5), reason(1001, 0, 100), reason(99, 0, 100), reason(100, 0, 100)] == ["too_quick", None, None, "too_long", "too_fast", "too_slow", None]
    rows = [("a" * 64, "b", 100.0), ("a" * 65, "b", 100.0), ("", "b", 100.0), ("a", "b", math.nan), ("a", "b", math.inf), ("a", "b", None), ("a", "b", -1.0)]
    df = spark.createDataFrame(rows, "`from` string, `to` string, feet double").withColumns({"flights": F.lit(0), "seconds": F.lit(50.0), "at": F.lit(0)})
    assert validate.valid_reports(df).count() == 1
    now, day = 10**12, 86_400_000
    near = spark.createDataFrame([(now - day + 1,), (now - day,), (now + day,)], "at long").select(F.lit("a").alias("from"), F.lit("b").alias("to"), F.lit(100.4).alias("feet"), F.lit(0).alias("flights"), F.lit(50.5).alias("seconds"), "at")
    got = validate.clean_reports(near, now).collect()
    assert [r["at"] for r in got] == [now - day + 1, now, now] and got[0].feet == 100 and got[0].seconds == 51


def test_estimate_tiers(spark):
    now = 12 * 3_600_000

    def minutes(rows):
        schema = "`from` string, `to` string, feet double, flights int, seconds double, at long"
        wanted = spark.createDataFrame([(1, "a", "b", 480.0, 1, now)], "walk_id int, `from` string, `to` string, feet double, flights int, now long")
        return tuple(estimates.estimate(wanted, spark.createDataFrame(rows, schema)).first())[1:4]

    assert minutes([]) == (2, "default", 0)
    assert minutes([("x", "y", 100.0, 0, 100.0, now)] * 3) == (8, "pace", 3)
    assert minutes([("b", "a", 480.0, 1, 300.0, 0), ("a", "b", 480.0, 1, 180.0, 0)]) == (4, "route", 2)
    assert minutes([("b", "a", 480.0, 1, 300.0, 0)] + [("a", "b", 480.0, 1, 120.0, now + 86_400_000)] * 2) == (2, "route", 3)


def test_merge_is_idempotent_and_diff_of_itself_is_empty(spark):
    r = spark.createDataFrame([("a", "b", i % 3, 5.0, i) for i in range(9)], "`from` string, `to` string, at long, seconds double, ord long")
    once = estimates.merge_reports(r, r)
    assert once.count() == 3 and sorted(once.collect()) == sorted(estimates.merge_reports(once, r).collect()) and max(x.ord for x in once.collect()) == 2
    p = spark.createDataFrame([(1, 1.2, 2.0, "x"), (2, 0.0, 0.0, None)], "id int, x double, y double, label string")
    assert review.diff_points(p, p).count() == 0
    moved = p.select("id", (F.col("x") + 1).alias("x"), "y", F.lit("z").alias("label"))
    assert sorted(r.kind for r in review.diff_points(p, moved).collect()) == ["moved", "moved", "renamed", "renamed"]


def test_search_scores(spark):
    points = spark.createDataFrame(
        [("main", 1, 0, "240", "room", None, None, None), ("main", 1, 1, "124", "room", None, None, None), ("main", 1, 2, "24", "room", None, None, None), ("lower", 0, 3, "C", "room", "Gym", ["24"], None), ("lower", 0, 4, "E1", "entrance", "Door A", None, None), ("upper", 2, 5, "E2", "entrance", "Door A", None, None), ("main", 1, 6, "J", "junction", None, None, None), ("main", 1, 7, "R", "poi", None, None, "restroom")],
        "floor string, floor_idx int, ord long, id string, kind string, label string, aliases array<string>, poi_type string",
    )
    index = search.build_index(points)
    assert index.count() == 6
    found = search.search(index, "24").collect()
    assert [(r.label, r.score) for r in found] == [("24", 0.0), ("Gym", 0.5), ("240", 1.0), ("124", 2.0)]
    assert search.search(index, "wc", has_restrooms=True).first().kind == "nearest-restroom" and search.search(index, "  ").count() == 0
    wanted = spark.createDataFrame([(1, "Room 24", None), (2, "gym", "main:240"), (3, "Door a", "gone"), (4, "?", None)], "place_id int, text string, key string")
    assert {r.place_id: r.resolved for r in search.resolve_places(index, wanted).collect()} == {1: "main:24", 2: "main:240", 3: "entrance:Door A", 4: None}


def brute_runs(path):
    """Straight runs by plain loops, for comparison."""
    wrap = lambda a: (a + math.pi) % (2 * math.pi) - math.pi
    way = lambda p, q: math.atan2(q[1] - p[1], q[0] - p[0])
    cuts, first = [0], way(path[0], path[1])
    for i in range(1, len(path)):
        if abs(wrap(way(path[i - 1], path[i]) - first)) > sequence.SAME_HALLWAY:
            cuts.append(i - 1)
            first = way(path[i - 1], path[i])
    spans = [[path[a], path[b]] for a, b in zip(cuts, [*cuts[1:], len(path) - 1], strict=True)]
    kept = []
    for span in spans:
        if kept and math.dist(*span) < sequence.MIN_RUN:
            kept[-1][1] = span[1]
        else:
            kept.append(list(span))
    while len(kept) > 1 and math.dist(*kept[0]) < sequence.MIN_RUN:
        kept[1][0] = kept[0][0]
        kept.pop(0)
    out = []
    for span in kept:
        if out and abs(wrap(way(*out[-1]) - way(*span))) < sequence.SAME_HALLWAY:
            out[-1][1] = span[1]
        else:
            out.append(list(span))
    return [(*a, *b) for a, b in out]


def test_runs_against_loops(spark):
    rng = random.Random(3)
    paths = [(0, [(0.0, 0.0), (300.0, 0.0)]), (1, [(0.0, 0.0), (300.0, 0.0), (300.0, 300.0)])]
    for i in range(2, 60):
        x = y = a = 0.0
        path = [(x, y)]
        for _ in range(rng.randrange(1, 25)):
            a += rng.choice([0, 0, 0.2, -0.3, math.pi / 2, -math.pi / 2, 1.1])
            d = rng.choice([10, 30, 90, 200])
            x, y = x + d * math.cos(a), y + d * math.sin(a)
            path.append((x, y))
        paths.append((i, path))
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in paths], "id int, path array<struct<x:double,y:double>>")
    got = {r.id: [(s.sx, s.sy, s.ex, s.ey) for s in r.runs] for r in df.select("id", sequence.runs("path").alias("runs")).collect()}
    for i, p in paths:
        assert [pytest.approx(s) for s in brute_runs(p)] == got[i]


def test_directions(spark):
    names = spark.createDataFrame([("main", 1, "Main Level"), ("upper", 2, "Upper Level")], "floor string, idx int, label string")
    path = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    legs = spark.createDataFrame([("r", 0, "main", path((0, 0), (520, 0), (520, 520)), "Door A", "Room 1"), ("r", 1, "upper", path((0, 0), (260, 0), (260, -100)), "Door A", "Room 1")], "route_id string, leg int, floor string, path array<struct<x:double,y:double>>, start_label string, end_label string")
    steps = [r.text for r in sequence.directions(legs, names).orderBy("leg", "step").collect()]
    assert steps == ["Start at Door A", "Head down the hallway for ~200 ft", "Turn right and continue for ~200 ft", "Take the stairs up to the Upper Level", "Continue for ~100 ft", "Room 1 is on your left"]
    assert tuple(sequence.route_totals(legs).first()) == ("r", 538, 1, 3)


def test_directions_over_more_flights_and_short_legs(spark):
    names = spark.createDataFrame([("lower", 0, "Lower Level"), ("main", 1, "Main Level"), ("upper", 2, "Upper Level")], "floor string, idx int, label string")
    schema = "route_id string, leg int, floor string, path array<struct<x:double,y:double>>, start_label string, end_label string"
    path = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    legs = [("a", 0, "lower", path((0, 0), (260, 0)), "A", "B"), ("a", 1, "upper", path((260, 0), (260, 260)), "A", "B"), ("a", 2, "main", path((7, 8)), "A", "B")]
    legs += [("b", 0, "upper", [], "C", "D"), ("b", 1, "lower", None, "C", "D"), ("c", 0, "main", path((1, 2)), "E", "F")]
    said = {}
    for r in sequence.directions(spark.createDataFrame(legs, schema), names).orderBy("route_id", "leg", "step").collect():
        said.setdefault(r.route_id, []).append((r.kind, r.text, r.floor, r.x, r.y))
    assert said["a"] == [
        ("start", "Start at A", "lower", 0, 0), ("walk", "Head down the hallway for ~100 ft", "lower", 260, 0), ("stairs", "Take the stairs 2 flights up to the Upper Level", "lower", 260, 0),
        ("walk", "Continue for ~100 ft", "upper", 260, 260), ("stairs", "Take the stairs down to the Main Level", "upper", 260, 260), ("arrive", "B is right there", "main", 7, 8),
    ]
    assert said["b"] == [("start", "Start at C", "upper", None, None), ("stairs", "Take the stairs 2 flights down to the Lower Level", "upper", None, None), ("arrive", "D is right there", "lower", None, None)]
    assert said["c"] == [("start", "Start at E", "main", 1, 2), ("arrive", "F is right there", "main", 1, 2)]


def test_corners_and_string_pull(spark):
    df = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 9.0}],)], "p array<struct<x:double,y:double>>")
    assert [(q.x, q.y) for q in df.select(sequence.round_corners("p", 50).alias("o")).first().o] == [(0, 0), (6, 0), (9, 3), (9, 9)]
    assert df.select(geometry.path_length("p")).first()[0] == 18
    cells = spark.createDataFrame([([{"x": float(i), "y": 0.0} for i in range(5)] + [{"x": 4.0, "y": float(j)} for j in range(1, 5)], [2 * 65536 + 2, 3 * 65536 + 2, 2 * 65536 + 1, 3 * 65536 + 1, 3 * 65536 + 3])], "p array<struct<x:double,y:double>>, w array<long>")
    assert [(q.x, q.y) for q in cells.select(sequence.string_pull("p", "w").alias("o")).first().o][0::2] == [(0, 0), (4, 4)]


def test_similarity_is_found_again(spark):
    rows = [("k", float(x), float(y), 2 * math.cos(0.3) * x - 2 * math.sin(0.3) * y + 5, 2 * math.sin(0.3) * x + 2 * math.cos(0.3) * y - 1) for x, y in ((0, 0), (3, 1), (-2, 7))]
    f = spatial.fit_similarity(spark.createDataFrame([*rows, ("one", 1.0, 1.0, 2.0, 2.0)], "k string, ax double, ay double, bx double, by double"), ["k"])
    got = {r.k: r for r in f.collect()}
    assert (got["k"].scale, got["k"].angle, got["k"].tx, got["k"].ty) == pytest.approx((2, 0.3, 5, -1)) and got["one"].scale is None


def grid(spark, rows, floor="main"):
    """Cells of a text map: # wall, . public, r room."""
    cells = [(floor, r, c, ch != "#", ch == ".") for r, line in enumerate(rows) for c, ch in enumerate(line)]
    df = spark.createDataFrame(cells, "layer string, r int, c int, walk boolean, pub boolean")
    near = raster.near_wall(df).collect()
    walk = {(x.r, x.c): x.walk for x in near}
    return spark.createDataFrame([(x.layer, x.r, x.c, x.walk, x.pub, x.near_wall, bool(x.walk and walk.get((x.r, x.c + 1))), bool(x.walk and walk.get((x.r + 1, x.c)))) for x in near], "floor string, r int, c int, walk boolean, pub boolean, near_wall boolean, east boolean, south boolean")


def brute_field(cells, source):
    g = {(x.r, x.c): x for x in cells}
    cost = lambda x: (1 if x.pub else 3.2) * (1.5 if x.near_wall else 1)

    def straight(p, q):
        a, b = min(p, q), max(p, q)
        return a in g and b in g and (g[a].east if a[0] == b[0] else g[a].south)

    dist, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, p = heapq.heappop(heap)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                q = (p[0] + i, p[1] + j)
                if q == p or q not in g or not g[q].walk:
                    continue
                u, v = (p[0] + i, p[1]), (p[0], p[1] + j)
                ok = straight(p, q) if not i or not j else all(straight(*e) for e in ((p, u), (p, v), (u, q), (v, q)))
                nd = d + math.hypot(i, j) * 0.5 * (cost(g[p]) + cost(g[q]))
                if ok and nd < dist.get(q, math.inf) - 1e-12:
                    dist[q] = nd
                    heapq.heappush(heap, (nd, q))
    return dist


MAP = ["..........", ".####.rrr.", ".#....rrr.", ".#.######.", "......#...", "####..#.#.", "...#....#."]


def test_fields_two_ways(spark):
    cells = grid(spark, MAP)
    want = brute_field(cells.collect(), (0, 0))
    source = spark.createDataFrame([("s", "main", 0, 0)], "src string, floor string, r int, c int")
    field = graph.distance_fields(cells, source)
    got = {(r.r, r.c): r.dist for r in field.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    node = lambda p: F.concat_ws(":", f"{p}_r", f"{p}_c")
    edges = graph.grid_edges(cells).select(node("a").alias("a"), node("b").alias("b"), "w")
    relaxed = graph.shortest(edges, spark.createDataFrame([("s", "0:0")], "src string, node string")).collect()
    assert {tuple(map(int, r.node.split(":"))): pytest.approx(r.dist) for r in relaxed} == want
    path = graph.trace(field, spark.createDataFrame([("s", "main", 6, 9)], "src string, floor string, r int, c int")).first().path
    assert (path[0].r, path[0].c, path[-1].r, path[-1].c) == (0, 0, 6, 9)


def test_route_over_two_floors(spark):
    cells = grid(spark, ["....", "...."], "main").union(grid(spark, ["....", "...."], "upper"))
    portals = spark.createDataFrame([("st", "main", 0, 3), ("st", "upper", 0, 3)], "link_id string, floor string, r int, c int")
    ends = spark.createDataFrame([("w", "start", "main", 0, 0), ("w", "end", "upper", 0, 0), ("w", "end", "upper", 1, 3), ("no", "start", "main", 0, 0)], "route_id string, role string, floor string, r int, c int")
    rows = routes.route(cells, portals, ends, 2.0).collect()
    assert {r.route_id for r in rows} == {"w"} and len(rows) == 4
    assert rows[0].cost == pytest.approx(220 + 2.0 * 1.5 * 3 + 2.0 * 1.5)


def test_components_and_raster(spark):
    mask = spark.createDataFrame([("m", r, c) for r, line in enumerate(["##..#", "#...#", "....#", "###.."]) for c, ch in enumerate(line) if ch == "#"], "layer string, r int, c int")
    sizes = sorted(r["count"] for r in raster.label(mask).groupBy("component").count().collect())
    assert sizes == [3, 3, 3] and raster.despeckle(mask, 4).count() == 0
    boxes = raster.rectangles(mask)
    assert sorted(raster.fill_rectangles(boxes).collect()) == sorted(mask.collect())
    ring = spark.createDataFrame([("m", r, c) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)], "layer string, r int, c int")
    assert raster.fill_holes(ring).count() == 25 and raster.boundary_edges(ring).count() == 20 + 12


def test_bit_planes(spark):
    bits = spark.createDataFrame([("f", "pQ==")], "floor string, b string").select(*[floors.bit("b", F.lit(i)).alias(str(i)) for i in range(8)]).first()
    assert [int(b) for b in bits] == [1, 0, 1, 0, 0, 1, 0, 1]


def test_floor_files(spark, tmp_path):
    data = {"id": "main", "label": "Main", "image": {"w": 10, "h": 10}, "points": {"b": {"x": 1, "y": 2, "kind": "room"}, "245": {"x": 1, "y": 2, "kind": "room", "aliases": ["x"]}, "9": {"x": 0, "y": 0, "kind": "poi", "poiType": "stairs"}}, "edges": [{"a": "b", "b": "9"}], "entrances": []}
    (tmp_path / "main.json").write_text(json.dumps(data))
    read = floors.read_json(spark, str(tmp_path), floors.FLOOR)
    points = floors.points(read)
    assert [r.id for r in points.orderBy("ord").collect()] == ["9", "245", "b"] and floors.edges(read).first().auto is False
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "links.json").write_text(json.dumps([{"id": "s1", "kind": "stairs", "verified": False, "points": {"main": "9", "upper": "gone"}}]))
    assert [(r.link_id, r.floor) for r in floors.link_ends(floors.read_json(spark, str(tmp_path / "l"), floors.LINKS), points).collect()] == [("s1", "main")]


def test_logs(spark, tmp_path):
    lines = spark.createDataFrame([('{"from":"a","to":"b","feet":100,"flights":0,"seconds":50,"at":7}',), ("{oops",), ('{"from":1}',), ("[]",)], "value string")
    assert [r["at"] for r in reports.parse_reports(lines).collect()] == [7]
    assert reports.read_or_empty(spark, f"{tmp_path}/none", "at long").count() == 0
    log = spark.range(50).select(F.col("id").alias("at"))
    reports.append(log, f"{tmp_path}/log")
    reports.compact(spark, f"{tmp_path}/log", f"{tmp_path}/kept", 10)
    assert spark.read.parquet(f"{tmp_path}/kept").agg(F.min("at"), F.count("at")).first()[:] == (40, 10)


def greedy_wells(marks, reach):
    """Marks (ord, floor, x, y) of one building to (link, ord), one after another."""
    wells = []
    for n, floor, x, y in sorted(marks):
        hit = next((w for w in wells if math.hypot(w[0][2] - x, w[0][3] - y) < reach), None)
        if hit is None:
            wells.append([(n, floor, x, y)])
        elif all(m[1] != floor for m in hit):
            hit.append((n, floor, x, y))
    return {(i, m[0]) for i, w in enumerate([w for w in wells if len(w) > 1]) for m in w}


def test_stairwells_against_marks_one_after_another(spark):
    rng = random.Random(5)
    crowd = [(i, rng.randrange(3), rng.uniform(-400, 400), rng.uniform(-400, 400)) for i in range(300)]
    copies = [(i, i % 4, 50.0, 50.0) for i in range(200)] + [(1000 + i, i % 4, 50.0 + i, 50.0) for i in range(150)]
    chain = [(i, i % 2, 60.0 * i, 0.0) for i in range(12)]
    exact = [(0, 0, 0.0, 0.0), (1, 1, 130.0, 0.0), (2, 2, 129.9, 0.0), (3, 0, 1.0, 0.0), (4, 1, 1.0, 0.0)]
    nowhere = [(0, 0, None, 1.0), (1, 1, float("nan"), 1.0), (2, 2, float("inf"), 1.0), (3, 0, 5.0, 5.0), (4, 1, 5.0, 5.0), (4, 1, 5.0, 5.0)]
    all_ = {1: crowd, 2: copies, 3: chain, 4: exact, 5: nowhere, 6: [(7, 0, 1.0, 1.0)]}
    schema = "grp long, ord long, floor long, x double, y double"
    found = spatial.stair_links(spark.createDataFrame([(g, *m) for g, ms in all_.items() for m in ms], schema)).collect()
    assert len(found) == len(set(found))
    for g, ms in all_.items():
        want = greedy_wells([m for m in ms if m[2] is not None and math.isfinite(m[2])], 130.0)
        assert {(r.link, r.ord) for r in found if r.grp == g} == want, g
    assert spatial.stair_links(spark.createDataFrame([], schema)).count() == 0
