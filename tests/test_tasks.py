"""Operators that share out what one task or one comparison after another did before."""

import math
import random

import __spark_entry__
from corridora.operators import sequence, spatial, voting
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_equal_vectors_of_two_classes_tie_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(voting, "BLOCK_ROWS", 9)
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(12)]
    rows = [(i, vectors[i * 5 % 12], i * 7 % 4) for i in range(45)]
    t = spark.createDataFrame(rows, "t_id int, t array<double>, label int")
    found = voting.classify(t.select(F.col("t_id").alias("q_id"), F.col("t").alias("q")), t)
    assert "NestedLoop" not in found._jdf.queryExecution().sparkPlan().toString()
    got = {r.q_id: (r.label, r.score, r.margin) for r in found.collect()}
    for i, v, _ in rows:
        best = {}
        for j, w, label in rows:
            if i != j:
                best[label] = max(best.get(label, -math.inf), math.fsum(a * b for a, b in zip(v, w)))
        order = sorted(best, key=lambda x: (round(-best[x], 9), x))
        assert got[i][0] == order[0] and math.isclose(got[i][1], best[order[0]], rel_tol=1e-12) and math.isclose(got[i][2], best[order[0]] - best[order[1]], abs_tol=1e-12)


def test_vectors_of_other_lengths_have_no_score(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [2.0, 2.0], "b"), (3, [9.0, 9.0, 9.0], "b"), (4, [None, 5.0], "c"), (5, None, "c")], "t_id int, t array<double>, label string")
    q = spark.createDataFrame([(7, [1.0, 1.0]), (8, [1.0])], "q_id int, q array<double>")
    assert sorted(map(tuple, voting.class_scores(q, t).collect())) == [(7, "a", 3.0), (7, "b", 4.0)]


def test_nearest_neighbours_meet_in_blocks(spark):
    found = __spark_entry__.queries()["nearest_neighbour"](spark, SF)
    assert "NestedLoop" not in found._jdf.queryExecution().sparkPlan().toString() and found.count() == 10


def test_nearest_points_in_crowds_and_far_off(spark):
    """Hundreds of points at few places, queries at one place and queries far from all points."""
    points = [(i, float(i * 37 % 8), float(i * 91 % 6)) for i in range(400)] + [(1000, 500.0, 500.0)]
    queries = [(i, float(i % 5), 2.0) for i in range(20)] + [(100, 90_000.0, -70_000.0), (101, 250.5, 260.25), (102, -0.0, 0.0)]
    p, q = spark.createDataFrame(points, "p_id int, x double, y double"), spark.createDataFrame(queries, "q_id int, qx double, qy double")
    got = {}
    for r in spatial.knn(q, p, 3, 100.0).collect():
        got.setdefault(r.q_id, {})[r.rank] = r.p_id
    for i, x, y in queries:
        want = sorted(points, key=lambda w: (math.hypot(w[1] - x, w[2] - y), w[0]))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [w[0] for w in want]


def test_points_rounded_row_by_row_are_the_path_rounded_whole(spark):
    rng = random.Random(2)
    paths = {k: [(float(rng.randrange(60)), float(rng.randrange(60))) for _ in range(n)] for k, n in enumerate((1, 2, 3, 9, 30))}
    p = spark.createDataFrame([(k, s, *xy) for k, path in paths.items() for s, xy in enumerate(path)], "route_id int, seq int, x double, y double")
    got = {}
    for r in sorted(sequence.rounded_points(p, 18.0).collect(), key=lambda r: (r.route_id, r.i, r.part)):
        got.setdefault(r.route_id, []).append((r.x, r.y))
    whole = spark.createDataFrame([(k, path) for k, path in paths.items()], "k int, p array<struct<x:double,y:double>>").select("k", sequence.round_corners("p", 18.0).alias("o"))
    assert {r.k: [(q.x, q.y) for q in r.o] for r in whole.collect()} == got
