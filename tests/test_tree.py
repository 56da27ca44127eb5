"""Nearest neighbours through the tree against all pairs."""

import math
import random

import pytest

from corridora.operators import tree

POINTS, QUERIES = "p_id long, x double, y double", "q_id long, qx double, qy double"


def all_pairs(queries, points, k):
    out = set()
    for q, qx, qy in queries:
        if all(v is not None and math.isfinite(v) for v in (qx, qy)):
            near = sorted((math.hypot(x - qx, y - qy), p) for p, x, y in points if x is not None and y is not None and math.isfinite(x) and math.isfinite(y))[:k]
            out |= {(q, p, i + 1) for i, (_, p) in enumerate(near)}
    return out


def shapes():
    rng = random.Random(8)
    crowd = [(i, rng.uniform(0, 1e-6), rng.uniform(0, 1e-6)) for i in range(900)] + [(900 + i, rng.uniform(0, 1e6), rng.uniform(0, 1e6)) for i in range(9)]
    return {
        "crowd": crowd,
        "far": [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(300)] + [(300, 1e12, -1e12)],
        "copies": [(i, 5.0, 5.0) for i in range(400)] + [(400 + i, float(i % 7), float(i % 5)) for i in range(100)],
        "line": [(i, float(i), 3.0) for i in range(200)],
        "powers": [(i, 4.0**-i, 0.0) for i in range(45)],
        "grid": [(i, float(i % 20), float(i // 20)) for i in range(400)],
        "few": [(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1.0, float("inf")), (5, 2.0, 0.0), (5, 2.0, 0.0)],
    }


@pytest.mark.parametrize("name", list(shapes()))
def test_the_tree_tells_what_all_pairs_tell(spark, name):
    points, rng = shapes()[name], random.Random(3)
    queries = [(i, rng.uniform(-2, 12), rng.uniform(-2, 12)) for i in range(15)] + [(100 + i, float(i), float(i)) for i in range(5)]
    queries += [(200, 5e-7, 5e-7), (201, 1e6, 3e5), (202, -50.0, 80.0), (203, None, 1.0), (204, float("nan"), 1.0), (205, 1.0, float("inf"))]
    t = tree.point_tree(spark.createDataFrame(points, POINTS), 5)
    found = tree.nearest_in_tree(spark.createDataFrame(queries, QUERIES), t).collect()
    assert sorted((r.q_id, r.p_id, r["rank"]) for r in found) == sorted(all_pairs(queries, points, 5))
    largest = t.points.groupBy("path").count().agg({"count": "max"}).first()[0]
    assert largest <= tree.LEAF


def test_empty_tables_and_fewer_neighbours(spark):
    points, queries = shapes()["grid"], [(1, 3.2, 4.1), (2, 30.0, 30.0)]
    t = tree.point_tree(spark.createDataFrame(points, POINTS), 4)
    asked = spark.createDataFrame(queries, QUERIES)
    assert {(r.q_id, r.p_id, r["rank"]) for r in tree.nearest_in_tree(asked, t, 2).collect()} == all_pairs(queries, points, 2)
    assert tree.nearest_in_tree(asked.limit(0), t).count() == 0
    assert tree.nearest_in_tree(asked, tree.point_tree(spark.createDataFrame([], POINTS), 3)).count() == 0
    with pytest.raises(ValueError):
        tree.nearest_in_tree(asked, t, 5)
