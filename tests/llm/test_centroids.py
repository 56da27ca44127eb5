"""Centroid clustering against plain Python integers, and its defined results."""

import hashlib
import math

import numpy as np
import pytest

from corridora.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, distance string, __found int"


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) if abs(scale * x) < math.inf else scale * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    start = sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    at = [list(q) for _, q in start]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    near = lambda q: min((far(q, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        found = [near(q)[1] for _, q in kept]
        at = [[sum(c) // len(c) for c in zip(*m)] if (m := [q for (_, q), f in zip(kept, found) if f == j]) else at[j] for j in range(len(at))]
    found = [(i, *near(q)) for i, q in kept]
    per = [sum(d for _, d, f in found if f == j) for j in range(len(at))]
    most = 2**63 - 1
    return sorted(((i, f, min(d, most), min(per[f], most), min(sum(per), most), sha(",".join(map(str, at[f])))) for i, d, f in found), key=str)


def ours(df, **more):
    found = centroids.cluster(df, centroids.fit(df, **more), **{k: v for k, v in more.items() if k in ("dims", "scale")})
    return sorted([tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=str)


def test_query_against_plain_integers(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op11_centroids(spark, sf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(rows)


def test_awkward_vectors(spark):
    random = np.random.default_rng(5)
    rows = [(i, random.normal(size=64).astype(np.float32).tolist()) for i in range(40)]
    rows += [(i, rows[0][1]) for i in range(100, 130)] + [(3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]
    bad = [(200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 65), (204, [None] + [0.0] * 63), (205, [math.nan] + [0.0] * 63), (206, [math.inf] + [0.0] * 63), (207, [-math.inf] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], SCHEMA).repartition(3)
    assert ours(df) == plain(rows) and set(df.columns) - {"distance"} <= set(centroids.cluster(df, centroids.fit(df)).columns)
    few = spark.createDataFrame([(i, v, "x", 1) for i, v in rows[:5]], SCHEMA)
    assert ours(few) == plain(rows[:5])
    same = [(i, [0.5] * 64) for i in range(30)]
    assert ours(spark.createDataFrame([(i, v, "x", 1) for i, v in same], SCHEMA)) == plain(same)


def test_huge_components_and_nothing(spark):
    random = np.random.default_rng(6)
    rows = [(i, [float(x) for x in random.normal(size=64) * 10.0 ** random.integers(-2, 30)]) for i in range(60)]
    rows.append((60, [1.7e308, -1.7e308] * 32))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert ours(df) == plain(rows)
    assert ours(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("dims", [3, 20])
def test_abandoning_never_changes_a_result(dims):
    random = np.random.default_rng(dims)
    q = random.integers(-3, 4, (3000, dims))  # many ties
    c = random.integers(-3, 4, (16, dims))
    found, best = centroids.Centroids(c.tolist(), random.permutation(dims).tolist()).nearest(q)
    d = ((q[:, None] - c[None]) ** 2).sum(axis=2)
    assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
