"""Distances and registration against brute force on small rasters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridora.operators import distance, raster, registration


def cells(spark, rows, layer="a"):
    return spark.createDataFrame([(layer, int(r), int(c)) for r, c in rows], "layer string, r int, c int")


@pytest.mark.parametrize("strip", [3, 128])
def test_nearest_cells_of_sparse_sets(spark, monkeypatch, strip):
    monkeypatch.setattr(distance, "STRIP", strip)
    rng = random.Random(strip)
    everything, wanted = [], {}
    for layer in ("a", "b", "c"):
        own = [(rng.randrange(-20, 40), rng.randrange(-30, 30)) for _ in range(60)]
        have = [(rng.randrange(-25, 45), rng.randrange(-40, 40)) for _ in range({"a": 30, "b": 1, "c": 0}[layer])]
        everything.append((layer, own, have))
        if have:
            for r, c in own:
                d, nr, nc = min(((r - i) ** 2 + (c - j) ** 2, i, j) for i, j in have)
                wanted[layer, r, c] = (nr, nc, d)
    frame = lambda k: spark.createDataFrame([(e[0], r, c) for e in everything for r, c in e[k]], "layer string, r int, c int")
    got = distance.nearest_cells(frame(1), frame(2)).collect()
    assert {(x.layer, x.r, x.c): (x.near_r, x.near_c, x.square) for x in got} == wanted and len(got) == len(wanted)


def test_distances_take_two_passes_however_wide_a_mask_is(spark):
    n = 260
    mask = [(r, c) for r in range(5) for c in range(n)] + [(r, c) for r in range(60) for c in range(100, 131)]
    got = {(x.r, x.c): x.distance for x in distance.distances(cells(spark, mask)).collect()}
    inside = np.zeros((62, n + 2), bool)
    for r, c in mask:
        inside[r + 1, c + 1] = True
    out = np.argwhere(~inside) - 1
    for r, c in rng_sample(list(set(mask)), 300):
        assert got[r, c] == pytest.approx(np.sqrt(((out - (r, c)) ** 2).sum(axis=1).min()))
    plan = distance.nearest_cells(cells(spark, mask), cells(spark, mask))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def rng_sample(rows, n):
    return random.Random(1).sample(sorted(rows), min(n, len(rows)))


def test_poles_are_euclidean(spark):
    # a plus sign: by eight-neighbour rounds its arms are as deep as its middle, by distance the middle wins
    plus = [(r, c) for r in range(15) for c in range(15) if 5 <= r < 10 or 5 <= c < 10]
    labelled = cells(spark, plus).withColumn("component", F.lit("x"))
    (p,) = distance.poles(labelled).collect()
    assert (p.r, p.c) == (7, 7) and p.distance == pytest.approx(np.hypot(3, 3))
    empty = labelled.limit(0)
    assert distance.poles(empty).count() == 0


def test_shifts_over_borders_of_tiles(spark):
    rng = random.Random(2)
    fixed = {(rng.randrange(-70, 70), rng.randrange(-70, 70)) for _ in range(400)}
    moving = {(r - 37, c + 21) for r, c in fixed if rng.random() < 0.6} | {(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(100)}
    want = {}
    for r, c in fixed:
        for i, j in moving:
            if abs(r - i) <= 40 and abs(c - j) <= 40:
                want[r - i, c - j] = want.get((r - i, c - j), 0) + 1
    for size in (8, 64):
        got = registration.shift_votes(cells(spark, fixed), cells(spark, moving), 40, size=size).collect()
        assert {(x.dr, x.dc): x.both for x in got} == want and len(got) == len(want)
    best = registration.best_shift(cells(spark, fixed), cells(spark, moving), 40).first()
    assert (best.dr, best.dc, best.both) == (37, -21, want[37, -21])
    # two poses of the moving mask against one copy of the fixed one
    both = cells(spark, moving).withColumn("p_id", F.lit(1)).union(cells(spark, fixed).withColumn("p_id", F.lit(2)))
    apart = {x.p_id: (x.dr, x.dc) for x in registration.best_shift(cells(spark, fixed), both, 40, by="p_id").collect()}
    assert apart == {1: (37, -21), 2: (0, 0)}


def bilinear(image, k, t, x, y, rows, columns):
    out = {}
    for r in rows:
        for c in columns:
            u, v = (np.cos(t) * (c - x) + np.sin(t) * (r - y)) / k, (np.cos(t) * (r - y) - np.sin(t) * (c - x)) / k
            i, j = int(np.floor(v)), int(np.floor(u))
            s = sum(image.get((i + a, j + b), 0) * (1 - abs(v - i - a)) * (1 - abs(u - j - b)) for a in (0, 1) for b in (0, 1))
            if s > 1e-9:
                out[r, c] = s
    return out


@pytest.mark.parametrize("pose", [(1.0, 0.0, 0.0, 0.0), (1.7, 0.6, -3.2, 4.5), (0.4, -2.0, 7.3, 0.1)])
def test_warping_samples_bilinearly(spark, pose):
    rng = random.Random(3)
    image = {(rng.randrange(12), rng.randrange(12)): rng.random() + 0.1 for _ in range(60)}
    df = spark.createDataFrame([("a", r, c, v) for (r, c), v in image.items()], "layer string, r int, c int, value double")
    got = registration.warp(df, **{n: F.lit(v) for n, v in zip(("scale", "angle", "tx", "ty"), pose)}).where("value > 1e-9").collect()
    want = bilinear(image, *pose, range(-40, 50), range(-40, 50))
    assert {(x.r, x.c) for x in got} == set(want)
    assert all(x.value == pytest.approx(want[x.r, x.c], abs=1e-9) for x in got)


def test_correlation_and_refused_scales(spark):
    a = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("b", 0, 0, 1.0)], "layer string, r int, c int, value double")
    b = spark.createDataFrame([("a", 0, 1, 4.0), ("a", 5, 5, 3.0)], "layer string, r int, c int, value double")
    assert {x.layer: x.ncc for x in registration.correlation(a, b).collect()} == {"a": pytest.approx(8 / np.sqrt(5 * 25))}
    with pytest.raises(Exception, match="scales must lie"):
        registration.warp(a, scale=F.lit(9.0), angle=F.lit(0.0), tx=F.lit(0.0), ty=F.lit(0.0)).collect()


def test_simplex_finds_a_valley():
    s = registration._Simplex((3.0, -2.0, 1.0, 5.0), (0.5, 0.5, 0.5, 0.5))
    cost = lambda p: float(((p - np.array([1.0, 1.0, -2.0, 0.5])) ** 2 * (1, 10, 2, 5)).sum())
    for _ in range(400):
        if s.done((1e-4,) * 4):
            break
        asked = s.ask()
        s.tell(asked, [cost(p) for p in asked])
    assert np.allclose(s.points[0], [1.0, 1.0, -2.0, 0.5], atol=1e-2)


def test_a_simplex_that_ends_too_early_is_not_believed(spark):
    """On this mask the simplex of the first steps alone ended with a corner half a cell off."""
    g = np.random.default_rng(104).integers(1, 51, 1000) > 12
    mask = spark.createDataFrame([(0, int(i) // 40, int(i) % 40) for i in np.flatnonzero(g)], "layer int, r int, c int")
    image = raster.density(mask, 2).withColumnRenamed("share", "value")
    k, t, x, y = known = (1.1, 0.05, 2.5, -1.25)
    moved = registration.warp(image, scale=F.lit(k), angle=F.lit(t), tx=F.lit(x), ty=F.lit(y))
    found = registration.fit_poses(moved, image, {0: (k - 0.02, t + 0.02, x - 1.0, y + 0.8)}, ends=(2e-3, 2e-3, 0.1, 0.1)).first()
    at = lambda p, c, r: (p[0] * (math.cos(p[1]) * c - math.sin(p[1]) * r) + p[2], p[0] * (math.sin(p[1]) * c + math.cos(p[1]) * r) + p[3])
    pose = (found.scale, found.angle, found.tx, found.ty)
    assert max(math.dist(at(pose, c, r), at(known, c, r)) for c in (0, 39) for r in (0, 24)) < 0.4
