"""Polygon overlay against exact clipping of convex pairs, and on outlines known beforehand."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corridora.functions.geometry import signed_area
from corridora.operators import overlay

SCHEMA = "layer int, poly_id int, ring array<struct<x:double,y:double>>"
EACH = ("union", "intersection", "difference")


def frame(spark, rows):
    return spark.createDataFrame([(layer, p, [(float(x), float(y)) for x, y in ring] if ring is not None else None) for layer, p, ring in rows], SCHEMA)


def areas(spark, a, b, **more):
    got = overlay.overlay(frame(spark, a), frame(spark, b), **more).groupBy("how", "layer").agg(F.sum(signed_area("ring")).alias("area"), F.count(F.lit(1)).alias("rings")).collect()
    return {(r.how, r.layer): (r.area, r.rings) for r in got}


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def clipped(ring, by):
    """A convex ring cut by another one, both counter-clockwise, in fractions."""
    for p, q in zip(by, by[1:] + by[:1]):
        side = lambda s: (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])  # noqa: B023, E731
        out = []
        for s, t in zip(ring, ring[1:] + ring[:1]):
            u, v = side(s), side(t)
            if u >= 0:
                out.append(s)
            if u * v < 0:
                k = u / (u - v)
                out.append((s[0] + k * (t[0] - s[0]), s[1] + k * (t[1] - s[1])))
        ring = out
    return ring


def hull(random_, n):
    x, y, r = random_.uniform(0, 40), random_.uniform(0, 40), random_.uniform(5, 20)
    at = sorted(random_.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t in at]


def test_convex_pairs_against_exact_clipping(spark):
    rng = random.Random(7)
    a, b, want = [], [], {}
    for layer in range(40):
        one, two = hull(rng, rng.randrange(3, 8)), hull(rng, rng.randrange(3, 8))
        exact = [[(Fraction(x), Fraction(y)) for x, y in r] for r in (one, two)]
        both = clipped(*exact)
        n = float(area(both)) if len(both) > 2 else 0.0
        want[layer] = (float(area(exact[0])) + float(area(exact[1])) - n, n, float(area(exact[0])) - n)
        a.append((layer, 1, one))
        b.append((layer, 1, two[::-1]))  # the order of a ring says nothing
    got = areas(spark, a, b)
    for layer, expected in want.items():
        for how, value in zip(EACH, expected):
            assert got.get((how, layer), (0.0, 0))[0] == pytest.approx(value, abs=2e-4), (layer, how)


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_outlines_known_beforehand(spark):
    third = 1 / 3
    a = [
        (0, 1, square(0, 0, 1)), (0, 2, square(1, 0, 1)), (0, 3, square(1, 0, 1)),  # neighbours and a copy dissolve
        (1, 1, square(0, 0, 9)), (1, 1, square(third, third, 3)),  # a hole off the grid
        (2, 1, square(0, 0, 2)), (2, 2, square(2, 2, 2)),  # corners that touch stay two rings
        (3, 1, square(0, 0, 2)), (3, 2, [(0, 0), (1, 1)]), (3, 3, []), (3, 4, None), (3, 5, [(0, 0), (0, 0), (0, 0)]),
        (4, 1, [(0, 0), (2, 2), (2, 0), (0, 2)]),  # a bow tie by the even-odd rule
        (5, 1, square(0, 0, 4)),
    ]
    b = [(1, 7, square(1, 1, 1)), (4, 1, square(10, 10, 1)), (5, 1, square(0, 0, 4)), (6, 1, square(0.1, 0.2, 0.3))]
    got = areas(spark, a, b)
    near = lambda v, n: (pytest.approx(v, abs=1e-5), n)
    assert got["union", 0] == near(2, 1) and got["difference", 0] == near(2, 1)
    assert got["union", 1] == near(73, 3) and got["difference", 1] == near(72, 2) and ("intersection", 1) not in got
    assert got["union", 2] == near(8, 2)
    assert got["union", 3] == near(4, 1)
    assert got["union", 4] == near(3, 3) and got["difference", 4] == near(2, 2)
    assert got["union", 5] == near(16, 1) and got["intersection", 5] == near(16, 1) and ("difference", 5) not in got
    assert got["union", 6] == near(0.09, 1) and ("difference", 6) not in got


def test_vertices_off_the_grid_are_kept(spark):
    a = [(0, 1, [(0.1, 0.2), (7.3, 0.7), (5.9, 6.1)])]
    (row,) = overlay.overlay(frame(spark, a), frame(spark, []), ("union",)).collect()
    assert sorted((round(p.x, 5), round(p.y, 5)) for p in row.ring) == sorted(a[0][2])


def test_crowded_polygons_sum_up(spark):
    """Of many overlapping polygons: union = difference + the other set's union, intersection = what both hold."""
    rng = random.Random(3)
    a, b = [(0, i, hull(rng, 5)) for i in range(25)], [(0, i, hull(rng, 4)) for i in range(25)]
    got = areas(spark, a, b, size=3.0)
    other = areas(spark, b, a)
    assert got["union", 0][0] == pytest.approx(other["union", 0][0], abs=1e-3)
    assert got["intersection", 0][0] == pytest.approx(other["intersection", 0][0], abs=1e-3)
    assert got["union", 0][0] == pytest.approx(got["difference", 0][0] + other["difference", 0][0] + got["intersection", 0][0], abs=1e-3)
    # the same by sampling
    inside = lambda rings, x, y: any(sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(r, r[1:] + r[:1])) % 2 for _, _, r in rings)
    n, hits = 160, 0
    for i in range(n):
        for j in range(n):
            x, y = -20 + 80 * (i + 0.5) / n, -20 + 80 * (j + 0.5) / n
            hits += inside(a, x, y) and inside(b, x, y)
    assert got["intersection", 0][0] == pytest.approx(hits * (80 / n) ** 2, rel=0.02)


def test_union_of_one_set(spark):
    (row,) = overlay.union_all(frame(spark, [(0, i, square(i * 0.5, 0, 1)) for i in range(5)])).collect()
    assert sorted((p.x, p.y) for p in row.ring) == [(0, 0), (0, 1), (3, 0), (3, 1)]
