import math
import random

import pytest

from corridora.llm import mixing

from .fixtures import DOCS, documents, nothing, spaced


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    """Reshares the excess over caps until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), budget * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_targets_and_rounding(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([3, 40, 200, 900])), rng.choice(["hot"] * 5 + ["b", "c", "d", None, "é"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len(spaced(text))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t + 900
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def brute_multiplier(sizes, target, cap=2.0):
    """The multiplier of one source by plain bisection over its documents."""
    mean = sum(sizes) / len(sizes)
    lo, hi = -1e7, 1e7
    for _ in range(200):
        mid = (lo + hi) / 2
        got = sum(min(cap, math.exp(min(700, mid * n / mean))) * n for n in sizes)
        lo, hi = (mid, hi) if got < target else (lo, mid)
    return (lo + hi) / 2, mean


def test_rates_against_brute_force(spark):
    """Documents are tilted by their length; the rates solve the dual, and thinned sources lose long documents first."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 64, 200, 1000])), "abc"[min(2, i % 7)]) for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    for source in "abc":
        mine = [r for r in got if r.source == source]
        sizes, target = [r["size"] for r in mine], mine[0].target
        assert sum(r.rate * r["size"] for r in mine) == pytest.approx(target, rel=1e-6)
        assert abs(sum(r.taken for r in mine) - target) <= 1000
        lam, mean = brute_multiplier(sizes, target)
        for r in mine:
            assert r.rate == pytest.approx(min(2.0, math.exp(lam * r["size"] / mean)), rel=1e-5)
        assert len({round(r.rate, 6) for r in mine}) > 2 or target >= 2 * sum(sizes) * (1 - 1e-9)


def test_rows_that_repeat_are_dealt_copies_each(spark):
    rows = [(1, "a b c", "s")] * 300 + [(i, "d e f g", "t") for i in range(2, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    mine = [r for r in got if r.doc_id == 1]
    assert len(got) == len(rows) and len(mine) == 300
    assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3 and {r.copies for r in mine} <= {0, 1, 2}
    copies = sum(r.copies for r in mine)
    assert mixing.mixed_documents(df).where("doc_id = 1").count() == copies


def test_awkward_documents(spark):
    got = mixing.mix(documents(spark)).collect()
    assert len(got) == len(DOCS) and all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.mix(nothing(spark)).count() == 0
    docs = documents(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(v for k, v in counts.items() if k != 7) <= 2 and counts.get(3) is None


def test_a_very_long_text_is_a_stratum(spark):
    rows = [(0, "w " * 400_000, "a"), *[(i, "w w w", "a") for i in range(1, 50)], (99, "w w", "b")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["size"] == 400_000 and all(0 <= r.copies <= 2 for r in got.values())
    assert got[99].taken == 4  # a source that is small takes its cap
