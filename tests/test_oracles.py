"""Every query with SQL gives the rows of DuckDB on the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from corridora.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6g}")
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLES[name])
    a, b = rows(ours.columns, ours.collect()), rows(theirs.columns, theirs.fetchall())
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        assert all(u == v or (isinstance(u, float) or isinstance(v, float)) and u is not None and v is not None and math.isclose(u, v, rel_tol=1e-4, abs_tol=1e-5) for u, v in zip(x, y, strict=True)), (x, y)


def test_every_query_has_sql_or_a_plain_reading():
    assert set(QUERIES) - set(ORACLES) == {"walking_directions"}


def plain_runs(path):
    """Straight runs of a path, told step by step."""
    wrap = lambda d: d - 2 * math.pi * math.floor((d + math.pi) / (2 * math.pi)) if abs(d) > math.pi else d
    bearing = lambda a, b: math.atan2(b[1] - a[1], b[0] - a[0])
    limit, least = math.radians(42), 28 * 2.6
    if len(path) < 2:
        return [], wrap
    cuts, first = [path[0]], bearing(path[0], path[1])
    for a, b in zip(path, path[1:]):
        step = bearing(a, b)
        if abs(wrap(step - first)) > limit:
            cuts.append(a)
            first = step
    pieces = list(zip(cuts, [*cuts[1:], path[-1]]))
    merged = []
    for a, b in pieces:
        if merged and math.dist(a, b) < least:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    opened = []
    for a, b in merged:
        if len(opened) == 1 and math.dist(*opened[0]) < least:
            opened[0] = (opened[0][0], b)
        else:
            opened.append((a, b))
    out = []
    for a, b in opened:
        if out and abs(wrap(bearing(a, b) - bearing(*out[-1]))) < limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [(math.dist(a, b), bearing(a, b)) for a, b in out], wrap


def test_walking_directions_against_a_plain_reading(spark):
    from corridora.plans.space import _legs

    legs = {}
    for x in _legs(spark, SF).collect():
        legs.setdefault(x.route_id, []).append(x)
    want = []
    spoken = lambda px: (math.floor(px / 2.6 / 10 + 0.5) * 10 if px / 2.6 >= 100 else math.floor(px / 2.6 / 5 + 0.5) * 5)
    for route, parts in legs.items():
        parts.sort(key=lambda x: x.leg)
        for k, leg in enumerate(parts):
            runs, wrap = plain_runs([(p.x, p.y) for p in leg.path])
            last = k == len(parts) - 1
            if k == 0:
                want.append((route, leg.leg, "start", f"Start at {leg.start_label}"))
            for i, (px, b) in enumerate(runs[:-1] if last and len(runs) > 1 else runs):
                feet = spoken(px)
                turn = math.degrees(abs(wrap(b - runs[i - 1][1]))) if i else 0
                side = "right" if i and wrap(b - runs[i - 1][1]) > 0 else "left"
                phrase = f"Bear {side}" if 30 <= turn < 60 else f"Turn {side}" if 60 <= turn < 135 else f"Turn sharply {side}" if turn >= 135 else None
                said = f"Head down the hallway for ~{feet} ft" if i == 0 and k == 0 else f"Continue for ~{feet} ft" if i == 0 else f"{phrase} and continue for ~{feet} ft" if phrase else f"Keep going for ~{feet} ft"
                want.append((route, leg.leg, "walk", said))
            if last:
                delta = wrap(runs[-1][1] - runs[-2][1]) if len(runs) > 1 else 0
                where = " right there" if len(runs) < 2 else (" on your right" if delta > 0 else " on your left") if abs(math.degrees(delta)) > 30 else " straight ahead"
                want.append((route, leg.leg, "arrive", f"{leg.end_label} is{where}"))
            else:
                want.append((route, leg.leg, "stairs", "Take the stairs up to the Upper Level"))
    ours = [(x.route_id, x.leg, x.kind, x.text) for x in QUERIES["walking_directions"](spark, SF).collect()]
    assert len(ours) == len(want) > 1000 and sorted(ours) == sorted(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
