"""Many searches by the substring tables against one search after another."""

import random

import pytest
from pyspark.sql import functions as F

from corridora.operators import search

SCHEMA = "key string, id string, floor string, floor_idx int, ord int, label string, kind string, aliases array<string>"


def test_many_searches_are_single_ones(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aboRm 12é") for _ in range(rng.randrange(0, 7)))
    rows = [(f"m:{i}", str(i), "main", i % 3, i, word(), "room", rng.choice([None, [], [word()], [word(), None, word()]])) for i in range(300)]
    rows += [("m:r", "r", "main", 0, 900, "Room Service", "room", ["Desk"]), ("m:u", "u", "main", 0, 901, "UPPER", "room", None)]
    index = spark.createDataFrame(rows, SCHEMA)
    asked = ["r", "ro", "roo", "room", "Room ", "room a", "room ab", "room 12a", "1", "12", "2é", "ab1", "aboR", " desk ", "upper", "nowhere", "", None, "service", "m S", "oom"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    tables = search.substrings(index)
    found = search.search_many(index, queries, limit=10, built=tables)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.key, r.score))
    for i, text in enumerate(asked):
        want = [(k + 1, r.key, r.score) for k, r in enumerate(search.search(index, text or "", limit=10).collect())]
        assert sorted(got.get(i, [])) == want, text
    with pytest.raises(ValueError):
        search.search_many(index, queries, limit=51)


def test_an_empty_index(spark):
    index = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, "a"), (2, "room")], "query_id int, query string")
    assert search.search_many(index, queries).count() == 0 and search.substrings(index).first.select(F.count("*")).first()[0] == 0


def test_an_index_is_met_by_sorted_parts(spark):
    """An index of many rows can lie in a small file, so it is not Spark's choice to broadcast it."""
    import __spark_entry__

    found = __spark_entry__.queries()["ranked_searches"](spark, "/root/testdata/sf0.1")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [key" not in plan and found.count() == 32
