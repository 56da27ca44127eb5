"""What only larger tables bring about: keys that reach into each other, and files much smaller than their rows."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from corridora.plans.registry import ORACLES, QUERIES


def same_rows(spark, folder, name):
    con = duckdb.connect()
    con.sql("SET threads = 1")  # DISTINCT ON keeps the first row of the file
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    theirs, ours = con.sql(ORACLES[name]), QUERIES[name](spark, str(folder))
    order = [ours.columns.index(c) for c in theirs.columns]
    plain = lambda r: tuple(round(v, 3) if isinstance(v, float) else v for v in r)
    assert sorted(plain([r[i] for i in order]) for r in ours.collect()) == sorted(map(plain, theirs.fetchall()))


@pytest.fixture(scope="module")
def million_parts(tmp_path_factory):
    """Lines 1 and 2, and 3 and 4, of an order meet at one number: parts 1 000 000 and more."""
    folder = tmp_path_factory.mktemp("parts")
    rows = "(1, 1, 1000050), (1, 2, 50), (1, 2, 700), (2, 4, 9), (2, 3, 1000009), (2, 6, 300), (2, 1, 5), (3, 1, 8), (3, 1, 8)"
    duckdb.sql(f"COPY (SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::INTEGER AS l_linenumber, l_partkey::BIGINT AS l_partkey FROM (VALUES {rows}) t(l_orderkey, l_linenumber, l_partkey)) TO '{folder}/lineitem.parquet'")
    return folder


def test_arc_lengths_of_places_that_meet(spark, million_parts):
    same_rows(spark, million_parts, "arc_lengths")


def test_route_totals_of_places_that_meet(spark, million_parts):
    same_rows(spark, million_parts, "route_totals")


def test_lifted_routes_of_places_that_meet(spark, million_parts):
    same_rows(spark, million_parts, "lifted_routes")


PARTS = "/root/testdata/sf0.1"


def rows_of(spark, name, most="20m"):
    """Twenty thousand parts lie in a file of 180 kB: no side that grows with them is broadcast."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", most)
    try:
        return QUERIES[name](spark, PARTS).count()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_glyphs_meet_without_a_broadcast(spark):
    assert rows_of(spark, "glyph_words") == 8575


def test_boxes_of_words_without_a_broadcast(spark):
    assert rows_of(spark, "word_boxes") == 3507


def test_angles_of_words_without_a_broadcast(spark):
    assert rows_of(spark, "word_angles") == 3507


def test_planes_without_a_broadcast(spark):
    assert rows_of(spark, "derived_planes") == 20000
