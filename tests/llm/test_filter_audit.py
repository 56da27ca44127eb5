"""The filter audit against plain loops over documents and orders."""

import itertools
import os

import duckdb
import numpy as np
import pytest

from corridora.llm import filter_audit, queries
from corridora.llm.text import SPACED, word_spans

from .fixtures import documents, nothing, spaced

LABELS = "doc_id long, quality int, toxic int, part string"


def plain(docs, labels):
    import re

    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = i is not None and i > least[text]
        mine = [(q, t) for j, q, t in labels if j == i and i is not None]
        rows.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                removed = [r for r in left if letter in r[1]]
                failing = [r for r in rows if r[0] == part and letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                out[part, order, step] = (len(left), len(removed), len(failing) - len(removed), sum(r[1] == {letter} for r in failing), sum(r[2] for r in removed), sum(r[3] for r in removed))
                total[part, letter] = total.get((part, letter), 0) + len(removed)
    return sorted((*key, *value, total[key[0], key[1][key[2] - 1]]) for key, value in out.items())


def ours(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in df.collect())


def test_awkward_documents(spark):
    docs = documents(spark).withColumnRenamed("size", "quality").withColumnRenamed("label", "id").withColumnRenamed("found", "mask")
    long = [(20, "Word " * 300, "en"), (19, "Word " * 300, "fr"), (19, "Word " * 300, "en"), (None, "Word " * 300, "en"), (21, " ".join(f"w{i}" for i in range(250)), ""), (22, "A#" * 100_000, None)]
    long += [(30 + i, "the same words again & again", "en") for i in range(50)]
    more = spark.createDataFrame(long, "doc_id long, text string, lang string")
    docs = docs.unionByName(more, allowMissingColumns=True).repartition(3)
    labels = [(0, 1, 0), (1, 1, None), (20, 0, 1), (20, 1, 0), (19, None, 1), (None, 1, 1), (40, 1, 1), (99, 1, 1)]
    got = ours(filter_audit.audit(docs, spark.createDataFrame([(*r, "x") for r in labels], LABELS)))
    assert got == plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels)


def test_no_documents_or_labels(spark):
    empty = spark.createDataFrame([], LABELS)
    assert ours(filter_audit.audit(nothing(spark), empty)) == []
    docs = documents(spark)
    assert ours(filter_audit.audit(docs, empty)) == plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], [])


@pytest.mark.parametrize("bits", [0, 2, 64])
def test_words_of_one_hash_are_told_apart(bits):
    texts = ["a b a c", "", "b b b", " ".join(f"w{i % 37} x" for i in range(500)), "é e é xy yx" + " longest" * 3]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, first = word_spans(data, offsets, SPACED)
    hashes = None if bits == 64 else np.arange(len(starts), dtype=np.uint64) * 0 + (data[starts] % (1 << bits)).astype(np.uint64)
    assert filter_audit.distinct_words(data, starts, ends, first, hashes).tolist() == [len(set(t.split())) for t in texts]
    assert spaced("A b") == ["a", "b"]


def test_query_gives_the_rows_of_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf, name)}.parquet'")
    theirs = con.sql(queries.ORACLES["op13_filter_audit"])
    got = queries.op13_filter_audit(spark, sf)
    assert got.columns == theirs.columns and sorted(tuple(r) for r in got.collect()) == sorted(theirs.fetchall())
    assert got.count() == 4 * 120 * 5
