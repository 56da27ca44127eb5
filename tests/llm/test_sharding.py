import zlib

from pyspark.sql import functions as F

from corridora.llm import sharding

from .fixtures import DOCS, documents, nothing


def test_rows_law(spark):
    for n in (0, 1, 2, 3, 16, 17, 250, 1000):
        rows = sharding.shard(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).collect()
        assert len(rows) == n and len({r.doc_id for r in rows}) == n
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by.get(s, [])) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1


def test_permutation_is_a_bijection(spark):
    for n in (1, 5, 97, 1024, 3001):
        places = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), F.lit(n).cast("long"))).collect()]
        assert sorted(places) == list(range(n))
    far = spark.range(10**12, 10**12 + 500).select(sharding.permute(F.col("id"), F.lit(3 * 10**12).cast("long")).alias("p"))
    assert far.distinct().count() == 500 and far.where("p < 0 or p >= 3000000000000").count() == 0


def test_awkward_documents(spark):
    rows = sharding.shard(documents(spark)).collect()
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in DOCS), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == want
    assert sorted(r.shard * 100 + r.slot for r in rows) == [s * 100 for s in range(len(DOCS))]
    again = sharding.shard(documents(spark).repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.shard, r.slot)
    assert sorted(map(key, again)) == sorted(map(key, rows))
    assert sharding.shard(nothing(spark)).count() == 0


def test_long_texts_and_many_repeats(spark):
    rows = [(1, "x" * 3_000_000), (2, None)] + [(3, "same")] * 500
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 502 and next(r["size"] for r in got if r.doc_id == 1) == 3_000_001
    assert sorted(r.slot * 16 + r.shard for r in got) == list(range(502))
