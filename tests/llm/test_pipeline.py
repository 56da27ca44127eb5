import corpus_pipeline
from corridora.llm import decontaminate, langid, mixing
from corridora.llm.shared import fold

from .fixtures import documents, nothing
from .test_decontaminate import ITEMS
from .test_jaccard_join import brute


def test_stages(spark, tmp_path):
    spark.createDataFrame([i for i in ITEMS if i[0] == 1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark)
    language = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert language.columns == docs.columns and {r.doc_id for r in language.collect()} == {0, 1, 2, 6, 7, 8, 9, None}
    near = corpus_pipeline.near_duplicates(spark, language, str(tmp_path))
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted(map(str, [0, 6, 7, 8, 9, None]))
    clean = corpus_pipeline.decontamination(spark, near, str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == {6, 7, 8, 9, None}
    mixed = corpus_pipeline.mixture(spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns
    assert corpus_pipeline.shards(spark, mixed, str(tmp_path)).count() == mixed.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing(spark), str(tmp_path)).count() == 0


def test_run_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    filters = langid.learn(docs.where(fold("doc_id", 5) != 0))
    kept = docs.withColumn("p", langid.predictor(spark, filters, "text")).where("p.lang != 'und' and p.score > 0").drop("p").collect()
    first = {d for d, _, c in brute([(r.doc_id, r.text) for r in kept]) if d == c}
    clean = {r.doc_id for r in decontaminate.report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("not contaminated").collect()}
    mixed = mixing.mix(docs.where(docs.doc_id.isin(list(first & clean)))).collect()
    assert got == {r.doc_id: r.copies for r in mixed if r.copies}


def test_run_over_awkward_documents(spark, tmp_path):
    """Nulls, repeats, clashing names and a very long text through all stages."""
    spark.createDataFrame([i for i in ITEMS if i[0] == 1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"stairs and halls number {i} lead to the rooms" for i in range(60_000))
    more = spark.createDataFrame([(70, long, "en", "a"), (71, long + " once more", "en", "a")], "doc_id long, text string, lang string, source string")
    docs = documents(spark).unionByName(more, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 71 is a near copy of 70; no document is taken more than twice
    kept = [r.doc_id for r in rows]
    assert set(kept) <= {6, 7, 8, 9, 70, None} and 70 in kept and all(kept.count(x) <= 2 for x in kept)
    assert {r.doc_id: r["size"] for r in rows if r.doc_id == 70} == {70: len(long.encode()) + 1}
