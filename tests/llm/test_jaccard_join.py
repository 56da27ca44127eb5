import itertools
import random

from corridora.llm.jaccard_join import jaccard_join, one_of_each, shingle_links

from .fixtures import DOCS, documents, nothing, spaced


def brute(rows, per_cent=75, k=5):
    sets = []
    for _, text in rows:
        w = spaced(text)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted((tuple(r) for r in jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_awkward_documents(spark):
    assert result(documents(spark)) == brute([(r[0], r[1]) for r in DOCS])


def test_empty_table(spark):
    assert result(nothing(spark)) == []


def test_families_against_brute_force(spark):
    """Near copies around the threshold, chains, and a passage that unlike texts share."""
    rng = random.Random(5)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for family in range(8):
        base = [f"f{family}w{i}" for i in range(rng.choice([12, 60, 150]))]
        chain = list(base)
        for _ in range(14):
            copy = list(base if rng.random() < 0.6 else chain)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            chain = copy
            rows.append(copy)
    for i in range(30):
        rows.append([f"u{i}x{j}" for j in range(rng.randrange(20, 200))] + passage)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == brute(rows)


def test_bound_of_long_sets(spark):
    """Two sets of 300,000 shingles that share 200,000 and do not link pass the matrix bound in 64 bits."""
    rows = [(i, 300_000, float(i), 120_000, low) for i, low in ((1, 0), (2, 100_000))]
    sets = spark.createDataFrame(rows, "set_id long, n_shingles int, central double, prefix int, low long").selectExpr("set_id", "n_shingles", "central", "prefix", "sequence(low, low + 299999) as tokens")
    links, labels = shingle_links(sets)
    assert links.count() == 0 and {tuple(r) for r in labels.select("id", "component").collect()} == {(1, 1), (2, 2)}


def test_one_row_of_each(spark):
    """Rows, not ids, are selected: repeated and null ids, near copies across them, repeated rows."""
    base = [f"b{i}" for i in range(80)]
    near = lambda k: " ".join([*base[:-1], f"z{k}"])
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(5, near(1)), (5, other), (3, near(2)), (None, near(3)), (None, near(4)), (None, "a text of its own without an id"), (9, other), (9, other), (4, ""), (4, ""), (None, None)]
    got = sorted(map(tuple, one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == sorted([(3, near(2)), (5, other), (None, "a text of its own without an id"), (4, ""), (4, ""), (None, None)], key=str)


def test_many_short_texts_in_one_block(spark):
    """More distinct sets in one batch than 16-bit numbers hold."""
    docs = spark.range(70_000).selectExpr("id as doc_id", "concat('x', id % 69000) as text").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        got = jaccard_join(docs)
        assert got.select("component_id").distinct().count() == 69_000 and got.where("component_id != doc_id").count() == 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_shingle_of_all_documents_is_a_few_bytes_a_block(monkeypatch):
    """What one task compares of a hot shingle grows with the blocks, not with the documents."""
    import numpy as np
    import pyarrow as pa

    from corridora.llm import jaccard_join as jj
    from corridora.llm import text as kernels

    class Task:
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: Task))
    monkeypatch.setattr(jj, "FLUSH_ROWS", 500)
    line = "all of these documents say this"
    texts = [f"{line} {' '.join(f'w{i}x{j}' for j in range(i % 7 + 3))}" for i in range(6000)] + [line] * 100
    rows = pa.table({"id": range(len(texts)), "text": texts, "said": range(len(texts))}).to_batches(max_chunksize=500)
    packed = list(jj._packer(5, 1)(iter(rows)))
    kinds = [(n, t, o, w) for b in packed for n, t, o, w in zip(*(b.column(i).to_pylist() for i in (2, 4, 5, 6)))]
    moved = [kernels.expand(t, np.uint32 if n == -4 else np.uint64) for n, t, _, _ in kinds if n in (-4, -8)]
    counted = [kernels.expand(w, np.uint32) for n, _, _, w in kinds if n == jj._COUNTED]
    blocks = sum(n >= 0 for n, *_ in kinds)
    assert 12 <= blocks <= 14 and len(counted) >= blocks - 1 and all(len(c) < 10 for c in counted) and max(int(c.max()) for c in counted) > 400
    assert all(len(np.unique(np.cumsum(m, dtype=np.uint64))) > len(m) / (jj.HOME_SETS - 1) for m in moved)
    back = list(jj._share(iter(packed)))
    sets = [r for b in jj._gatherer(75)(iter(back)) for r in b.to_pylist()]
    want = {}
    for t in texts:
        for g in {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}:
            want.setdefault(g, set()).add(t)
    assert len(sets) == len(texts)
    for r in sets:
        grams = {tuple(texts[r["doc_id"]].split()[k : k + 5]) for k in range(len(texts[r["doc_id"]].split()) - 4)}
        assert r["n_shingles"] == len(grams)
        if r["tokens"]:
            assert len(r["tokens"]) == sum(len(want[g]) > 1 for g in grams) and len(set(r["tokens"])) == len(r["tokens"])
