"""Language ID, quality and the language model: held-out accuracy and defined results."""

import math
import re
import timeit
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corridora.llm import gru_lm, langid, quality, queries
from corridora.llm.shared import fold

from .fixtures import DOCS, documents, nothing, spaced

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_documents(spark):
    docs = documents(spark)
    filters = langid.learn(docs)
    got = docs.withColumn("p", langid.predictor(spark, filters, "text")).select("doc_id", "p.*").collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0
    assert by[0].lang == "en" and by[7].lang == "fr" and len(got) == len(DOCS)
    none = langid.learn(nothing(spark))
    assert {r.lang for r in docs.select(langid.predictor(spark, none, "text").alias("p")).select("p.lang").collect()} == {"und"}


def test_filters_return_every_language_of_an_ngram():
    grams = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    f = langid.Filters(["a", "b", "c"], [grams[:3000], grams[2000:], grams[:0]], "a")
    counts = f.corrected(f.hits(grams, np.zeros(len(grams), np.int64), 1), np.array([float(len(grams))]))[0]
    assert counts[0] == pytest.approx(3000, rel=0.01) and counts[1] == pytest.approx(len(grams) - 2000, rel=0.01) and counts[2] < 5


def test_quality_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op8_bradley_terry(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_of_awkward_documents(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (5, 0), (6, 0), (7, 1), (9, None), (99, 1)], "doc_id long, quality int")
    ranker = quality.learn(docs, labels)
    got = docs.select("doc_id", quality.scorer(spark, ranker, "text").alias("s")).collect()
    by = {r.doc_id: r.s for r in got}
    assert by[7] > by[5] and by[3] == by[4] and all(0 <= r.s <= 1 for r in got)
    unlearned = quality.learn(docs, labels.limit(0))
    assert {r[0] for r in docs.select(quality.scorer(spark, unlearned, "text")).collect()} == {0.5}
    assert quality.keep_best(docs, ranker, 0.5).columns == docs.columns


def test_quality_learns_from_every_labelled_row(spark):
    """Its scale, weights and threshold are those of all rows and all pairs of a good and a bad one."""
    n = 24_000
    said = F.concat_ws(" ", F.lit("Word"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "BUY!!").otherwise("is here."), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, (F.col("doc_id") % 40).cast("int")))
    docs = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("text", said)
    labels = docs.select("doc_id", (~(F.col("doc_id") % 300).isin(0, 7)).cast("int").alias("quality"))
    ranker = quality.learn(docs, labels)
    rows = docs.join(labels, "doc_id").orderBy("doc_id").toArrow()
    x, good = quality.features(rows["text"].combine_chunks()).astype(float), rows["quality"].to_numpy()
    each = [x[good == k] for k in (0, 1)]
    assert np.allclose(ranker.mean, (each[0].mean(0) + each[1].mean(0)) / 2, rtol=1e-6, atol=1e-9)
    bad, fine = (ranker.scaled(e) for e in each)
    lost = 1 / (1 + np.exp((fine @ ranker.weights)[:, None] - (bad @ ranker.weights)[None, :])) / (len(bad) * len(fine))
    gradient = lost.sum(0) @ bad - lost.sum(1) @ fine + 1e-3 * ranker.weights
    assert np.abs(gradient).max() < 2 * quality.CLOSE
    assert ranker.threshold == pytest.approx(np.quantile(ranker.strength(x.astype(np.float32)), len(bad) / n), abs=1e-12)


def test_words_are_looked_up_by_buckets():
    """As by plain search, also where words crowd in one bucket, and in less time than a binary search takes."""
    random = np.random.default_rng(3)
    for hashes in (random.integers(0, 2**64, 200_000, dtype=np.uint64), np.arange(1, 400, dtype=np.uint64) * np.uint64(3), np.array([5, 2**64 - 1], np.uint64)):
        hashes = np.unique(hashes)
        v = gru_lm.Vocabulary(hashes, *[np.zeros(0)] * 3, 0, 0, *[np.zeros(0)] * 3)
        words = np.r_[random.choice(hashes, 400_000), random.integers(0, 2**64, 100_000, dtype=np.uint64), hashes[-1] - np.uint64(1), np.uint64(0), np.uint64(2**64 - 1)]
        place = {h: i for i, h in enumerate(hashes.tolist())}
        assert v.look_up(words).tolist() == [place.get(w, -1) for w in words.tolist()]
        if len(hashes) > 100_000:
            took = {f: min(timeit.repeat(f, number=1, repeat=5)) for f in (lambda: v.look_up(words), lambda: np.searchsorted(hashes, words))}
            assert list(took.values())[0] < list(took.values())[1]


def test_softmax_scores_do_not_overflow():
    out = np.ones((3, 2), np.float32)
    s = gru_lm._scores(out, np.array([[300, 200], [1, 2]], np.float32))
    assert np.isfinite(np.exp(s)).all() and np.allclose(s, [[0, -497]] * 3)
    assert np.allclose(gru_lm._scores(out, np.array([[3, 2], [1, 2]], np.float32)), [[5, 3]] * 3)


def brute_base(rows, held):
    counts = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            counts.update([*spaced(text), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in [*spaced(x), "\n"]) for _, x in rows]
    known = [sum(counts[t] > 0 for t in [*spaced(x), "\n"]) for _, x in rows]
    return total, base, known


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "KNOWN_WORDS", 40)  # most words are joined
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    got = gru_lm.score(documents(spark), held_out=fold("doc_id", 10) == 0).collect()
    total, base, known = brute_base([(r[0], r[1]) for r in DOCS], held)
    want = sorted(((str(d), len(spaced(x)) + 1, k, round(b, 4)) for (d, x, *_), b, k in zip(DOCS, base, known, strict=True)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert len({round(r.score, 9) for r in got if r.doc_id in (0, 1)}) == 1
    assert gru_lm.score(nothing(spark), held_out=fold("doc_id", 10) == 0).count() == 0


def test_every_training_text_reaches_the_network(spark):
    """Counts do not tell the order of a text's words; the network's scores of another text do."""
    texts = {i: " ".join(f"w{(i * 7 + j * j) % 11}" for j in range(40)) for i in (1, 2, 3, 4)}

    def judged(rows):
        docs = spark.createDataFrame([*rows.items(), (9, "w1 w4 w9 w5 w3 w2")], "doc_id long, text string").coalesce(1)
        return next(r.score for r in gru_lm.score(docs, held_out=F.col("doc_id") == 9).collect() if r.doc_id == 9)

    before = judged(texts)
    for i, text in texts.items():
        assert judged(texts | {i: " ".join(sorted(text.split()))}) != before, i


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in queries.op2_gru_lm(spark, SF).collect() if r.held_out]
    gain = (sum(r.score for r in rows) - sum(r.base_score for r in rows)) / sum(r.n_tokens for r in rows)
    assert gain > 0.1  # log10 a token


def test_probabilities_sum_to_one():
    random = np.random.default_rng(0)
    hashes = np.r_[gru_lm.END, random.integers(1, 2**60, 300).astype(np.uint64)]
    v = gru_lm.vocabulary(hashes, random.integers(1, 90, 301), 20_000, 900)
    m = gru_lm.Model(v)
    end = int(v.symbol[v.look_up(np.array([gru_lm.END]))[0]])
    n = len(v.frequency)
    # every symbol in turn after the same beginning
    symbols = np.concatenate([[5, 9, s] for s in range(n)])
    p = gru_lm.run(m, symbols, np.arange(n + 1) * 3, end).reshape(n, 3)
    assert np.exp(p[:, 2]).sum() == pytest.approx(1, rel=1e-4)
    # and the state is carried over windows: a long text scores alike however it is cut into lanes
    text = random.integers(0, n, 200)
    alone = gru_lm.run(m, text, np.array([0, 200]), end)
    together = gru_lm.run(m, np.r_[text, random.integers(0, n, 5000)], np.r_[0, 200, np.arange(300, 5201, 100)], end)
    assert np.allclose(alone, together[:200], atol=1e-4)


def test_gradients():
    random = np.random.default_rng(1)
    v = gru_lm.vocabulary(np.r_[gru_lm.END, random.integers(1, 2**60, 60).astype(np.uint64)], random.integers(1, 90, 61), 4000, 100)
    m = gru_lm.Model(v)
    m.w = {k: x.astype(np.float64) for k, x in m.w.items()}
    inputs, targets = random.integers(0, 61, (5, 3)), random.integers(0, 61, (5, 3))
    begins = np.zeros((5, 3), bool)
    begins[0] = begins[3, 1] = True
    state = np.zeros((3, gru_lm.HIDDEN), np.float32)
    _, _, grads = m.window(state, inputs, targets, begins, True)
    for k, x in m.w.items():
        at = np.unravel_index(np.argmax(np.abs(grads[k])), x.shape)
        loss = []
        for step in (1e-2, -1e-2):
            x[at] += step
            loss.append(-m.window(state, inputs, targets, begins, False)[1].sum())
            x[at] -= step
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(grads[k][at], rel=0.02, abs=1e-3), k


def test_letters_and_blocks():
    column = pa.array(["Ab", None, "", "1", "é"])
    found = list(langid.ngrams(column))
    assert [bool(x) for x in found[0][3]] == [True, False, False, False, True]


M64 = 2**64 - 1


def plain_mix(x):
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & M64
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & M64
    return x ^ (x >> 33)


def plain_prediction(filters, text):
    """(language, score) of one text by plain loops over its n-grams and the filters' bits."""
    if text is None or not any(ch.isalpha() for ch in text):
        return "und", 0.0
    low = "".join((ch.lower() if len(ch.lower()) == 1 else ch) if ch.isalpha() else " " for ch in text)
    said = " " + " ".join(low.split(" ")).strip() + " "
    while "  " in said:
        said = said.replace("  ", " ")
    hits, total = [0] * len(filters.languages), 0
    for n in langid.SIZES:
        for i in range(len(said) - n + 1):
            value = 0
            for ch in said[i : i + n]:
                value = (value << 16 & M64) ^ (ord(ch) * 0x9E3779B1 & M64)
            h = plain_mix(value + n & M64)
            total += 1
            for k in range(len(hits)):
                slots = [(h >> (j * langid.SLOT_BITS)) & ((1 << langid.SLOT_BITS) - 1) for j in range(langid.HASHES)]
                hits[k] += all(int(filters.bits[k // 64][s]) >> (k % 64) & 1 for s in slots)
    counts = [max(0.0, (x - total * f) / (1 - f)) for x, f in zip(hits, filters.false_rate, strict=True)]
    most = max(counts)
    if most <= 0:
        return filters.prior, 0.0
    others = (sum(counts) - most) / max(1, len(counts) - 1)
    return filters.languages[counts.index(most)], min(1.0, max(0.0, (most - others) / max(total, 1)))


def test_language_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    filters = langid.learn(docs.where(fold("doc_id", 5) != 0))
    texts = [r.text for r in docs.orderBy("doc_id").collect()[::9]] + [r[1] for r in DOCS if r[0] != 8]
    for text, found in zip(texts, filters.predict(pa.array(texts)).to_pylist(), strict=True):
        lang, score = plain_prediction(filters, text)
        assert found["lang"] == lang and found["score"] == pytest.approx(score, abs=1e-9), text


def plain_features(text):
    """The features of one text by plain counting of its bytes, words and lines."""
    data = (text or "").encode()
    n = max(len(data), 1)
    kinds = [sum(1 for b in data if quality._CLASSES[b] == k) for k in range(8)]
    marks = [data.count(bytes([b])) for b in range(128)]
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    lines = re.findall(rb"[^\n\r]+", data)
    many, kind = max(len(words), 1), lambda b: int(quality._CLASSES[b])
    capital = sum(kind(w[0]) == 2 for w in words)
    shout = sum(kind(w[0]) == 2 and len(w) > 1 and kind(w[1]) == 2 for w in words)
    tail = sum(kind(w[-1]) == 7 for w in words)
    low = {bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words}
    extra = [math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / many / 10, len(low) / many, capital / many, shout / many, tail / many, math.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), len(lines) / many]
    return [*(math.sqrt(x / n) for x in marks), *(math.sqrt(x / n) for x in kinds), *extra]


def test_quality_features_and_scores_against_plain_counting(spark):
    texts = [r[1] for r in DOCS if r[0] != 8] + ["AB cd!\nAB cd!\r\nX\ty."]
    random = np.random.default_rng(4)
    ranker = quality.Ranker(random.normal(size=quality.N_FEATURES), random.uniform(0.5, 2, quality.N_FEATURES), random.normal(size=quality.N_FEATURES), 0.3, 0.7, True)
    for text in texts:
        x = quality.features(pa.array([text], pa.string()))
        want = np.array(plain_features(text))
        assert np.allclose(x[0], want, atol=1e-5), text
        strength = sum(max(-8, min(8, (a - m) / s)) * w for a, m, s, w in zip(want, ranker.mean, ranker.scale, ranker.weights, strict=True))
        away = 0.7 * (strength - 0.3) + math.log(0.7 / 0.3)
        assert ranker.score(x)[0] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, away)))), rel=1e-3)


def test_a_very_long_text_takes_one_lane(monkeypatch):
    """Windows hold each token once, and the arrays that they are cut from at most about twice."""
    monkeypatch.setattr(gru_lm, "BLOCK_TOKENS", 20_000)
    sizes = [90_000, 3, 500, 1, 40, 7, 7, 7, 7]
    first = np.r_[0, np.cumsum(sizes)]
    symbols = (np.arange(first[-1]) % 50).astype(np.int16)
    seen = []
    for inputs, targets, begins, places in gru_lm.lanes(symbols, first, 49):
        assert inputs.shape[1] <= 2 and places.base.size <= 2.2 * len(symbols)
        seen += places[places >= 0].tolist()
    assert sorted(seen) == list(range(len(symbols)))


def test_quality_scores_depend_on_no_other_row():
    texts = ["I like A", "bx yes", "Bx Yes I", "", None, "A", "B", "x" * 700_000 + " A", "Zz AB"] * 3 + [r[1] for r in DOCS]
    random = np.random.default_rng(8)
    ranker = quality.Ranker(random.normal(size=quality.N_FEATURES), random.uniform(0.5, 2, quality.N_FEATURES), random.normal(size=quality.N_FEATURES), 0.3, 0.7, True)
    alone = [ranker.score(quality.features(pa.array([t], pa.string())))[0] for t in texts]
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(texts))
        together = ranker.score(quality.features(pa.array([texts[i] for i in order], pa.string())))
        assert together.tolist() == [alone[i] for i in order]


def plain_log_probability(model, v, symbols, end):
    """Natural log probabilities of one text's symbols, token by token from the model's equations."""
    w = {k: x.astype(np.float64) for k, x in model.w.items()}
    h = gru_lm.HIDDEN
    state, before, out = np.zeros(h), end, []
    for s in symbols:
        a, g = w["input"][before] + w["gate"], state @ w["recur"]
        z, r = 1 / (1 + np.exp(-(a[:h] + g[:h]))), 1 / (1 + np.exp(-(a[h : 2 * h] + g[h : 2 * h])))
        state = state + z * (np.tanh(a[2 * h :] + r * g[2 * h :]) - state)
        place = model.place[s]
        k = model.of_class[place]
        lo, hi = v.bounds[k], v.bounds[k + 1]
        c = state @ w["to_class"] + w["class"]
        inner = state @ w["to_symbol"][lo:hi].T + w["symbol"][lo:hi]
        out.append(c[k] - np.log(np.exp(c).sum()) + inner[place - lo] - np.log(np.exp(inner).sum()))
        before = s
    return out


def test_scores_against_the_equations(spark):
    docs = documents(spark).select("doc_id", "text").coalesce(1)
    held_out = fold("doc_id", 10) == 0
    got = gru_lm.score(docs, held_out=held_out).collect()
    texts = docs.where(~held_out).select("text")
    v, counts = gru_lm.learn_vocabulary(texts)
    model = gru_lm.Model(v).load(gru_lm.train(texts, v))
    end = int(v.symbol[v.look_up(np.array([gru_lm.END]))[0]])
    for doc_id, text in [(r[0], r[1]) for r in DOCS if r[0] in (0, 2, 4, 6, 9, 8)]:
        hashes = np.concatenate([x[1] for x in gru_lm._tokens(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["t"])]), 0)])
        at = v.look_up(hashes)
        model_sum = sum(plain_log_probability(model, v, v.symbols(at).tolist(), end)) / math.log(10)
        share = sum(v.log_share[i] if i >= 0 else math.log10(gru_lm.SMOOTH / v.other_mass()) for i in at)
        mine = next(r for r in got if r.doc_id == doc_id)
        assert mine.score == pytest.approx(model_sum + share, rel=2e-3, abs=1e-2), doc_id


def test_words_of_a_language_share_a_group():
    random = np.random.default_rng(2)
    company = np.zeros((400, gru_lm.COMPANY))
    for i in range(400):  # two languages, each with its own frequent words
        company[i, random.integers(0, 8, 30) + 8 * (i % 2)] += 1
    group = gru_lm.clusters(company, np.arange(400, 0, -1))
    assert not set(group[::2]) & set(group[1::2])
