import hashlib
import re

from corridora.llm import decontaminate

from .fixtures import DOCS, documents, nothing

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [(1, "quick brown fox jumps over the lazy dog and runs away"), (2, "Brown, fox; JUMPS"), (2, "brown fox jumps"), (3, None), (4, "!!"), (5, "des lignes"), (None, "caractères étranges"), (6, "no such passage is in any of these texts at all ever")]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, said in items:
            v = words(said)
            k = min(n, len(v))
            for i in range(len(v) - k + 1 if k else 0):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == v[i : i + k]:
                        hit.update(range(j, j + k))
                        ids |= {str(item_id)} if item_id is not None else set()
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_brute_force(spark):
    got = sorted((tuple(r) for r in decontaminate.report(documents(spark), items(spark)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in DOCS], ITEMS)


def test_blocks_of_items_agree(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 24)
    got = sorted((tuple(r) for r in decontaminate.report(documents(spark), items(spark)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in DOCS], ITEMS)


def test_ten_blocks_hold_one_broadcast_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 24)
    words = [f"word{i}" for i in range(240)]
    more = spark.createDataFrame([(100 + i, " ".join(words[24 * i : 24 * i + 24])) for i in range(10)], "item_id long, text string")
    docs = documents(spark).unionByName(spark.createDataFrame([(50, "some " + " ".join(words[20:40]) + " more"), (51, " ".join(words))] * 2, "doc_id long, text string"), allowMissingColumns=True)
    live, most, passes = set(), 0, 0
    real = type(spark.sparkContext).broadcast

    def counted(context, value):
        nonlocal most, passes
        shared = real(context, value)
        live.add(id(value))
        passes, most = passes + 1, max(most, len(live))
        destroy = shared.destroy
        shared.destroy = lambda *a: (live.discard(id(value)), destroy(*a))
        return shared

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    both = items(spark).unionByName(more)
    found = decontaminate.scan(docs, both)
    assert passes >= 10 and most == 1 and set(found.columns) == set(docs.columns)
    got = sorted((tuple(r) for r in decontaminate.report(docs, both).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in both.collect()])


def test_empty_tables(spark):
    assert decontaminate.report(nothing(spark), items(spark)).count() == 0
    none = decontaminate.report(documents(spark), items(spark).limit(0)).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated for r in none)


def test_removal(spark):
    docs = documents(spark)
    clean = decontaminate.remove_documents(docs, items(spark))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {3, 4, 5, 6, 7, 8, None}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items(spark)).collect()}
    assert cut[0] == "the from the big bad wolf today" and cut[6] == "word" and cut[3] is None
