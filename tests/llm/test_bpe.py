"""BPE by chunks against the library on whole texts."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corridora.llm import bpe, queries
from corridora.llm.text import string_bytes

from .fixtures import DOCS, documents, nothing

PATH = public_tokenizers.path("word_bpe_49k.json")
FILES = {name: public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}
OWN = {name: bpe.Chunked(path, cut_bits=4, kept_words=500, kept_bytes=5_000) for name, path in FILES.items()}
LIBRARY = {name: Tokenizer.from_file(path) for name, path in FILES.items()}
AWKWARD = [
    "", " ", "a", "\n\n  x", "x  \n", "Hello  World's <|endoftext|>x<|startoftext|> it'll", "İ ß Σς 你好 \x00  a b ́ é ﬁ", "é ́a é", "́ ̈x",
    "x" * 3000, "ab1 " * 700, "你好" * 900, " ".join(str(i) for i in range(3000)), "\t\v\f\r\n a\r\nb", "<|endoftext|>" * 30, "A'S 'Ll don'T", "🙂👍🏽 ok 👩‍👩‍👧",
]


def by_chunks(own, texts):
    data, offsets = string_bytes(pa.array(texts, pa.string()))
    ids, at = own.encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])], own.decode(ids, at).to_pylist()


def check(name, texts):
    ids, decoded = by_chunks(OWN[name], texts)
    whole = [LIBRARY[name].encode(t, add_special_tokens=False).ids for t in texts]
    assert ids == whole
    assert decoded == [LIBRARY[name].decode(i, skip_special_tokens=False) for i in whole]


@pytest.mark.parametrize("name", sorted(FILES))
def test_awkward_texts(name):
    check(name, AWKWARD)
    check(name, AWKWARD[::-1] + AWKWARD)
    for text in AWKWARD:
        check(name, [text])


@pytest.mark.parametrize("name", sorted(FILES))
def test_any_texts(name):
    pieces = st.sampled_from(["the ", "quick", " brown\n", "fox's", "'ll", "  ", "́", "e", "é", "<|endoftext|>", "<|", "12", "…", "你", " ", "A", "\t", "...", "İ"])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.lists(pieces, max_size=60).map("".join), st.text(max_size=40)), min_size=1, max_size=6))
    def run(texts):
        check(name, texts)

    run()


def test_shared_passages_are_encoded_once():
    own = bpe.Chunked(PATH)
    random = np.random.default_rng(3)
    words = ["".join(map(chr, random.integers(97, 123, random.integers(3, 9)))) for _ in range(8000)]
    passage = " ".join(words[:2000])
    texts = [" ".join(words[2000 + 500 * i : 2500 + 500 * i]) + " " + passage for i in range(10)]
    ids, _ = by_chunks(own, texts)
    assert ids == [e.ids for e in LIBRARY["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False)]
    assert own.encoded < 1.05 * len(" ".join(words[:7000])) < 0.4 * sum(map(len, texts))
    # cuts depend on content, not on the place: nearly all of the passage's chunks are known in a new text
    chunks = len(own.chunks)
    by_chunks(own, ["something else " + passage])
    assert len(own.chunks) <= chunks + 2


def test_a_very_long_text_by_segments(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 1000)
    check("word_bpe_49k.json", ["", " ".join(f"w{i % 977}x{i % 13}" for i in range(3000)), "x" * 2500 + " y", "tail  "])


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    check("word_bpe_49k.json", ["one two six ten", "ten six two one and one more"])


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    import json

    told = json.load(open(PATH, encoding="utf-8"))
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "Prepend", "prepend": "_"}}, {"added_tokens": [told["added_tokens"][0] | {"lstrip": True}]}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(told | change))
        with pytest.raises(ValueError):
            bpe.Chunked(str(path))


def test_awkward_documents(spark):
    docs = documents(spark).withColumn("ids", F.lit(1)).withColumn("__text_", F.lit("y")).repartition(3)
    got = bpe.encode(docs, PATH, decode=True)
    assert sorted(got.columns) == sorted({*docs.columns, "ids", "n_tokens", "decoded"})
    library, rows = LIBRARY["word_bpe_49k.json"], got.collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    again = {(r.doc_id, r.decoded) for r in bpe.decode(got.drop("decoded"), PATH).collect()}
    assert again == {(r.doc_id, r.decoded) for r in rows}
    assert bpe.encode(nothing(spark), PATH, decode=True).collect() == []


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = LIBRARY["word_bpe_49k.json"]
    got = queries.op12_bpe_chunks(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
