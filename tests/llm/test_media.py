import hashlib
import os
import zlib

import pytest

from corridora.llm import media

from .fixtures import DOCS, documents, nothing


def test_features(spark, tmp_path):
    rows = media.media_features(documents(spark), f"file://{tmp_path}/a").collect()
    want = []
    for doc_id, text, *_ in DOCS:
        raw = (text or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=str)
    same = [r[1:] for r in rows if r.doc_id in (0, 1)]
    assert same[0] == same[1]


def test_ranges_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    media.write_archive(documents(spark).coalesce(1), path)
    whole = media.read_archive(spark, path).count()
    assert media.read_archive(spark, path, range_bytes=97).count() == whole == len(DOCS)
    file = next(f for f in os.listdir(tmp_path / "b") if f.endswith(".archive"))
    at = media.read_archive(spark, path).orderBy("offset").collect()
    with open(tmp_path / "b" / file, "r+b") as f:  # one damaged member is reported, the others are read
        f.seek(at[0].offset + 60)
        f.write(b"\xff\x00\xff")
    found = media.read_archive(spark, path).collect()
    assert sum(r.error is not None for r in found) == 1
    assert {r.offset for r in found if r.error is None} == {r.offset for r in at[1:]}


def test_empty(spark, tmp_path):
    assert media.media_features(nothing(spark), f"file://{tmp_path}/c").count() == 0


@pytest.mark.parametrize("data", [bytes(64), bytes(range(256)), b"x" * 6400])
def test_png_round_trip(data):
    assert media.decode_png(media.encode_png(data)).tobytes() == data


def test_reads_are_retried_with_pauses(monkeypatch):
    monkeypatch.setattr(media, "PAUSE", 0.001)
    turns, opened = [], []

    def read():
        turns.append(1)
        if len(turns) < 3:
            raise OSError("gone")
        return "here"

    assert media._patiently(read, lambda: opened.append(1)) == ("here", None) and len(opened) == 2
    found, problem = media._patiently(lambda: 1 / 0 if False else (_ for _ in ()).throw(ValueError("bad")), lambda: None)
    assert found is None and str(problem) == "bad"


def test_the_archive_of_a_query_is_deleted(spark):
    before = set(os.listdir(media.shared_folder(spark).removeprefix("file://")))
    assert media.media_features(documents(spark)).count() == len(DOCS)
    after = set(os.listdir(media.shared_folder(spark).removeprefix("file://"))) - before
    assert not any("media" in name for name in after)
