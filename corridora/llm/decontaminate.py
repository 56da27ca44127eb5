"""Benchmark decontamination: broadcast hash sets of test n-grams, training windows scanned in numpy.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window of its length.
Every document word inside any occurrence of a window is hit. Hits found by hash are verified
against the window's words.

A test set of at most ``BLOCK_WORDS`` words is broadcast whole, and no document is shuffled. A larger one
takes a pass over the documents for each block of so many words: a pass holds one block only, writes the
results of the texts that are hit, by the texts' digests, and gives its broadcast up; the results of all
passes are then joined to the documents by digest, and spans of one text united.

Defined results: null or empty texts have no words and no hits; items without words have no
windows; repeated items each count once by their id; a null item id hits words but is not listed;
repeated documents keep a result each; very long documents are scanned whole; other columns pass
through untouched in :func:`remove_documents` and :func:`remove_spans`.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as kernels
from .shared import ascii_lower, free_name, materialize, release

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of test items in one broadcast block: about 64 MB of driver memory at most.
BLOCK_WORDS = 1_000_000
_BITS = 20

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.LongType()))])
_RESULT_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])


class Windows:
    """The windows of some items: sorted hashes, a bit filter before them, and the words to verify."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        found: dict[bytes, set[str]] = {}
        lengths: dict[bytes, int] = {}
        for item_id, words in items:
            size = min(n, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                key = "\n".join(words[at : at + size]).encode()
                found.setdefault(key, set()).update([] if item_id is None else [str(item_id)])
                lengths[key] = size
        self.by_length: dict[int, tuple] = {}
        for size in sorted(set(lengths.values())):
            keys = [k for k in found if lengths[k] == size]
            data = np.frombuffer(b"\n".join(keys), dtype=np.uint8)
            ends = np.cumsum([len(k) + 1 for k in keys])
            words, first = kernels.word_hashes(data, np.r_[0, ends[:-1], len(data)], kernels.ALNUM)
            hashes, _ = kernels.windows(words, first, size)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[hashes & np.uint64((1 << _BITS) - 1)] = True
            self.by_length[size] = (hashes[order], bits, [keys[i] for i in order], [sorted(found[keys[i]]) for i in order])


def _scan(column: pa.Array, windows: Windows) -> pa.Array:
    """For each text: words, hit words, items, and hit byte spans (start, end, ...)."""
    raw, offsets = kernels.string_bytes(column)
    data = kernels.LOWER[raw]
    n_words, n_hit, items, spans = [], [], [], []
    for a, z in kernels.blocks(offsets):
        part, at = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        words, first = kernels.word_hashes(part, at, kernels.ALNUM)
        hit = np.zeros(len(words) + 1, dtype=np.int32)
        names: dict[int, set[str]] = {}
        borders = None
        for size, (hashes, bits, keys, owners) in windows.by_length.items():
            value, where = kernels.windows(words, first, size)
            maybe = np.flatnonzero(bits[value & np.uint64((1 << _BITS) - 1)])
            value, where = value[maybe], where[maybe]
            place = np.searchsorted(hashes, value)
            ok = np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == value)
            if len(ok) and borders is None:
                borders = kernels.word_spans(part, at, kernels.ALNUM)
            for w, p in zip(where[ok].tolist(), place[ok].tolist(), strict=True):
                said = b"\n".join(part[borders[0][w + j] : borders[1][w + j]].tobytes() for j in range(size))
                while p < len(hashes) and keys[p] != said and p + 1 < len(hashes) and hashes[p + 1] == hashes[p]:
                    p += 1
                if keys[p] == said:
                    hit[w] += 1
                    hit[w + size] -= 1
                    names.setdefault(int(np.searchsorted(first, w, side="right")) - 1, set()).update(owners[p])
        covered = np.cumsum(hit[:-1]) > 0
        sums = np.r_[0, np.cumsum(covered)]
        n_words.append(np.diff(first))
        n_hit.append(sums[first[1:]] - sums[first[:-1]])
        for d in range(z - a):
            items.append(sorted(names[d]) if d in names else [])
            if n_hit[-1][d]:
                inside = np.flatnonzero(covered[first[d] : first[d + 1]]) + first[d]
                cut = np.flatnonzero(np.diff(inside) > 1)
                lo, hi = inside[np.r_[0, cut + 1]], inside[np.r_[cut, len(inside) - 1]]
                spans.append((np.stack([borders[0][lo], borders[1][hi]], axis=1).reshape(-1) - at[d]).tolist())
            else:
                spans.append([])
    join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
    return pa.StructArray.from_arrays([join(n_words), join(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], fields=list(_RESULT_ARROW))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Items as words, streamed to the driver in blocks of bounded size."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    held, size = [], 0
    for item_id, found in benchmark.select(F.col(id_col).cast("string"), words).toLocalIterator():
        # a long item is dealt out in overlapping pieces, which have the same windows
        step = BLOCK_WORDS // 2
        for at in range(0, max(1, len(found) - n + 1), step):
            piece = found[at : at + step + n - 1]
            if held and size + len(piece) > BLOCK_WORDS:
                yield held
                held, size = [], 0
            held.append((item_id, piece))
            size += len(piece)
    yield held


def _finder(shared):
    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        found = _scan(texts, shared.value)
        kernels.give_back()
        return found

    return find


@F.arrow_udf(RESULT)
def _merge(texts: pa.Array, found: pa.Array) -> pa.Array:
    """The results of several blocks of items as one: united spans, words counted again (null: no hits)."""
    rows = _scan(texts, Windows([], 1)).to_pylist()
    for at, results in enumerate(found.to_pylist()):
        if not results:
            continue
        data = kernels.LOWER[np.frombuffer(texts[at].as_py().encode(), dtype=np.uint8)]
        starts, _, _ = kernels.word_spans(data, np.array([0, len(data)]), kernels.ALNUM)
        borders = sorted((r["spans"][i], r["spans"][i + 1]) for r in results for i in range(0, len(r["spans"]), 2))
        joined: list[list[int]] = []
        for lo, hi in borders:
            if joined and np.searchsorted(starts, lo) <= np.searchsorted(starts, joined[-1][1]):
                joined[-1][1] = max(joined[-1][1], hi)
            else:
                joined.append([lo, hi])
        hits = sum(int(np.searchsorted(starts, hi) - np.searchsorted(starts, lo)) for lo, hi in joined)
        rows[at] |= {"n_hit": hits, "item_ids": sorted({i for r in results for i in r["item_ids"]}), "spans": [b for pair in joined for b in pair]}
    return pa.array(rows, type=_RESULT_ARROW)


def _passes(docs: DataFrame, text: Column, blocks: Iterator[list], n: int) -> DataFrame:
    """(name, results): the results of every block for the texts that it hits, by the texts' digests."""
    hits = []
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(Windows(block, n))
        found = docs.select(F.unhex(F.sha2(text, 256)).alias("name"), _finder(shared)(text).alias("found"))
        hits.append(materialize(found.where("found.n_hit > 0").dropDuplicates(["name"]), "hits"))
        shared.destroy()
    # one result of a text for each block
    out = materialize(functools.reduce(DataFrame.union, hits).groupBy("name").agg(F.collect_list("found").alias("results")), "results")
    release(*hits)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, result: str = "found") -> DataFrame:
    """``docs`` with a struct column ``result``: n_words, n_hit, item_ids, spans (UTF-8 byte borders of hit words)."""
    text = F.col(text_col).cast("string")
    blocks = _blocks(benchmark, item_id, item_text, n)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.withColumn(result, _finder(docs.sparkSession.sparkContext.broadcast(Windows(first, n)))(text))
    found = _passes(docs, text, itertools.chain([first, second], blocks), n)
    name, results = free_name(docs, "name"), free_name(docs, "results")
    both = docs.withColumn(name, F.unhex(F.sha2(text, 256))).join(found.select(F.col("name").alias(name), F.col("results").alias(results)), name, "left")
    return both.withColumn(result, _merge(text, F.col(results))).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != result.lower()], result)


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without documents that hold a window of a test item."""
    return scan(docs, benchmark, result="__found", **options).where("__found.n_hit = 0").drop("__found")


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, borders in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if not borders:
            out.append(text)
            continue
        data, at, kept = text.encode(), 0, []
        for lo, hi in zip(borders[::2], borders[1::2], strict=True):
            kept.append(data[at:lo].decode())
            at = hi
        kept.append(data[at:].decode())
        out.append(re.sub(r" {2,}", " ", " ".join(kept)).strip(" "))
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words cut out of their texts; clean texts stay as they are."""
    found = scan(docs, benchmark, text_col=text_col, result="__found", **options)
    return found.withColumn(text_col, F.when(F.col("__found.n_hit") > 0, _cut(F.col(text_col), F.col("__found.spans"))).otherwise(F.col(text_col))).drop("__found")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, n=n)
    ids = F.array_join("found.item_ids", ",")
    return found.select("doc_id", F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"), F.size("found.item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


