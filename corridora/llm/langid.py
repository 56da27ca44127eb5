"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of bit masks serves all languages: bit l of a slot belongs to language l's filter, so the
k slots of an n-gram, combined by AND, give at once all languages that contain it. A text's n-grams
are looked up in numpy; the popcount of each language's bit, corrected for that filter's rate of
false positives, decides.

Learning: a bounded sample of labelled texts (about ``SAMPLE_PER_LANGUAGE`` a language, chosen by a
hash of the id) is counted in Spark; an n-gram enters a language's filter if it is frequent there and
not ``RATIO`` times rarer than in another language. Prediction reads whole texts, nothing else.

Defined results: ``und`` with score 0 for a null text or one without a letter; a text with letters
but no known n-gram gets the most frequent language with score 0; ties go to the first language in
code-point order; repeated rows get equal results; without labelled rows everything is ``und``;
other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import text as kernels
from .shared import materialize, release

#: Labelled texts learned from, for each language, at most about so many.
SAMPLE_PER_LANGUAGE = 2_000
#: n-grams kept from one language's sample, at most (the most frequent).
FILTER_NGRAMS = 60_000
SIZES = (2, 3, 4)
HASHES, SLOT_BITS = 3, 21
#: Occurrences in a language's sample; and an n-gram may be so many times rarer than in another.
LEAST, RATIO = 3, 8.0
UNDETERMINED = "und"
#: Characters whose n-grams are hashed at once; a long text takes several stretches.
STRETCH = 256 << 10
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_ngrams", T.LongType())])


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower-case code point."""
    points = range(0x110000)
    letter = np.fromiter((chr(i).isalpha() for i in points), dtype=bool, count=0x110000)
    lower = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in points), dtype=np.uint32, count=0x110000)
    return letter, lower


def _hashed(points: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram hashes, owners) of normalised code points, a size and a stretch of them at a time."""
    for n in SIZES:
        for at in range(0, max(0, len(points) - n + 1), STRETCH):
            run, own = points[at : at + STRETCH + n - 1].astype(np.uint64), owner[at : at + STRETCH + n - 1]
            m = len(run) - n + 1
            value = np.zeros(m, dtype=np.uint64)
            for j in range(n):
                value = (value << np.uint64(16)) ^ (run[j : j + m] * np.uint64(0x9E3779B1))
            # the last character may be the space that opens the next text: it closes this one
            inside = own[:m] == own[n - 2 : n - 2 + m]
            inside &= (own[:m] == own[n - 1 : n - 1 + m]) | (run[n - 1 : n - 1 + m] == 32)
            yield kernels.mix(value[inside] + np.uint64(n)), own[:m][inside]


def ngrams(column: pa.Array, limit: int = 256 << 10) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """Blocks of whole texts: (from, to, stretches of n-gram hashes with their text's number in the block, has a letter).

    Texts are lower-cased, each run of other characters than letters becomes one space, and a space
    is put before and after.
    """
    letter, lower = _classes()
    data, offsets = kernels.string_bytes(column)
    for a, z in kernels.blocks(offsets, limit):
        part = data[offsets[a] : offsets[z]]
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        heads = np.zeros(len(part) + 1, dtype=np.int32 if len(part) < 2**31 else np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=heads[1:])
        at = heads[offsets[a : z + 1] - offsets[a]]
        owner = np.repeat(np.arange(z - a, dtype=np.int32), np.diff(at))
        is_letter = letter[points]
        has = np.bincount(owner[is_letter], minlength=z - a) > 0
        # one space before each text, then letters, with single spaces where others were
        points = np.insert(np.where(is_letter, lower[points], np.uint32(32)), at[:-1], 32)
        owner = np.insert(owner, at[:-1], np.arange(z - a, dtype=np.int32))
        points, owner = np.append(points, np.uint32(32)), np.append(owner, np.int32(z - a))
        space = points == 32
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
        points, owner, space = points[keep], owner[keep], space[keep]
        keep = np.ones(len(points), dtype=bool)
        keep[:-1] = ~(space[1:] & space[:-1])  # a space that ends a text is the one after it
        yield a, z, _hashed(points[keep], owner[keep]), has


class Filters:
    """All languages' Bloom filters as one bit-sliced table."""

    def __init__(self, languages: list[str], members: list[np.ndarray], prior: str):
        self.languages, self.prior = languages, prior
        kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
        self.bits = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), dtype=kind)
        for i, hashes in enumerate(members):
            for slots in self._slots(hashes):
                np.bitwise_or.at(self.bits[i // 64], slots, kind(1 << (i % 64)))
        fill = [np.count_nonzero(self.bits[i // 64] & kind(1 << (i % 64))) / self.bits.shape[1] for i in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    @staticmethod
    def _slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(HASHES):
            yield ((hashes >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def hits(self, hashes: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """Popcounts: for each of n texts and each language, n-grams that its filter contains."""
        out = np.zeros((n, len(self.languages)))
        for word in range(self.bits.shape[0]):
            mask = None
            for slots in self._slots(hashes):
                found = self.bits[word][slots]
                mask = found if mask is None else mask & found
            for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                hit = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                out[:, i] = np.bincount(owners, weights=hit, minlength=n)
        return out

    def corrected(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Popcounts without the false positives to be expected of ``total`` n-grams a text."""
        return np.maximum(0.0, (hits - total[:, None] * self.false_rate) / (1 - self.false_rate))

    def predict(self, column: pa.Array) -> pa.StructArray:
        if not self.languages:
            n = len(column)
            return pa.StructArray.from_arrays([pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64))], names=["lang", "score", "n_ngrams"])
        languages, scores, sizes = [], [], []
        for a, z, stretches, has in ngrams(column):
            hits, total = np.zeros((z - a, len(self.languages))), np.zeros(z - a, dtype=np.int64)
            for hashes, owners in stretches:
                hits += self.hits(hashes, owners, z - a)
                total += np.bincount(owners, minlength=z - a)
            counts = self.corrected(hits, total.astype(float))
            best, most = counts.argmax(axis=1), counts.max(axis=1)
            # how far the winner's share of the text's n-grams stands above the others' mean
            others = (counts.sum(axis=1) - most) / max(1, len(self.languages) - 1)
            score = np.where(most > 0, (most - others) / np.maximum(most, 1e-9) * most / np.maximum(total, 1), 0.0)
            languages += [UNDETERMINED if not h else self.languages[b] if m > 0 else self.prior for h, b, m in zip(has, best, most, strict=True)]
            scores.append(np.where(has, np.clip(score, 0, 1), 0.0))
            sizes.append(np.where(has, total, 0))
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), join(scores, pa.float64()), join(sizes, pa.int64())], names=["lang", "score", "n_ngrams"])


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Filters:
    """Filters from a bounded sample of labelled rows of ``docs``."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not sizes:
        return Filters([], [], UNDETERMINED)
    rate = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / n))])
    draw = F.pmod(F.xxhash64(id_col, F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < rate[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for a, z, stretches, _ in ngrams(batch.column(1)):
                said = langs[a:z]
                for lang, (hashes, owners) in ((lang, x) for x in stretches for lang in sorted(set(said))):
                    value, n = np.unique(hashes[(said == lang)[owners]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "ngram", "n"])
        kernels.give_back()

    counts = sample.mapInArrow(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    counts = materialize(counts, "ngrams")
    totals = {r[0]: float(r[1]) for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    names = sorted(sizes)
    prior = max(names, key=lambda k: (sizes[k], k))
    if not totals:
        release(counts)
        return Filters(names, [np.zeros(0, np.uint64) for _ in names], prior)
    share = F.col("n") / F.create_map(*[F.lit(x) for pair in sorted(totals.items()) for x in pair])[F.col("lang")]
    shared = counts.withColumn("share", share).withColumn("top", F.max("share").over(Window.partitionBy("ngram")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "ngram"))
    # the driver gets FILTER_NGRAMS rows a language at most
    table = shared.where(F.col("share") * RATIO >= F.col("top")).withColumn("place", place).where(F.col("place") <= FILTER_NGRAMS).select("lang", "ngram").toArrow()
    release(counts)
    langs, grams = np.array(table["lang"].to_pylist(), dtype=object), table["ngram"].to_numpy().view(np.uint64)
    return Filters(names, [grams[langs == lang] for lang in names], prior)


def predictor(spark, filters: Filters, text: Column | str) -> Column:
    """A struct column: lang, score, n_ngrams. The filters have a fixed size and are broadcast."""
    shared = spark.sparkContext.broadcast(filters)

    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        found = shared.value.predict(texts)
        kernels.give_back()
        return found

    return find(F.col(text) if isinstance(text, str) else text)
