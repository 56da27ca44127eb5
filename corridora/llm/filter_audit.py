"""Filter interaction audit: what each filter removes, alone and in every order of all of them.

Four filters look at one text; their verdicts are bits of a mask, told by scanning Arrow buffers in numpy:
byte classes mark the starts of words, capitals, symbols and code points, and prefix sums at the texts'
offsets count them. Distinct words are runs of a text's sorted word hashes; words of one hash are verified
byte by byte, and a text in which two words share a hash is counted by its words instead. The fifth filter
(exact copies) compares all texts by SHA-256.

Rows are reduced early: documents that agree in text, part and labels are one row with a number of documents
before the texts' smallest ids are found, so a text that a third of all rows repeat is a few rows. What all
orders do follows from how many documents have each mask, at most 32 of them a part and label: an order of
filters removes a document at the first letter in its mask.

Defined results: a null text counts as empty; a null part and the empty part are one, the empty string. Copies
are told by id: of equal texts all fail but those of the smallest id; rows that repeat the smallest id stay; a
row without an id neither fails nor makes another fail. Labels of one id count together (1 if any row says 1),
ids without labels count as not labelled. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .text import SPACED, blocks, span_hashes, string_bytes, word_spans

#: Filters by letter; a failing document has the letter's bit in its mask.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
#: Bytes that begin a code point.
_POINT = (np.arange(256) & 0xC0) != 0x80
#: Bytes of one comparison of words.
_PIECE = 1 << 20


def _counts(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=total[1:])
    return np.diff(total[offsets])


def _unlike(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of the spans of ``n`` bytes at ``a`` and at ``b`` differ, compared in pieces of bounded size."""
    out, total, at = np.zeros(len(a), dtype=bool), np.concatenate([[0], np.cumsum(n)]), 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, total[at] + _PIECE, side="right")) - 1)
        if to == at + 1:  # one word, perhaps a very long one: no index for each byte
            out[at] = not np.array_equal(data[a[at] : a[at] + n[at]], data[b[at] : b[at] + n[at]])
        else:
            base = np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at], n[at:to])
            wrong = np.flatnonzero(data[np.repeat(a[at:to], n[at:to]) + base] != data[np.repeat(b[at:to], n[at:to]) + base])
            out[np.searchsorted(total, wrong + total[at], side="right") - 1] = True
        at = to
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """How many different words each document has; ``hashes`` are told from the words unless given."""
    n = len(first) - 1
    if hashes is None:
        hashes = span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (o[1:] == o[:-1])) + 1
    out = np.diff(first) - np.bincount(o[again], minlength=n)
    a, b = order[again], order[again - 1]
    size = ends - starts
    unlike = size[a] != size[b]
    same = np.flatnonzero(~unlike)
    unlike[same] = _unlike(data, starts[a[same]], starts[b[same]], size[a[same]])
    for d in np.unique(o[again[unlike]]).tolist():  # two words of one hash: count the words themselves
        out[d] = len({data[s:e].tobytes() for s, e in zip(starts[first[d] : first[d + 1]].tolist(), ends[first[d] : first[d + 1]].tolist())})
    return out


def verdicts(texts: pa.Array) -> np.ndarray:
    """The mask of the filters A to D of each text."""
    data, offsets = string_bytes(texts)
    out = np.zeros(len(offsets) - 1, dtype=np.int32)
    for at, to in blocks(offsets):
        piece, off = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, ends, first = word_spans(piece, off, SPACED)
        words = np.diff(first)
        fails = (
            words < LEAST_WORDS,
            100 * distinct_words(piece, starts, ends, first) < LEAST_DISTINCT * words,
            100 * _counts(_CAPITAL[piece], off) > MOST_CAPITALS * _counts(_POINT[piece], off),
            _counts(_SYMBOL[piece], off) > 0,
        )
        out[at:to] = sum(f.astype(np.int32) << b for b, f in enumerate(fails))
    return out


def text_mask(text: Column | str) -> Column:
    """An int column: the mask of the filters A to D."""

    @F.arrow_udf(T.IntegerType())
    def find(texts: pa.Array) -> pa.Array:
        return pa.array(verdicts(texts))

    return find((F.col(text) if isinstance(text, str) else text).cast("string"))


def masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """How many documents (``n``) of each ``part`` and labels (``good``, ``toxic``) have each ``mask``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("name"))
    # rows that repeat id and text are one; rows without an id are dealt over the join by their text
    rows = rows.groupBy("id", "name", "part", "mask").agg(F.count(F.lit(1)).alias("n")).withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("name")))
    marked = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(marked("quality"), marked("toxic")).withColumn("deal", F.lit(None).cast("long"))
    both = rows.join(known, (rows["id"] == known["id"]) & rows["deal"].eqNullSafe(known["deal"]), "left")
    one = both.select(rows["id"], "name", "part", "mask", "n", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # by id first, so that n tells the rows of the smallest; then by text
    one = one.groupBy("id", "name", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    cells = one.groupBy("name", "part", "mask", "good", "toxic").agg(
        F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    # a text has at most four cells of labels for each of its parts
    first = F.col("least") == F.min("least").over(Window.partitionBy("name"))
    copies = F.coalesce(F.col("n") - F.col("n_null") - F.when(first, F.col("n_least")).otherwise(0), F.lit(0))
    told = cells.withColumn("copies", copies).withColumn("rest", F.col("n") - F.col("copies"))
    each = F.explode(F.array(F.struct(F.col("mask"), F.col("rest").alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), F.col("copies").alias("n"))))
    told = told.select("part", "good", "toxic", each.alias("e"))
    return told.groupBy("part", "good", "toxic", F.col("e.mask").alias("mask")).agg(F.sum("e.n").alias("n"))


def interactions(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step; counts of documents, from those of masks.

    A document is removed at the first of an order's letters that its mask has. Of all orders that is a
    given one of its k letters in one of k: so the Shapley counts are sums of (number of orders) / k.
    """
    orders = " ".join("".join(p) for p in itertools.permutations(letters))
    total = len(orders.split())
    k = F.bit_count("mask")
    rows = masks.withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    mine = F.expr(f"shiftleft(1, locate(substr(filter_order, step, 1), '{letters}') - 1)")
    before = sum((F.when(F.expr(f"locate('{x}', filter_order)") < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    rows = rows.withColumn("fails", F.col("mask").bitwiseAND(mine) != 0).withColumn("gone", F.col("mask").bitwiseAND(before) != 0)
    counted = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    fails, gone = F.col("fails"), F.col("gone")
    return rows.groupBy("part", "filter_order", "step").agg(
        counted(~fails & ~gone).alias("kept"),
        counted(fails & ~gone).alias("removed"),
        counted(fails & gone).alias("redundant"),
        counted(fails & (k == 1)).alias("unique_fails"),
        counted(fails & ~gone & F.col("good")).alias("good_lost"),
        counted(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, F.expr(f"n * ({total} div bit_count(mask))"))), F.lit(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The interactions of the five filters on ``docs``, by ``part_col``."""
    return interactions(masks(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
