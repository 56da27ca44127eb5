"""Quality classifier by Bradley-Terry pairwise ranking.

Learning: every labelled document marked good is paired with every one marked bad, and a linear score of
their features is fitted by logistic loss on the feature differences: P(good beats bad) is the
logistic of the difference of scores. The decision threshold is the quantile of all labelled
documents' scores at the bad ones' share; the reported score is the logistic of the distance from it,
set so that the threshold reads ``CUT``.

Features are counted in numpy over the UTF-8 bytes of whole texts: how often each ASCII character
and character class occurs, lengths, repeated words and lines.

All labelled rows are used; their features are written once. A row's loss against all rows of the other
label follows from how many of these have which score, so pairs are never listed: in a step one pass counts
the scores of both labels on a grid (a score is shared out between the two grid points around it), and
another one sums the gradient. The weights are found by quasi-Newton steps (BFGS), until the gradient is
below ``CLOSE``; the driver meets the grid's counts and one sum of each task. The threshold is told exactly,
by counts in finer and finer parts of the grid.

Defined results: null and empty texts have zero features and get the score that these give; repeated
rows get equal scores; labels that are null are not used; without both labels every score is 0.5;
very long texts are read whole; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as kernels
from .shared import materialize, release

CUT = 0.7
#: Grid points of a unit of the score, and how much finer a part is told at once where a rank is looked for.
GRID, FINER = 64, 4096
#: Rows of one part of the grid that are sorted on the driver. Parts are not told finer than 1 / FINEST.
FEW, FINEST = 10_000, GRID * FINER**3
#: No component of the gradient (of the mean over pairs) is above it in the end, and the steps until then at most.
CLOSE, STEPS = 5e-4, 1000
_CLASSES = np.zeros(256, dtype=np.uint8)
for _i in range(256):
    _c = chr(_i)
    _CLASSES[_i] = 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t" else 5 if _c in "\n\r" else 6 if _i >= 128 else 7
N_FEATURES = 128 + 8 + 10


def features(column: pa.Array) -> np.ndarray:
    """One row of N_FEATURES for each text."""
    raw, offsets = kernels.string_bytes(column)
    parts = []
    for a, z in kernels.blocks(offsets):
        data, at = raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        n, size = z - a, np.diff(at)
        owner = np.repeat(np.arange(n), size)
        length = np.maximum(size, 1)
        marks = np.bincount(owner * 129 + np.minimum(data, 128), minlength=n * 129).reshape(n, 129)[:, :128]
        kinds = np.bincount(owner * 8 + _CLASSES[data], minlength=n * 8).reshape(n, 8)
        starts, ends, first = kernels.word_spans(data, at, kernels.SPACED)
        hashes, _ = kernels.word_hashes(kernels.LOWER[data], at, kernels.SPACED)
        words = np.diff(first)
        word_owner = np.repeat(np.arange(n), words)
        many = np.maximum(words, 1)
        distinct = _distinct(word_owner, hashes, n)
        capital = np.bincount(word_owner, weights=_CLASSES[data[starts]] == 2, minlength=n) if len(starts) else np.zeros(n)
        second = np.where(starts + 1 < ends, _CLASSES[data[np.minimum(starts + 1, ends - 1)]], 0)
        shout = np.bincount(word_owner, weights=(_CLASSES[data[starts]] == 2) & (second == 2), minlength=n) if len(starts) else np.zeros(n)
        tail = np.bincount(word_owner, weights=_CLASSES[data[ends - 1]] == 7, minlength=n) if len(starts) else np.zeros(n)
        line_table = np.ones(256, dtype=bool)
        line_table[[10, 13]] = False
        lines, line_first = kernels.word_hashes(data, at, line_table)
        n_lines = np.diff(line_first)
        line_distinct = _distinct(np.repeat(np.arange(n), n_lines), lines, n)
        extra = np.stack(
            [np.log1p(size), np.log1p(words), np.bincount(word_owner, weights=ends - starts, minlength=n) / many / 10 if len(starts) else np.zeros(n), distinct / many, capital / many, shout / many, tail / many, np.log1p(n_lines), line_distinct / np.maximum(n_lines, 1), n_lines / many], axis=1
        )
        parts.append(np.concatenate([np.sqrt(marks / length[:, None]), np.sqrt(kinds / length[:, None]), extra], axis=1).astype(np.float32))
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(owner[new], minlength=n)


@dataclass
class Ranker:
    """A linear Bradley-Terry score with its threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    steepness: float = 1.0
    fitted: bool = False

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def strength(self, x: np.ndarray) -> np.ndarray:
        # a sum for each row, not a product of matrices: a row's score then depends on no other row
        return (self.scaled(x) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        away = self.steepness * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(away, -30, 30)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(labels, features) of batches of rows (good, x)."""
    kernels.one_thread()
    for batch in batches:
        yield batch.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, N_FEATURES)


def _summed(rows: DataFrame, tell: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``tell(labels, features)`` over all rows: each task adds up its own."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for good, x in _read(batches):
            part = tell(good, x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.mapInArrow(add, "sums binary").toArrow()["sums"].to_pylist()
    return np.sum([np.frombuffer(p) for p in parts], axis=0) if parts else np.zeros(0)


def _counts(rows: DataFrame, tell: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For bad and good rows: (ascending keys, summed counts) of ``tell(label's number, features)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for good, x in _read(batches):
            for k in (0, 1):
                keys, n = tell(k, x[good == k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), pa.array(n.astype(float))], names=["good", "key", "n"])

    said = rows.mapInArrow(count, "good int, key double, n double").toArrow()
    good, keys, n = (said[c].to_numpy() for c in ("good", "key", "n"))
    out = []
    for k in (0, 1):
        each, at = np.unique(keys[good == k], return_inverse=True)
        out.append((each, np.bincount(at, weights=n[good == k], minlength=len(each))))
    return out


@dataclass
class _Pairs:
    """The loss of all pairs, and how much each label's rows are pulled at the grid's points."""

    points: np.ndarray
    loss: float
    pull: tuple[np.ndarray, np.ndarray]  # of bad and of good rows


def _pairs(rows: DataFrame, model: Ranker) -> _Pairs:
    def shared_out(_: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = model.strength(x) * GRID
        at = np.floor(s)
        keys, place = np.unique(np.r_[at, at + 1], return_inverse=True)
        return keys, np.bincount(place, weights=np.r_[at + 1 - s, s - at], minlength=len(keys))

    found = _counts(rows, shared_out)
    low = min(keys[0] for keys, _ in found)
    size = int(max(keys[-1] for keys, _ in found) - low) + 1
    bad, good = np.zeros(size), np.zeros(size)
    for share, (keys, n) in zip((bad, good), found, strict=True):
        share[(keys - low).astype(np.int64)] = n / n.sum()
    apart = np.arange(1 - size, size) / GRID
    wide = 1 << (3 * size).bit_length()

    def against(share: np.ndarray, kernel: np.ndarray) -> np.ndarray:  # sums over all distances, by Fourier transforms
        return np.fft.irfft(np.fft.rfft(share, wide) * np.fft.rfft(kernel, wide), wide)[size - 1 : 2 * size - 1]

    loses = 1 / (1 + np.exp(np.clip(apart, -500, 500)))
    loss = float(good @ against(bad, np.logaddexp(0, -apart)))
    return _Pairs((low + np.arange(size)) / GRID, loss, (np.maximum(against(good, loses[::-1]), 0), np.maximum(against(bad, loses), 0)))


def _ranked(rows: DataFrame, model: Ranker, labels: tuple[int, ...], share: float) -> float:
    """The quantile at ``share`` of the strengths of all rows with one of the labels, between the two nearest as numpy's."""

    def told(scale: int, inside: tuple[int, float] | None, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        def keyed(k: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = model.strength(x if k in labels else x[:0])
            if inside:
                s = s[np.floor(s * inside[0]) == inside[1]]
            return np.unique(s if exact else np.floor(s * scale), return_counts=True)

        both = _counts(rows, keyed)
        keys, at = np.unique(np.r_[both[0][0], both[1][0]], return_inverse=True)
        return keys, np.bincount(at, weights=np.r_[both[0][1], both[1][1]], minlength=len(keys))

    grid = told(GRID, None)

    def at_rank(rank: float) -> float:
        scale, (keys, n) = GRID, grid
        while True:
            upto = np.cumsum(n)
            i = int(np.searchsorted(upto, rank, side="right"))
            rank -= upto[i] - n[i]
            if n[i] <= FEW or scale >= FINEST:
                values, n = told(scale, (scale, keys[i]), exact=True)
                return float(values[np.searchsorted(np.cumsum(n), rank, side="right")])
            scale, (keys, n) = scale * FINER, told(scale * FINER, (scale, keys[i]))

    rank = share * (grid[1].sum() - 1)
    below = at_rank(np.floor(rank))
    return below if rank == np.floor(rank) else below + (rank - np.floor(rank)) * (at_rank(np.floor(rank) + 1) - below)


def fit(rows: DataFrame, *, decay: float = 1e-3) -> Ranker:
    """Learns from a table of all labelled rows (good, x), which is read in every step."""

    def moments(good: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.stack([np.r_[(good == k).sum(), x[good == k].sum(0), (x[good == k] ** 2).sum(0)] for k in (0, 1)])

    told = _summed(rows, moments)
    n, first, second = np.split(told.reshape(2, -1), [1, 1 + N_FEATURES], axis=1) if len(told) else [np.zeros((2, 1))] * 3
    if not n.all():
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES))
    # both labels weigh alike in the scale, whatever their numbers; rounded, so that the order of sums does not show
    first, second = first / n, second / n
    variance = np.maximum(second - first**2, 0).mean(0)
    mean, scale = (v.astype(np.float32).astype(float) for v in (first.mean(0), np.sqrt(variance + ((first[0] - first[1]) / 2) ** 2) + 1e-3))

    def slope(model: Ranker, pairs: _Pairs) -> np.ndarray:
        each, points, pull, w = (1 / n[0, 0], -1 / n[1, 0]), pairs.points, pairs.pull, model.weights

        def sums(good: np.ndarray, x: np.ndarray) -> np.ndarray:
            s = model.strength(x)
            force = np.where(good == 1, each[1] * np.interp(s, points, pull[1]), each[0] * np.interp(s, points, pull[0]))
            return force @ model.scaled(x)

        return np.round((_summed(rows, sums) + decay * w) * 2.0**24) / 2.0**24

    model = Ranker(mean, scale, np.zeros(N_FEATURES))
    pairs = _pairs(rows, model)
    loss, gradient = pairs.loss, slope(model, pairs)
    inverse = np.eye(N_FEATURES) * 0.3 / max(float(np.linalg.norm(gradient)), 1e-9)  # of the curvature
    for step in range(STEPS + 1):
        if np.abs(gradient).max() <= CLOSE:
            break
        if step == STEPS:
            raise RuntimeError(f"the ranking did not settle in {STEPS} steps")
        way, length = -inverse @ gradient, 1.0
        while length > 1e-6:
            tried = Ranker(mean, scale, model.weights + length * way)
            pairs = _pairs(rows, tried)
            after = pairs.loss + decay / 2 * float(tried.weights @ tried.weights)
            if after <= loss + 1e-4 * length * float(gradient @ way):
                break
            length /= 2
        else:
            break  # nothing nearer is better, as far as the grid tells
        slopes = slope(tried, pairs)
        moved, turned = tried.weights - model.weights, slopes - gradient
        if (bent := float(moved @ turned)) > 1e-12:
            if step == 0:
                inverse = np.eye(N_FEATURES) * bent / float(turned @ turned)
            shear = np.eye(N_FEATURES) - np.outer(moved, turned) / bent
            inverse = shear @ inverse @ shear.T + np.outer(moved, moved) / bent
        model, loss, gradient = tried, after, slopes
    gap = max(1e-6, _ranked(rows, model, (1,), 0.5) - _ranked(rows, model, (0,), 0.5))
    threshold = _ranked(rows, model, (0, 1), float(n[0, 0] / n.sum()))
    return Ranker(mean, scale, model.weights, threshold, 8.0 / gap, True)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """A ranker from all documents and labels that share ids; other labelled rows must be left out before."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("__good")).distinct()
    # features are counted before the join: they are moved where labels are many, never the texts
    counted = docs.select(id_col, _vectors(F.col(text_col).cast("string")).alias("__x")).join(marked, id_col)
    rows = materialize(counted.select("__good", "__x"), "features")
    ranker = fit(rows)
    release(rows)
    return ranker


@F.arrow_udf(T.BinaryType())
def _vectors(texts: pa.Array) -> pa.Array:
    x = features(texts)
    return pa.array([row.tobytes() for row in x], pa.binary())


def scorer(spark, ranker: Ranker, text: Column | str) -> Column:
    """A double column: the score of each text."""
    shared = spark.sparkContext.broadcast(ranker)

    @F.arrow_udf(T.DoubleType())
    def find(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(features(texts)).astype(np.float64))

    return find((F.col(text) if isinstance(text, str) else text).cast("string"))


def keep_best(docs: DataFrame, ranker: Ranker, share: float, *, text_col: str = "text") -> DataFrame:
    """``docs`` at or above the score quantile that leaves about ``share`` of them (to 0.1 %)."""
    scored = docs.withColumn("__score", scorer(docs.sparkSession, ranker, text_col))
    cut = scored.agg(F.percentile_approx("__score", 1 - share, 10_000)).first()[0]
    return scored.where(F.col("__score") >= F.lit(cut)).drop("__score") if cut is not None else docs
