"""Centroid clustering by partial-distance search, in exact integers.

A vector's components become integers, ``floor(scale * x)``. Each round assigns every vector to its nearest
centroid and replaces every centroid that has vectors by their componentwise exact floor(sum / count). Sums
are taken in numpy for each task, then as decimals by Spark: the driver meets ``k`` rows of sums, whatever
the number of vectors, and all of a round's state is ``k`` centroids.

Partial-distance search: the components are taken in descending order of their variance over all vectors.
The squared differences of the first ones to every centroid order a vector's candidates; one candidate after
another then accumulates the other components by blocks, and is abandoned as soon as its partial sum lies
strictly above the best distance so far. Survivors finish all components, so distances and ties are exact.
The order only affects how early a candidate goes, never the result.

Defined results: vectors that are null, have not exactly ``dims`` components, or a null or non-finite one, are
left out. Ties go to the smaller centroid. Start: the vectors of the smallest digests of ``seed:id`` (a null id
counts as the empty text), equal digests (repeated ids) in the order of their components; with fewer than ``k``
vectors there are as many centroids. A round's empty centroids stay. An empty table gives an empty result.
Components of any finite size are handled: rows or centroids beyond 2**27 are compared in Python integers;
a distance or a sum of them above 2**63 - 1 reads 2**63 - 1. Other columns of the table, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Components compared with every centroid before candidates are ordered, and in each block after.
FIRST, BLOCK = 8, 14
_MOST = (1 << 63) - 1
#: Components count as no larger where their variance is told, which only orders them.
_FAR = 10**100
#: Rows compared at once.
_ROWS = 4096


def _small(dims: int) -> int:
    """Below this size of all components a squared distance stays under 2**63 (2**27 for 64 of them)."""
    return 1 << (61 - dims.bit_length()) // 2


def _kept(vector: Column, dims: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def _integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """(rows, dims) of floor(scale * x): int64 where all are small, Python integers otherwise."""
    with np.errstate(over="ignore"):
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        q = np.floor(scale * x)
    if not len(q) or np.abs(q).max() < _small(dims):
        return q.astype(np.int64)
    # a product beyond doubles is of a double that is whole
    exact = [[int(b) if abs(b) < np.inf else scale * int(a) for a, b in zip(r, s)] for r, s in zip(x.tolist(), q.tolist())]
    return np.array(exact, dtype=object).reshape(q.shape)


class Centroids:
    """``rows``: exact integers, one list a centroid; ``order``: components by descending variance."""

    def __init__(self, rows: list[list[int]], order: list[int]):
        self.rows, self.order = rows, order

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of ``q``."""
        c = np.array(self.rows, dtype=object).reshape(len(self.rows), -1)
        if q.dtype == np.int64 and all(abs(v) < _small(c.shape[1]) for r in self.rows for v in r):
            c = c.astype(np.int64)
        else:
            q = q.astype(object)
        q, c = q[:, self.order], c[:, self.order]
        found, best = np.zeros(len(q), np.int64), np.zeros(len(q), q.dtype)
        for at in range(0, len(q), _ROWS):
            found[at : at + _ROWS], best[at : at + _ROWS] = _search(q[at : at + _ROWS], c)
        return found, best


def _search(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, dims = q.shape
    partial = np.zeros((n, len(c)), q.dtype)
    for d in range(min(FIRST, dims)):  # a component at a time: no array of rows x centroids x components
        step = q[:, d, None] - c[None, :, d]
        partial += step * step
    turns = np.argsort(partial, axis=1, kind="stable")
    found, best = np.full(n, -1, np.int64), np.zeros(n, q.dtype)
    live = np.arange(n)
    for turn in range(len(c)):
        k = turns[live, turn]
        sums = partial[live, k]
        # candidates come by ascending partial sums: one strictly above the best ends the row
        near = np.ones(len(live), bool) if turn == 0 else sums <= best[live]
        live, k, sums = live[near], k[near], sums[near]
        if not len(live):
            break
        rows, left = np.arange(len(live)), sums
        for at in range(FIRST, dims, BLOCK):
            step = q[live[rows], at : at + BLOCK] - c[k[rows], at : at + BLOCK]
            left = left + (step * step).sum(axis=1)
            if turn:
                stays = left <= best[live[rows]]
                rows, left = rows[stays], left[stays]
        r, k = live[rows], k[rows]
        if turn:
            wins = (left < best[r]) | (k < found[r])  # equal distances: the smaller centroid
            r, k, left = r[wins], k[wins], left[wins]
        found[r], best[r] = k, left
    return found, best


#: A task's sums, one row for each 32 bits of a number: exact for integers of any size, and longs to Spark.
_SUMS = "k int, d int, part int, s long, f double"
_BITS = 32


def _sums(k: int, values: list[int], squares: list[float] | None = None) -> list[tuple]:
    out = []
    for d, v in enumerate(values):
        sign, v, part = (-1, -v, 0) if v < 0 else (1, v, 0)
        out.append((k, d, 0, sign * (v & (1 << _BITS) - 1), squares[d] if squares else 0.0))
        while v := v >> _BITS:
            part += 1
            out.append((k, d, part, sign * (v & (1 << _BITS) - 1), 0.0))
    return out


def _added(vectors: DataFrame, task) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], float]]:
    """What ``task`` sums of each partition's vectors, added over all: {(k, d): exact sum}, {(k, d): float sum}."""
    exact: dict[tuple[int, int], int] = {}
    floats: dict[tuple[int, int], float] = {}
    parts = vectors.mapInArrow(task, _SUMS).groupBy("k", "d", "part").agg(F.sum("s").alias("s"), F.sum("f").alias("f"))
    for r in parts.collect():  # one row for each centroid, component and 32 bits
        exact[r.k, r.d] = exact.get((r.k, r.d), 0) + (r.s << _BITS * r.part)
        floats[r.k, r.d] = floats.get((r.k, r.d), 0.0) + r.f
    return exact, floats


def _table(rows: list[tuple]) -> pa.RecordBatch:
    k, d, part, s, f = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(d, pa.int32()), pa.array(part, pa.int32()), pa.array(s, pa.int64()), pa.array(f, pa.float64())], names=["k", "d", "part", "s", "f"])


def _spread(dims: int, scale: int):
    """A task that sums components and their squares."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, [0] * dims, np.zeros(dims)
        for batch in batches:
            q = _integers(batch.column(0), dims, scale)
            n += len(q)
            total = [a + int(b) for a, b in zip(total, q.sum(axis=0))] if len(q) else total
            squares += (np.clip(q, -_FAR, _FAR).astype(np.float64) ** 2).sum(axis=0)
        yield _table(_sums(0, total, squares.tolist()) + _sums(-1, [n]) if n else [])

    return task


def _members(centroids: Centroids, dims: int, scale: int):
    """A task that sums the components of each centroid's vectors, and under ``d = dims`` their number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * len(centroids.rows), [[0] * dims for _ in centroids.rows]
        for batch in batches:
            q = _integers(batch.column(0), dims, scale)
            found, _ = centroids.nearest(q)
            for k in np.unique(found).tolist():
                mine = q[found == k]
                n[k] += len(mine)
                total[k] = [a + int(b) for a, b in zip(total[k], mine.sum(axis=0))]
        yield _table([row for k, values in enumerate(total) if n[k] for row in _sums(k, [*values, n[k]])])

    return task


def _inertias(centroids: Centroids, dims: int, scale: int):
    """A task that sums the distances of each centroid's vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            found, best = centroids.nearest(_integers(batch.column(0), dims, scale))
            for k in np.unique(found).tolist():
                mine = best[found == k]  # sums of at most 2**30 rows of 2**62 would not fit 64 bits: two halves
                total[k] = total.get(k, 0) + (int((mine >> 32).sum()) << 32) + int((mine & 0xFFFFFFFF).sum())
        yield _table([row for k, v in total.items() for row in _sums(k, [v])])

    return task


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> Centroids:
    """The centroids after ``rounds`` rounds over all kept vectors; no rows for an empty table."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(_kept(F.col("v"), dims))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    # each partition keeps its k first only
    first = kept.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return Centroids([], list(range(dims)))
    start = _integers(pa.array([r.v for r in first], pa.list_(pa.float64())), dims, scale)
    only = kept.select("v")
    exact, squares = _added(only, _spread(dims, scale))
    n = exact[-1, 0]
    spread = [squares[0, d] / n - float(min(abs(exact[0, d] // n), _FAR)) ** 2 for d in range(dims)]
    centroids = Centroids([[int(x) for x in r] for r in start], sorted(range(dims), key=lambda d: (-spread[d], d)))
    for _ in range(rounds):
        sums, _ = _added(only, _members(centroids, dims, scale))
        rows = [[sums[c, d] // sums[c, dims] for d in range(dims)] if (c, dims) in sums else old for c, old in enumerate(centroids.rows)]
        centroids = Centroids(rows, centroids.order)
    return centroids


def cluster(vectors: DataFrame, centroids: Centroids, *, vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """The kept rows of ``vectors`` with ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Two passes over the vectors: the sums first, which every row then carries.
    """
    name = free_name(vectors, "found")
    named = {c.lower() for c in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")}
    others = [F.col(f"`{c}`") for c in vectors.columns if c.lower() not in named]
    v = F.col(vector_col).cast("array<double>")
    kept = vectors.where(_kept(v, dims))
    sums: dict[tuple[int, int], int] = {}
    if centroids.rows:
        sums, _ = _added(kept.select(v.alias("v")), _inertias(centroids, dims, scale))

    @F.arrow_udf(T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))
    def find(column: pa.Array) -> pa.Array:
        found, best = centroids.nearest(_integers(column, dims, scale))
        best = np.minimum(best, _MOST).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(found, pa.int32()), pa.array(best)], names=["cluster", "distance"])

    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values or [None]]), F.col(f"{name}.cluster") + 1)
    each = [sums.get((c, 0), 0) for c in range(len(centroids.rows))]
    return kept.withColumn(name, find(v)).select(
        *others, F.col(f"{name}.cluster").alias("cluster"), F.col(f"{name}.distance").alias("distance"),
        of([min(s, _MOST) for s in each], "long").alias("cluster_inertia"), F.lit(min(sum(each), _MOST)).cast("long").alias("inertia"), of(centroids.digests(), "string").alias("centroid_sha256"),
    )
