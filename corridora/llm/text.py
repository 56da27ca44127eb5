"""Vectorised text kernels: whole Arrow string columns become word and n-gram hashes in numpy.

A column's UTF-8 bytes are one buffer; words are runs of bytes of a class, so their borders are
found with array comparisons. A word's hash is a polynomial in its bytes modulo 2**64, taken as a
difference of prefix sums, then mixed. Two different words or n-grams share a 64-bit hash with
odds of about 1 in 10**19; callers that need more compare the words themselves.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
#: Bytes handled at once. A longer document is a block alone, whose words are still hashed in pieces of
#: so many bytes: it takes about 20 bytes of memory a byte, not the 80 of a piece.
BLOCK_BYTES = 512 << 10


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


@functools.cache
def one_thread() -> None:
    """Holds numpy's matrix products to one thread: a task has one core, and for small products the other
    threads only wait, which doubles the CPU time. Without the bundled OpenBLAS nothing is changed."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def squeeze(values: np.ndarray) -> bytes:
    """Compressed byte planes of an unsigned array (planes of equal significance compress well)."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(blob: bytes, dtype: type) -> np.ndarray:
    """The array that :func:`squeeze` took."""
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes each, and of ``rows`` at most."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n, at + rows)
        yield at, to
        at = to


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK_BYTES + 1), base, dtype=U64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if len(known) <= 2 * BLOCK_BYTES:
            _powers[str(base)] = known
    return known[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each document its first word's number."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span of bytes; the spans ascend and do not overlap."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):  # whole spans of about BLOCK_BYTES at a time
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right")))
        piece = data[starts[at] : ends[to - 1]]
        a, z = starts[at:to] - starts[at], ends[at:to] - starts[at]
        total = np.zeros(len(piece) + 1, dtype=U64)
        np.cumsum((piece.astype(U64) + U64(1)) * _power(_BASE, len(piece)), out=total[1:])
        out[at:to] = mix((total[z] - total[a]) * _power(_INVERSE, len(piece) + 1)[a] + (z - a).astype(U64))
        at = to
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a hash for each word of lower-cased ``data``; first as in word_spans."""
    starts, ends, first = word_spans(data, offsets, kind)
    return span_hashes(data, starts, ends), first


def windows(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of every run of ``length`` words that lies within one document."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, dtype=U64)
    factor = 1
    for j in range(length):
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
        out += words[j : j + n] * U64(factor)
    crosses = np.zeros(n + 1, dtype=np.int32)
    inner = first[1:-1]
    inner = inner[(inner > 0) & (inner < len(words))]
    lo = np.maximum(inner - length + 1, 0)
    np.add.at(crosses, lo[lo < n], 1)
    np.add.at(crosses, np.minimum(inner, n), -1)
    at = np.flatnonzero(np.cumsum(crosses[:-1]) == 0)
    return mix(out[at] + U64(length)), at


def shingle_sets(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's distinct shingles, ascending.

    A document with 1 to ``length - 1`` words has its whole sequence as the one shingle; without
    words it has none.
    """
    hashes, at = windows(words, first, length)
    owner = np.searchsorted(first, at, side="right") - 1
    counts = np.diff(first)
    for n in range(1, length):
        short = np.flatnonzero(counts == n)
        if len(short):
            value = np.zeros(len(short), dtype=U64)
            factor = 1
            for j in range(n):
                factor = factor * 0xD6E8FEB86659FD93 % 2**64
                value += words[first[short] + j] * U64(factor)
            hashes, owner = np.concatenate([hashes, mix(value + U64(n))]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))
