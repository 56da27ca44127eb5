"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes meets a mask, so copies and passages that documents share
are cut alike wherever they lie. A worker keeps what it has encoded: a chunk that it has met before, in this
document or another, costs a lookup. Its ids are those of its inner words only; a cut goes through a word, so
the chunks' join is repaired by encoding that word again, from the last border before the cut to the first
border after it, across as many chunks as that takes. At borders both sides agree exactly with the encoding of
the whole text: a border is where ASCII white space follows something else, and the tokenizers that are taken
(``Chunked`` checks them) drop or keep white space with what follows, so that no normalisation, match or merge
spans a border. Words of chunks that are new are looked up in the same way, and the unknown ones are encoded by
the tokenizers library, all of a block in one call.

Chunks and words are compared by their bytes, never by hashes alone. What a worker keeps is bounded (two
generations: what a full generation did not use again goes), as are blocks of texts, so memory does not grow
with the corpus; nothing is shuffled, and a lost executor costs the encoding of its own rows.

Defined results: a null text counts as empty and has no ids; texts of any length, also without white space;
special tokens' strings in a text become their ids, as the library does by default; equal texts, equal ids.
Other columns pass through; columns of the names ``ids``, ``n_tokens`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name
from .text import U64, blocks, give_back, mix, span_hashes, string_bytes

#: A cut is expected every 2**CUT_BITS bytes, by the hash of the WINDOW bytes before it.
CUT_BITS, WINDOW = 8, 16
#: Words and bytes of chunks in one generation of what a worker keeps.
KEPT_WORDS, KEPT_BYTES = 1 << 19, 32 << 20
#: Words encoded, and tokens decoded, in one call.
CALL = 1 << 14
#: Longer texts are encoded by segments of about so many bytes.
SEGMENT = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def cuts(data: np.ndarray, bits: int = CUT_BITS, window: int = WINDOW) -> np.ndarray:
    """Where to cut: places of which the ``window`` bytes before have a hash that ends in ``bits`` zeros."""
    n = len(data) - window
    if n < 1:
        return np.zeros(0, np.int64)
    h, byte = np.zeros(n, U64), data.astype(U64) + U64(1)
    for j in range(window):
        h += byte[j : j + n] * U64(pow(_FACTOR, j + 1, 1 << 64))
    at = np.flatnonzero(mix(h) & U64((1 << bits) - 1) == 0) + window
    return at[data[at] & 0xC0 != 0x80]  # before whole code points


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of words, each with the white space before it: texts' starts, and white space after anything else."""
    white = _WHITE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = white[1:] & ~white[:-1]
    begins[offsets] = True
    return np.flatnonzero(begins[:-1])


class _Kept(dict):
    """Two generations: a full one becomes the old one, from which what is used again is taken over."""

    def __init__(self, most: int, weigh=lambda key: 1):
        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.most, self.weigh, self.weight = most, weigh, 0

    def find(self, key: bytes) -> bytes | None:
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key: bytes, value: bytes) -> None:
        if self.weight >= self.most:
            self.old, self.weight = dict(self), 0
            self.clear()
        self[key] = value
        self.weight += self.weigh(key)


class Chunked:
    """A tokenizer of the file at ``path``, and what has been encoded by it in this process."""

    def __init__(self, path: str, *, cut_bits: int = CUT_BITS, kept_words: int = KEPT_WORDS, kept_bytes: int = KEPT_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.tokenizer = Tokenizer.from_str(json.dumps(told | {"truncation": None, "padding": None}))
        self._check(told)
        self.cut_bits = cut_bits
        self.words, self.chunks = _Kept(kept_words), _Kept(kept_bytes, len)
        self.encoded = 0  # bytes given to the library
        self.joined = None
        if told.get("decoder") is None:  # the library then joins tokens by spaces
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            size = 1 + max(vocabulary.values(), default=-1)
            tokens = [b""] * size
            for token, i in vocabulary.items():
                tokens[i] = token.encode() + b" "
            self.joined = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def _check(self, told: dict) -> None:
        """Raises for tokenizers that may tie words together across a border."""
        steps = lambda part, inner: [] if part is None else part[inner] if part["type"] == "Sequence" else [part]
        normalizers, splitters = steps(told.get("normalizer"), "normalizers"), steps(told.get("pre_tokenizer"), "pretokenizers")
        plain = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
        spaces = lambda x: x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " "
        splits = [x for x in splitters if x["type"] == "Split" or x["type"] == "ByteLevel" and x.get("use_regex", True) or x["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")]
        ties = [x for x in told.get("added_tokens", []) if x["lstrip"] or x["rstrip"] or any(c.isspace() for c in x["content"])]
        prefixed = any(x.get("add_prefix_space") for x in splitters)
        if told["model"]["type"] != "BPE" or told["model"].get("dropout") or not splits or ties or prefixed or not all(x["type"] in plain or spaces(x) for x in normalizers):
            raise ValueError("only BPE tokenizers that split at white space can be encoded by chunks")
        for text in ("one two", "a  b\n\nc \t d", "x's  'll ́ y", "1 2\n3 ...  !"):
            data, offsets = string_bytes(pa.array([text]))
            at = [*borders(data, offsets).tolist(), len(data)]
            pieces = [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])]
            if [i for p in pieces for i in self._ids(p)] != self._ids(text):
                raise ValueError("the tokenizer ties words together across white space")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _lookup(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some different words."""
        out = [self.words.find(w) for w in words]
        new = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(new), CALL):
            part = new[at : at + CALL]
            self.encoded += sum(len(words[i]) for i in part)
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32).tobytes()
                if len(words[i]) <= 256:  # longer ones hardly come again
                    self.words.keep(words[i], out[i])
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts of a block: those of the library on each whole text."""
        if len(data) <= 2 * SEGMENT:
            return self._encode(data, offsets)
        out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            while a < b:  # a very long text by segments that end at borders, if it has any
                to = a + SEGMENT
                while to < b:
                    white = _WHITE[data[to - 1 : min(b, to + SEGMENT)]]
                    at = np.flatnonzero(white[1:] & ~white[:-1])
                    if len(at):
                        to += int(at[0])
                        break
                    to += SEGMENT
                to = min(to, b)
                ids, _ = self._encode(data[a:to], np.array([0, to - a]))
                out.append(ids)
                sizes[d] += len(ids)
                a = to
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = borders(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        # a text's end cuts too; a word that no cut goes through is inside the chunk that it starts in
        cut = np.union1d(cuts(data, self.cut_bits), offsets[1:])
        chunk = np.searchsorted(cut, starts, side="right")
        whole = ends <= cut[chunk]
        # runs of whole words of one chunk: one row of (first, last + 1) word
        edge = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (whole[1:] != whole[:-1])]))
        runs = np.column_stack([edge, np.append(edge[1:], len(starts))])[whole[edge]]
        known, new = [], []
        fresh = np.ones(len(starts), dtype=bool)
        blob = data.tobytes()
        for a, b, s, e in zip(*runs.T.tolist(), starts[runs[:, 0]].tolist(), ends[runs[:, 1] - 1].tolist()):
            ids = self.chunks.find(blob[s:e])
            if ids is None:
                new.append((a, b, s, e))
            else:
                known.append((a, ids))
                fresh[a:b] = False
        # the other words, joins among them: each different one once
        at = np.flatnonzero(fresh)
        first, which = _different(data, starts[at], ends[at])
        parts = self._lookup([blob[s:e] for s, e in zip(starts[at[first]].tolist(), ends[at[first]].tolist())])
        # items in order: words, and the chunks met before at their first words
        place = np.concatenate([at, np.array([a for a, _ in known], np.int64)])
        part = np.concatenate([which, len(parts) + np.arange(len(known))])
        order = np.argsort(place, kind="stable")
        place, part = place[order], part[order]
        parts += [ids for _, ids in known]
        size = np.array([len(p) for p in parts], np.int64) // 4
        ids, ends_of = _gather(np.frombuffer(b"".join(parts), np.uint32), (np.cumsum(size) - size)[part], size[part])
        before = np.concatenate([[0], ends_of])
        for a, b, s, e in new:
            lo, hi = np.searchsorted(place, (a, b))
            self.chunks.keep(blob[s:e], ids[before[lo] : before[hi]].tobytes())
        return ids, before[np.searchsorted(starts[place], offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The library's texts of ids, special tokens kept."""
        if self.joined is None:
            return pa.array([self.tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())
        table, starts = self.joined
        sizes = np.diff(starts)
        good = ids < len(sizes)
        if not good.all():  # ids without a token say nothing
            offsets = np.concatenate([[0], np.cumsum(good)])[offsets]
            ids = ids[good]
        n = sizes[ids]
        n[offsets[1:][offsets[1:] > offsets[:-1]] - 1] -= 1  # no space after a text's last token
        ends = np.concatenate([[0], np.cumsum(n)])
        data = np.empty(ends[-1], np.uint8)
        for a in range(0, len(ids), CALL):
            b = min(a + CALL, len(ids))
            data[ends[a] : ends[b]], _ = _gather(table, starts[ids[a:b]], n[a:b])
        return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets]), pa.py_buffer(data)])


def _gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends): slices of ``table``, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)] if total else table[:0], ends


def _different(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): one of each different span, and for every span which of those it equals."""
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    same = np.array_equal(size[first][which], size)
    if same:
        a, _ = _gather(data, starts, size)
        b, _ = _gather(data, starts[first][which], size)
        same = np.array_equal(a, b)
    if not same:  # two different words share a hash: compare the words themselves
        seen: dict[bytes, int] = {}
        number = [seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts.tolist(), ends.tolist())]
        _, first, which = np.unique(number, return_index=True, return_inverse=True)
    return first, which


@functools.cache
def chunked(path: str) -> Chunked:
    """One for each process, kept from task to task."""
    return Chunked(path)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and, if wanted, ``decoded``.

    ``path``: a tokenizer's file, at the same place on every executor.
    """
    made = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.StringType())] * decode
    others = [f for f in docs.schema.fields if f.name.lower() not in {m.name for m in made}]
    source = free_name(docs, "text")
    given = docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(text_col).cast("string").alias(source))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunked(path)
        for batch in batches:
            data, offsets = string_bytes(batch.column(len(others)))
            for a, b in blocks(offsets):
                ids, at = own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at * 4), pa.py_buffer(ids)]).cast(pa.binary()), pa.array(np.diff(at))]
                if decode:
                    columns.append(own.decode(ids, at).cast(pa.string()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], *columns], names=[*[f.name for f in others], *[m.name for m in made]])
        give_back()

    return given.mapInArrow(task, T.StructType([*others, *made]))


def decode(coded: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``: the text of ``ids_col``, as :func:`encode` writes it (null ids: empty)."""
    others = [f for f in coded.schema.fields if f.name.lower() != "decoded"]
    source = free_name(coded, "ids")
    given = coded.select(*[F.col(f"`{f.name}`") for f in others], F.coalesce(F.col(ids_col), F.lit(b"")).alias(source))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunked(path)
        for batch in batches:
            column = batch.column(len(others)).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            for a, b in blocks(offsets):
                ids = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), np.uint32)
                texts = own.decode(ids, (offsets[a : b + 1] - offsets[a]) // 4).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(others)], texts], names=[*[f.name for f in others], "decoded"])

    return given.mapInArrow(task, T.StructType([*others, T.StructField("decoded", T.StringType())]))
