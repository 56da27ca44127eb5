"""Chat formatting by columnar byte assembly.

Template, for each turn: ``### role: text</turn>`` and a newline. Control strings inside roles and
texts are escaped reversibly: a backslash goes before every ``\\``, ``#`` and ``<`` (in roles also
before ``:``), so an unescaped ``### `` or ``</turn>`` is always the template's own.

Turns are dealt out by conversation and sorted by turn. For a batch of turns, numpy computes the
segments' lengths, their cumulative offsets and the place of every byte, and headers, contents and
ends are copied into one preallocated buffer, which becomes the Arrow column. The loss mask is a
list of byte ranges: each assistant text once.

A conversation is streamed: one that spans several batches comes out as consecutive chunks of whole
turns, so no conversation is held whole, however long it is.

Defined results: null texts and roles count as empty; null turns come first; ties in turn are
ordered by role, then text; repeated rows are kept as turns of their own; a null conversation id is
a conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as kernels
from .shared import partitions

_START, _MIDDLE, _END = (np.frombuffer(x, dtype=np.uint8) for x in (b"### ", b": ", b"</turn>\n"))
_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[[ord("\\"), ord("#"), ord("<")]] = True
_ESCAPED_ROLE = _ESCAPED.copy()
_ESCAPED_ROLE[ord(":")] = True
#: One turn of the template; groups: role, text.
TURN = re.compile(rb"### ((?:\\.|[^\\:#<])*): ((?:\\.|[^\\#<])*)</turn>\n", re.DOTALL)
_SHORT = re.compile(rb"\\(.)", re.DOTALL)

CHUNKS = "conv_id long, chunk long, n_turns long, formatted binary, loss array<long>"
_CHUNKS_ARROW = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.binary()), ("loss", pa.list_(pa.int64()))])


def _escape(data: np.ndarray, offsets: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, places, offsets): where each byte goes after escaping; a special byte moves on by one."""
    extra = np.cumsum(special[data])
    grown = np.r_[0, extra][offsets] + offsets
    return data, np.arange(len(data)) + extra, grown


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, ends, text borders): all turns' bytes, each turn's end, and its text's two borders."""
    role, role_at = kernels.string_bytes(roles)
    text, text_at = kernels.string_bytes(texts)
    role, role_to, role_grown = _escape(role, role_at, _ESCAPED_ROLE)
    text, text_to, text_grown = _escape(text, text_at, _ESCAPED)
    n = len(role_at) - 1
    role_len, text_len = np.diff(role_grown), np.diff(text_grown)
    lengths = len(_START) + role_len + len(_MIDDLE) + text_len + len(_END)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    role_start = starts + len(_START)
    text_start = role_start + role_len + len(_MIDDLE)
    text_end = text_start + text_len
    out = np.full(int(ends[-1]) if n else 0, ord("\\"), dtype=np.uint8)
    for piece, at in ((_START, starts), (_MIDDLE, role_start + role_len), (_END, text_end)):
        for j, byte in enumerate(piece):
            out[at + j] = byte
    out[role_to + np.repeat(role_start - role_grown[:-1], np.diff(role_at))] = role
    out[text_to + np.repeat(text_start - text_grown[:-1], np.diff(text_at))] = text
    return out, ends, np.stack([text_start, text_end], axis=1)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: object = ()
    chunk = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.array(batch.column(0).to_pylist(), dtype=object)
        out, ends, borders = assemble(batch.column(1), batch.column(2))
        change = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        stops = np.r_[change[1:], len(ids)]
        starts = np.r_[0, ends][change]
        speaks = np.array([r == "assistant" for r in batch.column(1).to_pylist()])
        losses = [(borders[a:z][speaks[a:z]] - s).reshape(-1).tolist() for a, z, s in zip(change, stops, starts, strict=True)]
        chunks = np.zeros(len(change), dtype=np.int64)
        chunk = chunk + 1 if ids[0] == last else 0
        chunks[0] = chunk
        if len(change) > 1:
            chunk = 0
        last = ids[-1]
        at = np.r_[starts, ends[-1]]
        if at[-1] < 2**31:
            column = pa.Array.from_buffers(pa.binary(), len(change), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])
        else:
            column = pa.array([out[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ids[change].tolist(), pa.int64()), pa.array(chunks), pa.array(stops - change), column, pa.array(losses, pa.list_(pa.int64()))], schema=_CHUNKS_ARROW)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to chunks: conv_id, chunk, n_turns, formatted, loss.

    ``loss`` holds (start, end) byte pairs within the chunk. A task's chunks of a conversation follow
    each other; most conversations are one chunk.
    """
    columns = [F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn")]
    dealt = turns.select(*columns).repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, CHUNKS)


def unescape(data: bytes) -> bytes:
    return _SHORT.sub(rb"\1", data)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The turns (role, text) of formatted bytes."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn of the template at byte {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _characters(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now: list | None = None

    def row(state: list) -> tuple:
        return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    for batch in batches:
        done = []
        for conv, chunk, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
            if chunk == 0:
                if now is not None:
                    done.append(row(now))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            data = formatted.as_py()
            for role, text in parse(data):
                now[1] += 1
                now[2].update(role + b"\n" + text + b"\n")
            for a, z in zip(loss[::2], loss[1::2], strict=True):
                said = unescape(data[a:z])
                now[3] += _characters(said)
                now[4].update(said)
            now[5] += _characters(data)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(now), types, strict=True)], names=names)


def digests(chunks: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of :func:`format_chats` (in its order)."""
    return chunks.mapInArrow(_digest, DIGESTS)
