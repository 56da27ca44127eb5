"""Media columns: archives of media members behind a custom Spark data source.

A payload is stored losslessly as an 8-bit greyscale PNG, 64 samples wide. Members are appended to
archive files, one per task, each after a header: sync marker, id, length of the unpadded text, length, checksum, and a checksum
of the header itself. A manifest, written when all tasks have committed, names the files that count,
so a task that is retried or run twice leaves nothing behind.

Reading plans byte ranges over the archive directory from file sizes alone. A task finds its first
member by the marker and takes the members whose header starts in its range, streaming Arrow batches
of bounded size. A member that cannot be read is retried by its offset, independently of the others;
one that stays unreadable is reported in ``error`` and the task goes on after it.

Defined results: null and empty texts give one row of 64 zero bytes; equal payloads give equal media;
repeated rows are members of their own; a null id stays null; an empty table gives an empty archive.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import materialize, shared_folder

WIDTH = 64
RANGE_BYTES, BATCH_BYTES, BATCH_ROWS = 16 << 20, 8 << 20, 10_000
#: Reads of a member, and the seconds before the second one, which double.
RETRIES, PAUSE = 4, 0.2
_MARK = b"\x00\xffMEMBER\xff\x00\x9d\x1b\xe7\x42\xa6\x58"
_HEAD = struct.Struct("<16sqBQQII")
SCHEMA = "doc_id long, file string, offset long, n_bytes long, media binary, error string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A PNG of ``payload`` (a positive multiple of WIDTH bytes), one sample a byte."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of a PNG that :func:`encode_png` has made, as rows."""
    at, width, height, data = 8, 0, 0, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:]


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of WIDTH, and the length without them."""
    data = (text or "").encode()
    return data + bytes(-len(data) % WIDTH if data else WIDTH), len(data)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    stop: int
    size: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    members: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """(doc_id, n_bytes, media) to one archive file of this task attempt."""
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        name, members = f"members-{uuid.uuid4().hex}.archive", 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                for doc_id, n_bytes, media in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                    data = media.as_py()
                    head = _HEAD.pack(_MARK, doc_id or 0, doc_id is None, n_bytes, len(data), zlib.crc32(data), 0)
                    out.write(head[:-4] + struct.pack("<I", zlib.crc32(head[:-4])) + data)
                    members += 1
        return Written(name, members)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_manifest.json") as out:
            out.write(json.dumps({m.file: m.members for m in messages if m}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{folder}/{m.file}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        store, folder = _store(self.path)
        with store.open_input_stream(f"{folder}/_manifest.json") as manifest:
            files = json.loads(manifest.read())
        sizes = [(f, store.get_file_info(f"{folder}/{f}").size) for f in sorted(files)]
        ranges = [ByteRange(f, at, min(size, at + self.range_bytes), size) for f, size in sizes for at in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, folder = _store(self.path)
        opened = [store.open_input_file(f"{folder}/{partition.file}")]

        def reopen() -> None:
            opened[0].close()
            opened[0] = store.open_input_file(f"{folder}/{partition.file}")

        rows, held = [], 0
        at, problem = _patiently(lambda: _next_head(opened[0], partition.start, partition.size), reopen)
        while problem is None and at is not None and at < partition.stop:
            member, damage = _patiently(lambda: _read_member(opened[0], at), reopen)
            if damage is not None:
                rows.append((None, partition.file, at, None, None, str(damage)))
                at, problem = _patiently(lambda: _next_head(opened[0], at + 1, partition.size), reopen)
            else:
                doc_id, n_bytes, media, following = member
                rows.append((doc_id, partition.file, at, n_bytes, media, None))
                held += len(media)
                at = following if following < partition.size else None
            if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _rows(rows)
                rows, held = [], 0
        opened[0].close()
        if problem is not None:  # the file itself cannot be read: the task fails and is run again
            raise problem
        if rows:
            yield _rows(rows)


def _patiently(read: Callable, reopen: Callable[[], None]) -> tuple[object, Exception | None]:
    """(what ``read`` gives, None), or (None, what kept going wrong) after RETRIES, with pauses that double."""
    problem: Exception | None = None
    for turn in range(RETRIES):
        try:
            return read(), None
        except (OSError, ValueError, struct.error) as e:
            problem = e
            if isinstance(e, OSError) and turn + 1 < RETRIES:
                time.sleep(PAUSE * 2**turn)
            reopen()
    return None, problem


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _head(data: bytes) -> tuple[int | None, int, int, int]:
    mark, doc_id, gone, n_bytes, size, check, own = _HEAD.unpack(data)
    if mark != _MARK or own != zlib.crc32(data[:-4]):
        raise ValueError("no member starts here")
    return None if gone else doc_id, n_bytes, size, check


def _read_member(source: pa.NativeFile, at: int) -> tuple[int | None, int, bytes, int]:
    source.seek(at)
    doc_id, n_bytes, size, check = _head(source.read(_HEAD.size))
    data = source.read(size)
    if len(data) != size or zlib.crc32(data) != check:
        raise ValueError(f"the member at byte {at} is damaged")
    return doc_id, n_bytes, data, at + _HEAD.size + size


def _next_head(source: pa.NativeFile, start: int, size: int, step: int = 1 << 20) -> int | None:
    """The first byte from ``start`` on where a member's header stands."""
    at = start
    while at < size:
        source.seek(at)
        data = source.read(step + _HEAD.size)
        found = data.find(_MARK)
        while 0 <= found < step:
            try:
                source.seek(at + found)
                _head(source.read(_HEAD.size))
                return at + found
            except (ValueError, struct.error):
                found = data.find(_MARK, found + 1)
        at += step
    return None


class ArchiveSource(DataSource):
    """``format("media_archive")`` with the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # small pieces, so that very long texts do not meet in memory
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            media, sizes = [], []
            for text in part.column(1):
                data, size = payload(text.as_py())
                media.append(encode_png(data))
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def write_archive(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Stores every text of ``docs`` as a media member under ``path``."""
    docs.sparkSession.dataSource.register(ArchiveSource)
    media = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")
    media.write.format("media_archive").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, file, offset, media, error of every member under ``path``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("path", path).option("range_bytes", str(range_bytes)).load()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media, error in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), batch.column("error").to_pylist(), strict=True):
            if error is not None:
                raise OSError(f"unreadable member: {error}")
            stored = media.as_py()
            samples = decode_png(stored)
            data = samples.tobytes()
            light = np.bincount(samples.reshape(-1) >> 5, minlength=8)
            feature = f"{samples.shape[1]}x{samples.shape[0]} mean={samples.mean():.3f} std={samples.std():.3f} light=" + ",".join(map(str, light.tolist()))
            rows.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def media_features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stores all texts, reads them back and describes them: the columns of FEATURES.

    Without a ``path`` the archive is only a step on the way: it is deleted once the features are written.
    """
    spark = docs.sparkSession
    folder = path or f"{shared_folder(spark)}/corridora-media-{uuid.uuid4().hex}"
    write_archive(docs, folder)
    found = read_archive(spark, folder).mapInArrow(_features, FEATURES)
    if path is not None:
        return found
    found = materialize(found, "features")
    store, place = _store(folder)
    store.delete_dir(place)
    return found
