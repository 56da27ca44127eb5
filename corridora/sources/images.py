"""Page images and results kept by content: binary files, digests, work done once per digest."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(name, length, content, sha1) of image files; the content is only read where it is selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content", F.sha1("content").alias("sha1"))


def decode_grey(content: bytes) -> np.ndarray:
    """The rows of samples of an 8-bit greyscale PNG, whatever filters its lines have."""
    at, size, data = 8, (0, 0), []
    while at < len(content):
        length, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            *size, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale images without interlacing are read")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    width, height = size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    out = np.zeros((height, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y, (rule, line) in enumerate(zip(lines[:, 0], lines[:, 1:], strict=True)):
        if rule == 1:  # the sample before: a running sum
            out[y] = np.cumsum(line, dtype=np.uint64).astype(np.uint8)
        elif rule == 2:  # the sample above
            out[y] = line + above
        elif rule in (3, 4):  # the mean of both, or the nearest of three
            left = corner = 0
            for x in range(width):
                up = int(above[x])
                if rule == 3:
                    guess = (left + up) // 2
                else:
                    whole = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(whole - v))
                left, corner = (int(line[x]) + guess) & 255, up
                out[y, x] = left
        else:
            out[y] = line
        above = out[y]
    return out


def pixel_rows(pages: DataFrame) -> DataFrame:
    """pages (name, content) to (name, r, grey): one row of samples (binary) a row of pixels."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grey = decode_grey(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grey), pa.string()), pa.array(np.arange(len(grey), dtype=np.int32)), pa.array([row.tobytes() for row in grey], pa.binary())], names=["name", "r", "grey"])

    return pages.select("name", "content").mapInArrow(read, "name string, r int, grey binary")


def ink(rows: DataFrame, dark: int = 170) -> DataFrame:
    """(name, r, grey) to the cells (layer, r, c) darker than ``dark``."""
    sample = F.conv(F.substring(F.hex("grey"), 2 * F.col("c") + 1, F.lit(2)), 16, 10).cast("int")
    cells = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.octet_length("grey") - 1)))
    return cells.where(sample < dark).select(F.col("name").alias("layer"), "r", "c")


def once_per_digest(work: DataFrame, cache: DataFrame, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results of all rows, new cache rows): ``run`` sees one row of each digest (sha1, ...) that the
    cache (sha1, result) lacks."""
    lacking = work.join(cache.select("sha1"), "sha1", "left_anti").dropDuplicates(["sha1"])
    fresh = run(lacking).select("sha1", "result")
    return work.join(cache.select("sha1", "result").unionByName(fresh), "sha1"), fresh
