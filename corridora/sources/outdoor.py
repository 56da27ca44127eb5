"""Map features: clipped scans, class lookup, clipping and labels."""

from __future__ import annotations

import math
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEET_A_DEGREE = 364_000.0
_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(_RING))])
_KINDS = {1: "point", 2: "line", 3: "polygon", 4: "points", 5: "lines", 6: "polygons"}


def read_overlapping(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose ``bbox`` struct overlaps (xmin, ymin, xmax, ymax); the comparisons reach the Parquet scan."""
    x0, y0, x1, y1 = box
    return spark.read.parquet(path).where((F.col("bbox.xmin") <= x1) & (F.col("bbox.xmax") >= x0) & (F.col("bbox.ymin") <= y1) & (F.col("bbox.ymax") >= y0))


def _wkb(data: memoryview, at: int, out: list) -> tuple[str, int]:
    """Appends a geometry's parts (lists of points) to ``out``; its kind, and where it ends."""
    order = "<" if data[at] == 1 else ">"
    kind = _KINDS.get(struct.unpack_from(order + "I", data, at + 1)[0])
    if kind is None:
        raise ValueError("only plane points, lines, polygons and their collections are read")
    at += 5

    def run(at: int, n: int) -> int:
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
        out.append([{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2], strict=True)])
        return at + 16 * n

    if kind == "point":
        return kind, run(at, 1)
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    if kind == "line":
        return kind, run(at, n)
    for _ in range(n):
        if kind == "polygon":
            at = run(at + 4, struct.unpack_from(order + "I", data, at)[0])
        else:
            _, at = _wkb(data, at, out)
    return kind, at


@F.arrow_udf(GEOMETRY)
def read_wkb(geometries: pa.Array) -> pa.Array:
    """Well-known binary to its kind and parts: a polygon's rings in order, a collection's parts one after another."""
    rows = []
    for g in geometries:
        if not g.is_valid:
            rows.append(None)
            continue
        parts: list = []
        kind, _ = _wkb(memoryview(g.as_py()), 0, parts)
        rows.append({"kind": kind, "parts": parts})
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    return pa.array(rows, pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(point)))]))


def to_feet(parts: Column | str, lon: float, lat: float) -> Column:
    """Parts in degrees to feet about (lon, lat): x to the east, y to the south."""
    p = F.col(parts) if isinstance(parts, str) else parts
    wide = FEET_A_DEGREE * math.cos(math.radians(lat))
    return F.transform(p, lambda run: F.transform(run, lambda q: F.struct(((q["x"] - lon) * wide).alias("x"), (-(q["y"] - lat) * FEET_A_DEGREE).alias("y"))))


def classify(features: DataFrame, kinds: DataFrame, default: str | None = None) -> DataFrame:
    """Adds ``kind`` from a small table (class, kind, rank); unknown classes drop out unless there is a default."""
    joined = features.join(kinds, "class", "left")
    return joined.withColumn("kind", F.coalesce("kind", F.lit(default))) if default else joined.where("kind is not null")


def draw_order(features: DataFrame) -> DataFrame:
    """By the kind's rank, the largest first."""
    return features.orderBy("rank", F.col("area").desc(), "id")


def longest_named(roads: DataFrame, least_feet: float = 250.0) -> DataFrame:
    """(name, x, y, feet): the middle of each name's longest piece, if it is long enough."""
    best = roads.where("name is not null").groupBy("name").agg(F.max_by(F.struct("x", "y", "feet"), F.struct("feet", "id")).alias("r"))
    return best.select("name", "r.*").where(F.col("feet") >= least_feet)


def largest_label(labels: DataFrame) -> DataFrame:
    """One row a text: that of the largest area, the first id on ties."""
    best = labels.groupBy("text").agg(F.min_by(F.struct("id", "x", "y", "area"), F.struct((-F.col("area")).alias("a"), "id")).alias("r"))
    return best.select("text", "r.*")
