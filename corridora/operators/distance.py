"""Exact Euclidean distances between cells: for each cell the nearest one of a set, in two grouped passes.

The first pass looks along rows: a row's set cells are shared out to strips of columns, each with the last one
before and the first one after the strip. The second pass takes a strip: along every column the rows' distances
make parabolas, whose lower envelope names the nearest row of each cell, for all columns of the strip at once.
Both passes are whatever the distances are, and a strip's arrays grow with its height alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["layer", "r", "c"]
#: Columns of a strip.
STRIP = 128
_FAR = np.int64(1) << 60


def lower_envelope(height: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each column and asked row x, the place of the row q with the least ``height[q] + (x - q)**2``.

    ``height``: (rows, columns), ``_FAR`` for no parabola; ``rows`` and ``asked`` ascend. Integers throughout;
    the smaller row wins a tie; -1 where a column has no parabola.
    """
    n, m = height.shape
    columns = np.arange(m)
    stack = np.zeros((n, m), np.int32)  # places of the envelope's parabolas, and from which row on each is the least
    since = np.zeros((n, m), np.int64)
    top = np.full(m, -1)
    for q in range(n):
        live = columns[height[q] < _FAR]
        start = np.full(m, -_FAR)
        while len(live):
            some = top[live] >= 0
            waits = live[some]
            if not len(waits):
                break
            v = stack[top[waits], waits]
            a, b = rows[q], rows[v]
            wins = (height[q, waits] + a * a - height[v, waits] - b * b) // (2 * (a - b)) + 1
            hidden = wins <= since[top[waits], waits]
            start[waits] = np.where(hidden, -_FAR, wins)
            top[waits[hidden]] -= 1
            live = waits[hidden]
        live = columns[height[q] < _FAR]
        top[live] += 1
        stack[top[live], live], since[top[live], live] = q, start[live]
    out = np.full((len(asked), m), -1, np.int32)
    for i in range(len(asked) - 1, -1, -1):
        live = columns[top >= 0]
        while len(live):
            late = since[top[live], live] > asked[i]
            live = live[late]
            top[live] -= 1
        live = columns[top >= 0]
        out[i, live] = stack[top[live], live]
    return out


_FOUND = pa.schema([("layer", pa.string()), ("r", pa.int64()), ("c", pa.int64()), ("near_r", pa.int64()), ("near_c", pa.int64()), ("square", pa.int64())])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (layer, strip, r, near, cells) of one strip to the nearest set cell of each of its cells."""
    table = pa.Table.from_batches(batches).sort_by("r")
    rows = table["r"].to_numpy()
    near, cells = (table[x].combine_chunks() for x in ("near", "cells"))
    has = np.flatnonzero(np.diff(near.offsets.to_numpy()) > 0)
    wants = np.flatnonzero(np.diff(cells.offsets.to_numpy()) > 0)
    if not len(has) or not len(wants):
        return
    at, lists = near.offsets.to_numpy(), near.values.to_numpy()
    columns = np.unique(cells.values.to_numpy()[cells.offsets.to_numpy()[0] : cells.offsets.to_numpy()[-1]])
    from_c = np.empty((len(has), len(columns)), np.int64)
    for i, q in enumerate(has):  # along the row: the middle between two set cells belongs to the smaller
        s = lists[at[q] : at[q + 1]]
        from_c[i] = s[np.searchsorted((s[1:] + s[:-1]) // 2, columns, side="left")] if len(s) > 1 else s[0]
    height = (columns - from_c) ** 2
    which = lower_envelope(height, rows[has], rows[wants])
    at, lists = cells.offsets.to_numpy(), cells.values.to_numpy()
    for i, q in enumerate(wants):
        c = lists[at[q] : at[q + 1]]
        place = np.searchsorted(columns, c)
        best = which[i, place]
        to_r, to_c = rows[has][best], from_c[best, place]
        n = len(c)
        yield pa.RecordBatch.from_arrays([pa.array([table["layer"][0].as_py()] * n, pa.string()), pa.array(np.full(n, rows[q])), pa.array(c), pa.array(to_r), pa.array(to_c), pa.array((c - to_c) ** 2 + (rows[q] - to_r) ** 2)], schema=_FOUND)


def nearest_cells(cells: DataFrame, set_cells: DataFrame) -> DataFrame:
    """(layer, r, c, near_r, near_c, square): for each of ``cells`` the nearest one of its layer's ``set_cells``.

    Ties go to the smaller row, then to the smaller column. Cells of layers without set cells are left out.
    """
    kind = cells.schema["layer"].dataType
    name = F.to_json(F.struct("layer")).alias("layer")  # any layer as a text that names it
    place = [name, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")]
    wanted = cells.select(*place).distinct().groupBy("layer", "r", F.floor(F.col("c") / STRIP).alias("strip")).agg(F.sort_array(F.collect_list("c")).alias("cells"))
    strips = wanted.groupBy("layer").agg(F.collect_set("strip").alias("strips"))
    rows = set_cells.select(*place).groupBy("layer", "r").agg(F.array_sort(F.collect_set("c")).alias("s"))
    low = F.col("strip") * STRIP
    inside = F.filter("s", lambda x: (x >= low) & (x < low + STRIP))
    before, after = F.filter("s", lambda x: x < low), F.filter("s", lambda x: x >= low + STRIP)
    near = F.concat(F.slice(before, F.greatest(F.size(before), F.lit(1)), F.lit(1)), inside, F.slice(after, F.lit(1), F.lit(1)))
    given = rows.join(strips, "layer").select("layer", "r", "s", F.explode("strips").alias("strip")).select("layer", "r", "strip", near.alias("near"))
    none = F.array().cast("array<long>")
    both = given.join(wanted, ["layer", "r", "strip"], "full_outer").select("layer", "strip", "r", F.coalesce("near", none).alias("near"), F.coalesce("cells", none).alias("cells"))
    found = both.groupBy("layer", "strip").applyInArrow(_strip, "layer string, r long, c long, near_r long, near_c long, square long")
    return found.withColumn("layer", F.from_json("layer", f"layer {kind.simpleString()}")["layer"])


def surroundings(mask: DataFrame) -> DataFrame:
    """Cells outside of a mask, by its layers, that have one of their four neighbours in it."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    moved = mask.select(*CELL, F.explode(steps).alias("s")).select("layer", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c")).distinct()
    return moved.join(mask.select(*CELL), CELL, "left_anti")


def distances(mask: DataFrame) -> DataFrame:
    """(layer, r, c, near_r, near_c, distance): each cell's nearest place outside of the mask; what lies around a page is outside."""
    found = nearest_cells(mask, surroundings(mask))
    return found.select(*CELL, "near_r", "near_c", F.sqrt(F.col("square").cast("double")).alias("distance"))


def poles(labelled: DataFrame) -> DataFrame:
    """(layer, component, r, c, distance): each component's cell farthest from what is not of the component, the
    first by row and column on ties."""
    own = labelled.select(F.struct("layer", "component").alias("layer"), "r", "c").distinct()
    deep = distances(own)
    best = deep.groupBy("layer").agg(F.min_by(F.struct("r", "c", "distance"), F.struct((-F.col("distance")).alias("d"), "r", "c")).alias("p"))
    return best.select("layer.layer", "layer.component", "p.*")
