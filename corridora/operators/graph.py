"""Weighted shortest paths on layered grids, portals and connected components."""

from __future__ import annotations

import heapq
import math
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut, grown, release

if TYPE_CHECKING:
    import pandas as pd

ROOM_COST, WALL_COST, STAIR_FEET = 3.2, 1.5, 220.0


def enter_cost(pub: Column | str, near_wall: Column | str) -> Column:
    """Cost of a cell: public or not, near a wall or not."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(pub), 1.0).otherwise(ROOM_COST) * F.when(c(near_wall), WALL_COST).otherwise(1.0)


def grid_edges(cells: DataFrame) -> DataFrame:
    """cells (floor, r, c, walk, pub, near_wall, east, south) to legal steps (floor, a_r, a_c, b_r, b_c, w).

    ``east`` and ``south`` tell whether the step to the next cell is open. A diagonal needs all four
    orthogonal steps around its corner. Every step is there in both directions.
    """
    me = cells.where("walk").select("floor", "r", "c", "east", "south", enter_cost("pub", "near_wall").alias("cost"))
    at = lambda dr, dc, p: me.select("floor", (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("cost").alias(f"{p}_cost"), F.col("east").alias(f"{p}_east"), F.col("south").alias(f"{p}_south"))
    # joins by cell; each brings one neighbour next to its cell
    wide = me.join(at(0, 1, "e"), ["floor", "r", "c"], "left").join(at(1, 0, "s"), ["floor", "r", "c"], "left").join(at(1, 1, "d"), ["floor", "r", "c"], "left")
    box = F.col("east") & F.col("south") & F.col("e_south") & F.col("s_east")
    half = lambda a, b, k: F.lit(k) * 0.5 * (F.col(a) + F.col(b))
    cell = lambda dr, dc: (F.col("r") + dr, F.col("c") + dc)

    def step(ok: Column, a: tuple, b: tuple, w: Column) -> Column:
        return F.when(ok & w.isNotNull(), F.struct(a[0].alias("a_r"), a[1].alias("a_c"), b[0].alias("b_r"), b[1].alias("b_c"), w.alias("w")))

    steps = F.array(
        step(F.col("east"), cell(0, 0), cell(0, 1), half("cost", "e_cost", 1.0)), step(F.col("south"), cell(0, 0), cell(1, 0), half("cost", "s_cost", 1.0)),
        step(box, cell(0, 0), cell(1, 1), half("cost", "d_cost", math.sqrt(2))), step(box, cell(0, 1), cell(1, 0), half("e_cost", "s_cost", math.sqrt(2))),
    )
    one = wide.select("floor", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("floor", "s.*")
    return one.union(one.select("floor", F.col("b_r").alias("a_r"), F.col("b_c").alias("a_c"), F.col("a_r").alias("b_r"), F.col("a_c").alias("b_c"), "w"))


def shortest(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(a, b, w) and (src, node) to (src, node, dist, prev): frontier relaxation as joins.

    Each round relaxes only nodes that became nearer. For large sparse graphs; each round's lineage is cut.
    """
    edges = cut(edges)
    dist = cut(sources.select("src", "node", F.lit(0.0).alias("dist"), F.lit(None).cast(dict(edges.dtypes)["a"]).alias("prev")))
    frontier, both = dist, None
    for _ in range(max_rounds):
        reached = frontier.join(edges, F.col("node") == F.col("a")).select("src", F.col("b").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("a").alias("prev"))
        best = reached.groupBy("src", "node").agg(F.min(F.struct("dist", "prev")).alias("m")).select("src", "node", F.col("m.dist").alias("nd"), F.col("m.prev").alias("np"))
        both = cut(dist.join(best, ["src", "node"], "full_outer"), *([both] if both is not None else []))
        nearer = F.col("nd").isNotNull() & (F.col("dist").isNull() | (F.col("nd") < F.col("dist")))
        frontier = both.where(nearer).select("src", "node", F.col("nd").alias("dist"), F.col("np").alias("prev"))
        dist = both.select("src", "node", F.when(nearer, F.col("nd")).otherwise(F.col("dist")).alias("dist"), F.when(nearer, F.col("np")).otherwise(F.col("prev")).alias("prev"))
        if frontier.isEmpty():
            return dist
    raise RuntimeError(f"distances still shrink after {max_rounds} rounds")


def _field(key: tuple, steps: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    """One floor's distances from each of its sources: a heap over the floor's steps."""
    import pandas as pd

    reach: dict[tuple, list] = {}
    for ar, ac, br, bc, w in steps[["a_r", "a_c", "b_r", "b_c", "w"]].itertuples(index=False):
        reach.setdefault((ar, ac), []).append(((br, bc), w))
    out = []
    for src, group in seeds.groupby("src", sort=True):
        dist = {(r, c): 0.0 for r, c in group[["r", "c"]].itertuples(index=False)}
        prev: dict[tuple, tuple] = {}
        heap = [(0.0, cell) for cell in sorted(dist)]
        while heap:
            d, cell = heapq.heappop(heap)
            if d > dist[cell]:
                continue
            for other, w in reach.get(cell, ()):
                if d + w < dist.get(other, math.inf):
                    dist[other], prev[other] = d + w, cell
                    heapq.heappush(heap, (d + w, other))
        out += [(key[0], src, r, c, d, *prev.get((r, c), (None, None))) for (r, c), d in dist.items()]
    return pd.DataFrame(out, columns=["floor", "src", "r", "c", "dist", "prev_r", "prev_c"]).astype({"prev_r": "Int64", "prev_c": "Int64"})


def distance_fields(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(floor, src, r, c, dist, prev_r, prev_c) from sources (src, floor, r, c).

    A floor is one task: its grid is bounded by the building, floors are many. Sources of a floor
    that share a ``src`` are one multi-source field. Build once per grid and keep it as a table.
    """
    walkable = sources.join(cells.where("walk").select("floor", "r", "c"), ["floor", "r", "c"], "left_semi")
    schema = "floor string, src string, r int, c int, dist double, prev_r long, prev_c long"
    seeds = walkable.select(F.col("floor").alias("on_floor"), "src", F.col("r").alias("r"), F.col("c").alias("c"))
    return grid_edges(cells).groupBy("floor").cogroup(seeds.groupBy("on_floor")).applyInPandas(_field, schema)


def landing_fields(cells: DataFrame, landings: DataFrame, path: str, version: str) -> DataFrame:
    """The distance fields of all landings (end_id, floor, r, c) as a table under ``path``, built once a
    ``version`` of grids and links and read ever after; start fields of single routes are not kept.

    A new version is another folder; an old one is dropped by :func:`drop_fields`.
    """
    spark = cells.sparkSession
    place = f"{path.rstrip('/')}/version={version}"
    if not _exists(spark, f"{place}/_SUCCESS"):
        distance_fields(cells, landings.select(F.col("end_id").alias("src"), "floor", "r", "c")).write.mode("overwrite").partitionBy("floor").parquet(place)
    return spark.read.schema("src string, r int, c int, dist double, prev_r long, prev_c long, floor string").parquet(place)


def drop_fields(spark: SparkSession, path: str, version: str) -> None:
    """Deletes the kept fields of a version, when grids or links have changed."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={version}")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def trace(fields: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (floor, src, r, c) to their paths (floor, src, r, c, path): previous cells back to the source.

    One field is one task, as it was built.
    """

    def follow(key, field, ends):
        import pandas as pd

        prev = {(r, c): (pr, pc) for r, c, pr, pc in field[["r", "c", "prev_r", "prev_c"]].itertuples(index=False) if not pd.isna(pr)}
        known = set(field[["r", "c"]].itertuples(index=False, name=None))
        out = []
        for r, c in ends[["r", "c"]].itertuples(index=False, name=None):
            path = [(r, c)] if (r, c) in known else []
            while path and path[-1] in prev:
                if len(path) > len(known):
                    raise ValueError(f"the previous cells of {path[0]} run in a circle")
                path.append(tuple(map(int, prev[path[-1]])))
            out.append((key[0], key[1], r, c, [{"r": int(a), "c": int(b)} for a, b in reversed(path)]))
        return pd.DataFrame(out, columns=["floor", "src", "r", "c", "path"])

    schema = "floor string, src string, r int, c int, path array<struct<r:int,c:int>>"
    ends = targets.select(F.col("floor").alias("on_floor"), F.col("src").alias("of"), F.col("r").alias("r"), F.col("c").alias("c"))
    return fields.groupBy("floor", "src").cogroup(ends.groupBy("on_floor", "of")).applyInPandas(follow, schema)


def landings(portals: DataFrame) -> DataFrame:
    """portals (link_id, floor, r, c) with the ``end_id`` by which fields name them."""
    return portals.select(F.concat_ws("|", F.lit("p"), "link_id", "floor").alias("end_id"), "link_id", "floor", "r", "c")


def components(nodes: DataFrame, edges: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """(id) and (a, b) to (id, component): the smallest id reachable.

    Every node has a parent, itself at first. In a round each edge brings its end's grandparent to the
    other end and to that one's parent (so whole trees hook onto smaller ones), and every node takes its
    grandparent; parents only get smaller, so the rounds grow with the logarithm of the longest path.
    A round is joins and minima by id with partial aggregation, so a node with many edges is nobody's
    task alone. Raises an error beyond ``max_rounds``.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("f"), F.col("id").alias("gf")).distinct())
    for _ in range(max_rounds):
        near = both.join(grown(labels.select(F.col("id").alias("b"), "gf")), "b").groupBy(F.col("a").alias("id")).agg(F.min("gf").alias("m"))
        told = near.join(grown(labels), "id").select(F.explode(F.array("id", "f")).alias("id"), "m").groupBy("id").agg(F.min("m").alias("m"))
        new = cut(labels.join(grown(told), "id", "left").select("id", F.col("gf").alias("old"), F.least("f", "gf", "m").alias("f")), labels)
        up = new.select(F.col("id").alias("f"), F.col("f").alias("gf"))
        labels = cut(new.join(grown(up), "f", "left").select("id", "f", F.coalesce("gf", "f").alias("gf"), "old"), new)
        if labels.where("gf < old or f != gf").isEmpty():
            release(both)
            out = labels.select("id", F.col("gf").alias("component"))
            out._scratch = labels._scratch
            return out
    raise RuntimeError(f"components did not end within {max_rounds} rounds")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids of the largest component; the one with the smallest id on ties."""
    found = components(nodes, edges)
    best = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    return found.join(F.broadcast(best), "component").select("id")


def keep_networks(found: DataFrame, holds_room: DataFrame, share: float = 0.06) -> DataFrame:
    """(id, component) of components with ``share`` of all cells or more, or with a room (id)."""
    n = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    rooms = found.join(holds_room, "id", "left_semi").select("component").distinct().withColumn("room", F.lit(True))
    kept = n.join(F.broadcast(total)).join(rooms, "component", "left").where(F.col("room") | (F.col("n") >= share * F.col("total"))).select("component")
    return found.join(kept, "component", "left_semi")
