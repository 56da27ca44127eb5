"""Floor files, links, rooms, walls and bit-plane grids as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import pairs
from ..operators import raster, spatial

POINT = "struct<x:double,y:double,kind:string,label:string,aliases:array<string>,poiType:string,source:string,confidence:double>"
FLOOR = f"id string, label string, image struct<w:int,h:int>, points map<string,{POINT}>, edges array<struct<a:string,b:string,auto:boolean>>, entrances array<string>"
LINKS = "id string, kind string, verified boolean, points map<string,string>"
PLACEMENTS = "floor string, scale double, rotationDeg double, tx double, ty double, verified boolean"
ROOMS = "floor string, w int, h int, rooms array<struct<id:string,label:string,kind:string,x:int,y:int,area:int,poly:array<int>>>, corridors array<struct<area:int,poly:array<int>>>, labels array<struct<label:string,kind:string,x:int,y:int>>"
GRID = "floor string, cols int, rows int, cell int, walk string, pub string, east string, south string, doors array<array<int>>"
ORDER = ("lower", "main", "upper")


def read_json(spark: SparkSession, path: str, schema: str, *, lines: bool = False) -> DataFrame:
    """One JSON document or array a file, or one document a line; what does not fit the schema is null."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def floor_index(floor: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), F.col(floor) if isinstance(floor, str) else floor) - 1


def points(floors: DataFrame) -> DataFrame:
    """floor, floor_idx, ord, id, x, y, kind, label, aliases, poi_type, source, confidence.

    ``ord``: ids that read as whole numbers first, ascending, then the file's order.
    """
    listed = floors.select(F.col("id").alias("floor"), F.posexplode(F.map_entries("points")).alias("at", "e"))
    number = F.when(F.col("e.key").rlike(r"^(0|[1-9]\d{0,8})$"), F.col("e.key").cast("int"))
    ord_ = F.coalesce(number.cast("long"), F.col("at") + F.lit(2**32))
    return listed.select("floor", floor_index("floor").alias("floor_idx"), ord_.alias("ord"), F.col("e.key").alias("id"), *[F.col(f"e.value.{c}").alias(a) for c, a in (("x", "x"), ("y", "y"), ("kind", "kind"), ("label", "label"), ("aliases", "aliases"), ("poiType", "poi_type"), ("source", "source"), ("confidence", "confidence"))])


def edges(floors: DataFrame) -> DataFrame:
    return floors.select(F.col("id").alias("floor"), F.explode("edges").alias("e")).select("floor", "e.a", "e.b", F.coalesce("e.auto", F.lit(False)).alias("auto"))


def link_ends(links: DataFrame, point_table: DataFrame) -> DataFrame:
    """(link_id, kind, verified, floor, id, x, y) of every end that exists."""
    ends = links.select(F.col("id").alias("link_id"), "kind", "verified", F.explode(F.map_entries("points")).alias("e")).select("link_id", "kind", "verified", F.col("e.key").alias("floor"), F.col("e.value").alias("id"))
    return ends.join(point_table.select("floor", "id", "x", "y"), ["floor", "id"])


def snapped_ends(ends: DataFrame, cells: DataFrame, cell_size: float) -> DataFrame:
    """Link ends (link_id, floor, id, x, y, ...) with the walkable cell (r, c) each stands on or nearest to, public ones first."""
    named = ends.withColumn("place_id", F.struct("link_id", "floor"))
    return named.join(spatial.snap(named.select("place_id", "floor", "x", "y"), cells, cell_size), "place_id").drop("place_id")


def decoded_grid(grids: DataFrame) -> DataFrame:
    """(floor, r, c, walk, pub, east, south, near_wall, net) of bit-plane grids, the derived planes included."""
    cells = grid_cells(grids)
    derived = raster.derived_planes(cells.withColumnRenamed("floor", "layer"))
    return derived.withColumnRenamed("layer", "floor").select("floor", "r", "c", "walk", "pub", "east", "south", "near_wall", "net")


def traced_rooms(point_table: DataFrame) -> DataFrame:
    """(floor, point_id, label, x, y) of the room points that a floor file holds."""
    return point_table.where("kind = 'room'").select("floor", F.col("id").alias("point_id"), "label", "x", "y")


def labelled_points(point_table: DataFrame) -> DataFrame:
    """(floor, id, name, kind, x, y) of points with a place in the world: rooms and landmarks, by label or id."""
    return point_table.where("kind in ('room', 'landmark')").select("floor", "id", F.coalesce("label", "id").alias("name"), "kind", "x", "y")


WALLS = "floor string, w int, h int, quant int, pxPerFoot double, boxes array<int>, outlines array<array<int>>, footprint array<struct<outer:array<int>,holes:array<array<int>>>>"
VERDICT = "array<struct<text:string,x:double,y:double,why:string>>"


def wall_boxes(files: DataFrame) -> DataFrame:
    """(layer, x, y, w, h) of wall files, in cells."""
    i = F.sequence(F.lit(0), F.floor(F.size("boxes") / 4).cast("int") - 1)
    box = F.transform(i, lambda k: F.struct(*[F.get("boxes", 4 * k + j).alias(n) for j, n in enumerate("xywh")]))
    return files.where(F.size("boxes") >= 4).select(F.col("floor").alias("layer"), F.explode(box).alias("b")).select("layer", "b.*")


def decisions(texts: DataFrame, value: str = "value") -> DataFrame:
    """Review decisions as JSON (floor, value) to (floor, verdict, text, x, y, why); no rows where nothing is said."""
    d = texts.select("floor", F.from_json(value, f"reject {VERDICT}, place {VERDICT}").alias("d"))
    one = lambda verdict: d.select("floor", F.lit(verdict).alias("verdict"), F.explode(f"d.{verdict}").alias("v"))
    return one("reject").unionByName(one("place")).select("floor", "verdict", "v.*")


def rooms_file(room_table: DataFrame) -> DataFrame:
    """(floor, value): each floor's rooms (id, label, kind, x, y, area, ring) as the compact JSON of a room file."""
    flat = F.flatten(F.transform("ring", lambda p: F.array(F.round(p["x"]).cast("int"), F.round(p["y"]).cast("int"))))
    row = F.struct("id", "label", "kind", *[F.round(c).cast("int").alias(c) for c in ("x", "y", "area")], flat.alias("poly"))
    listed = room_table.groupBy("floor").agg(F.sort_array(F.collect_list(row)).alias("rooms"))
    return listed.select("floor", F.to_json(F.struct("floor", "rooms")).alias("value"))


def report_file(buckets: DataFrame) -> DataFrame:
    """(floor, value): reconciled reads (floor, bucket, text, x, y, conf, was) as the JSON of a scan report."""
    row = F.struct("text", "x", "y", "conf", "was")
    of = lambda name: F.sort_array(F.collect_list(F.when(F.col("bucket") == name, row))).alias(name)
    g = buckets.groupBy("floor").agg(of("corrected"), of("found"), of("unread"), F.count_if(F.col("bucket") == "confirmed").alias("confirmed"))
    return g.select("floor", F.to_json(F.struct("corrected", "found", "unread", "confirmed")).alias("value"))


def rooms(files: DataFrame) -> DataFrame:
    """(floor, id, label, kind, x, y, area, ring)."""
    return files.select("floor", F.explode("rooms").alias("r")).select("floor", "r.id", "r.label", "r.kind", "r.x", "r.y", "r.area", pairs("r.poly").alias("ring"))


def bit(packed: Column | str, i: Column) -> Column:
    """Bit ``i`` of base64 text, the most significant bit of each byte first."""
    raw = F.unbase64(F.col(packed) if isinstance(packed, str) else packed)
    byte = F.conv(F.hex(F.substring(raw, F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (7 - F.pmod(i, F.lit(8))).cast("int")) == 1


def grid_cells(grids: DataFrame) -> DataFrame:
    """(floor, r, c, walk, pub, east, south) of bit-plane grids.

    A row of cells is unpacked at once from its own bytes, so no cell carries the whole plane.
    """
    rows = grids.select("floor", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), *[F.unbase64(p).alias(p) for p in ("walk", "pub", "east", "south")])
    start = F.col("r") * F.col("cols")
    first = F.floor(start / 8).cast("int")
    many = F.floor((start + F.col("cols") - 1) / 8).cast("int") - first + 1
    cut = rows.withColumns({p: F.hex(F.substring(p, first + 1, many)) for p in ("walk", "pub", "east", "south")}).withColumn("off", F.pmod(start, F.lit(8)))
    cells = cut.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    at = F.col("off") + F.col("c")

    def plane(p: str) -> Column:
        nibble = F.conv(F.substring(F.col(p), F.floor(at / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
        return (F.getbit(nibble, (3 - F.pmod(at, F.lit(4))).cast("int")) == 1).alias(p)

    return cells.select("floor", "r", "c", *[plane(p) for p in ("walk", "pub", "east", "south")])


def pack_plane(cells: DataFrame, flag: str) -> DataFrame:
    """(floor, i, flag) to (floor, bits): base64 of the flags in order of i, first bit highest.

    Bytes are packed in a distributed step; one floor's plane then is one short string.
    """
    weight = F.pow(F.lit(2.0), 7 - F.pmod(F.col("i"), F.lit(8))).cast("int")
    byte = cells.groupBy("floor", F.floor(F.col("i") / 8).alias("b")).agg(F.sum(F.when(F.col(flag), weight).otherwise(0)).alias("v"))
    pair = F.lpad(F.conv(F.col("v").cast("string"), 10, 16), 2, "0")
    listed = byte.groupBy("floor").agg(F.sort_array(F.collect_list(F.struct("b", pair.alias("h")))).alias("x"))
    return listed.select("floor", F.base64(F.unhex(F.array_join(F.transform("x", lambda s: s["h"]), ""))).alias("bits"))
