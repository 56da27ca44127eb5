import math

from pyspark.sql import functions as F

from corridora.functions import geometry
from corridora.operators import alignment, raster, shapes


def test_rings_of_touching_squares(spark):
    mask = spark.createDataFrame([("m", r, c) for r, line in enumerate(["##.", "##.", "..#"]) for c, ch in enumerate(line) if ch == "#"], "layer string, r int, c int")
    found = shapes.rings(raster.boundary_edges(mask)).withColumn("area", F.abs(geometry.signed_area("ring"))).collect()
    assert sorted((len(r.ring), r.area) for r in found) == [(4, 1.0), (4, 4.0)]


def test_simplified_ring_stays_near(spark):
    circle = [{"x": 50 * math.cos(t / 20 * math.pi), "y": 50 * math.sin(t / 20 * math.pi)} for t in range(40)]
    row = spark.createDataFrame([(circle,), (None,)], "ring array<struct<x:double,y:double>>").select(shapes.simplify("ring", 3.0).alias("s")).collect()
    assert row[1].s is None and 4 < len(row[0].s) < 20 and all(abs(math.hypot(p.x, p.y) - 50) < 1e-9 for p in row[0].s)


def test_hole_owner_is_the_smallest_ring(spark):
    square = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    outers = spark.createDataFrame([(1, square(0, 100)), (2, square(10, 60)), (3, square(70, 90))], "poly_id int, ring array<struct<x:double,y:double>>")
    holes = spark.createDataFrame([(7, square(20, 30)), (8, square(92, 95))], "hole_id int, ring array<struct<x:double,y:double>>")
    assert {r.hole_id: r.poly_id for r in shapes.hole_owners(outers, holes).collect()} == {7: 2, 8: 1}


def test_nudge_keeps_the_fixed_floor(spark):
    schema = "floor string, scale double, rotation_deg double, tx double, ty double"
    placed = spark.createDataFrame([("main", 1.0, 0.0, 0.0, 0.0), ("upper", 1.0, 2.0, 3.0, 4.0)], schema).withColumn("verified", F.lit(True))
    moved = alignment.nudge(placed, spark.createDataFrame([("main", 1.0, 1.0, 1.0, 1.0), ("upper", -5.0, 1.0, 0.0, 0.0)], schema))
    got = {r.floor: r for r in moved.collect()}
    assert got["main"].scale == 1.0 and got["main"].verified and got["upper"].scale == 0.2 and not got["upper"].verified
    assert [r.floor for r in alignment.changed(placed, moved).collect()] == ["upper"]
    assert moved.where("floor = 'upper'").select(alignment.describe()).first()[0] == "upper: scale 0.2000, turned 3.00 degrees, moved by 3.0, 4.0"
    assert spark.range(1).select(alignment.elevation(F.lit(1.5), {0: 0.0, 1: 10.0, 2: 14.0})).first()[0] == 12.0


def test_lift_adds_risers(spark):
    points = spark.createDataFrame([("r", 0, 0, "main", 0.0, 0.0), ("r", 0, 1, "main", 3.0, 4.0), ("r", 0, 2, "main", 3.0, 4.0), ("r", 1, 3, "upper", 3.0, 4.0)], "route_id string, leg int, seq int, floor string, x double, y double")
    heights = spark.createDataFrame([("main", 0.0), ("upper", 11.0)], "floor string, z double")
    rows = shapes.lift(points, heights).orderBy("leg", "seq", "riser").collect()
    assert len(rows) == 13 and abs(rows[-1].cum - 16.0) < 1e-9 and rows[-1].z == 11.0
