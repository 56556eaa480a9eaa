"""Shapes of several parts with holes: containment, borders, integrals and inner points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metrosift.functions import shapes
from metrosift.operators import graph, joins, spatial, zones
from metrosift.session import stage

SCHEMA = f"polygon_id long, shape {shapes.SHAPE}"


def box(a, b, c, d):
    return [(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d))]


def test_containment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    kinds, points = [], []
    for i in range(40):
        x, y, s = rng.randrange(50), rng.randrange(50), 4 * rng.randrange(1, 8)
        # an outline with two holes, and a far small part with one
        kinds.append((i, [[(x, y, x + s, y + s), (x + s / 4, y + s / 4, x + s / 2, y + s / 2), (x + s / 2, y + 3 * s / 4, x + 3 * s / 4, y + s - 0.5)],
                          [(x + 200, y, x + 204, y + 4), (x + 201, y + 1, x + 202, y + 2)]]))
    kinds += [(90, []), (91, None)]
    points = [(i, rng.randrange(0, 120) / 2, rng.randrange(0, 120) / 2) for i in range(250)]
    points += [(500 + i, 200 + rng.randrange(0, 100) / 2, rng.randrange(0, 100) / 2) for i in range(150)] + [(900, None, 1.0)]
    points += [(1000 + i, 7.5, 7.5) for i in range(200)]  # one location on many rows

    def inside(px, py, shape):
        strictly = lambda r: r[0] < px < r[2] and r[1] < py < r[3]
        within = lambda r: r[0] <= px <= r[2] and r[1] <= py <= r[3]
        return any(strictly(part[0]) and not any(map(within, part[1:])) for part in shape or [])

    table = spark.createDataFrame([(i, s and [[box(*r) for r in part] for part in s]) for i, s in kinds], SCHEMA)
    df = spark.createDataFrame(points, "point_id long, x double, y double").withColumn("more", F.create_map(F.lit("a"), F.lit(1)))
    want = {(p, i) for p, x, y in points if x is not None for i, s in kinds if inside(x, y, s)}
    for small in (True, False):
        if not small:
            for module in (joins, spatial):
                monkeypatch.setattr(module, "fits", lambda *a, **k: False)
            monkeypatch.setattr(joins, "ROWS_PER_TASK", 20)
        assert {tuple(r) for r in spatial.points_in_polygons(df, table).collect()} == want
        found = spatial.assign_points(df, table)
        assert found.columns == ["point_id", "x", "y", "more", "polygon_id"]
        assert {r["point_id"]: r["polygon_id"] for r in found.collect()} == {
            p: min((i for q, i in want if q == p), default=None) for p, _, _ in points}


def test_border_distance_counts_all_rings(spark):
    """Near a hole, near the outline, near another part: all are off limits; the border itself is covered but too near."""
    boundary = spark.createDataFrame([(1, [[box(0, 0, 100, 100), box(40, 40, 60, 60)], [box(103, 0, 120, 20)]])], SCHEMA)
    points = [("a", 20.0, 20.0), ("b", 37.0, 50.0), ("c", 50.0, 50.0), ("d", 97.0, 50.0), ("e", 92.0, 10.0), ("f", 98.5, 10.0), ("g", 111.0, 10.0), ("h", 0.0, 50.0)]
    df = spark.createDataFrame(points, "node string, x double, y double")
    assert {r["node"] for r in spatial.off_border(df, boundary, 5.0, "node").collect()} == {"a", "e", "g"}
    ends = spark.createDataFrame([(f"{n}{i}", f"e{n}{i}", x, y) for n, x, y in points for i in range(3)], "end_id string, edge_id string, x double, y double")
    kept = graph.endpoint_junctions(ends, 1.0, boundary)
    assert {(r["x"], r["edges"]) for r in kept.collect()} == {(20.0, 3), (92.0, 3), (111.0, 3)}


def all_within(placed):
    within = F.exists("shape", lambda part: shapes.inside_part(F.col("lon"), F.col("lat"), part))
    return placed.where(~F.coalesce(within, F.lit(False))).isEmpty()


def test_integrals_and_inner_points(spark):
    far = 4e6  # digits must hold far from the origin
    table = spark.createDataFrame([
        (1, [[box(0, 0, 4, 2)]]), (2, [[box(0, 0, 4, 2)[::-1]]]), (3, [[box(0, 0, 10, 10), box(0, 0, 10, 9.0)]]),
        (4, [[box(far, far, far + 2, far + 2)], [box(far + 10, far, far + 12, far + 2)]]),
        (5, [[[(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)]]]), (6, [[[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]]), (7, []), (8, None),
        (9, [[box(0, 0, 8, 8), box(1, 1, 7, 7)]])], SCHEMA)
    found = {r["polygon_id"]: r for r in zones.zone_points(table, "polygon_id").collect()}
    area = {k: r["area"] for k, r in found.items()}
    assert [area[k] for k in (1, 2, 3, 4, 5, 6, 7, 9)] == pytest.approx([8, 8, 10, 8, 4.5, 0, 0, 28]) and area[8] is None
    centre = {k: (r["centroid_lon"], r["centroid_lat"]) for k, r in found.items()}
    assert centre[1] == centre[2] == (2, 1) and centre[3] == pytest.approx((5, 9.5)) and centre[4] == pytest.approx((far + 6, far + 1))
    assert centre[5] == pytest.approx((1, 1)) and centre[6] == centre[7] == centre[8] == (None, None) and centre[9] == pytest.approx((4, 4))
    assert all(found[k]["lon"] is None for k in (6, 7, 8))
    assert all_within(stage(zones.zone_points(table.where("polygon_id NOT IN (3, 6, 7, 8)"), "polygon_id")))


def test_inner_points_of_odd_shapes(spark):
    rng = random.Random(12)

    def star(cx, cy):
        turns = sorted(rng.uniform(0, 6.283) for _ in range(rng.randrange(5, 30)))
        return [(cx + (r := rng.uniform(1, 9)) * math.cos(a), cy + r * math.sin(a)) for a in turns]

    rows = []
    for i in range(60):
        rows.append((i, [[star(0, 0)], [star(40, 5)]]))
    assert all_within(stage(zones.zone_points(spark.createDataFrame(rows, SCHEMA), "polygon_id")))


def test_samples_keep_out_of_holes_and_on_borders(spark):
    holed = spark.createDataFrame([(1, [[box(0, 0, 10, 10), box(1, 1, 9, 9)], [box(20, 0, 21, 1)]])], SCHEMA)
    got = spatial.sample_in_polygons(holed, 16, "s").collect()
    assert len(got) == 16 and all((not (1 < r.x < 9 and 1 < r.y < 9)) and (r.x <= 10 or r.x >= 20) for r in got)
    on = F.array(*[F.lit(v) for v in (0.0, 1.0, 0.5)])
    edge = spark.range(1).select(shapes.covered_by_part(on[0], on[2], shapes.shape_of_ring(F.from_json(
        F.lit('[{"x":0,"y":0},{"x":1,"y":0},{"x":1,"y":1},{"x":0,"y":1}]'), shapes.RING))[0]).alias("c"))
    assert edge.first()["c"]


def test_weighted_origin_and_local_miles(spark):
    table = spark.createDataFrame([(1, [[box(-71.5, 41.5, -71.4, 41.6)]], 3.0), (2, [[box(-71.3, 41.7, -71.2, 41.8)]], 1.0), (3, None, 5.0)],
                                  "zone_id long, shape " + shapes.SHAPE + ", produced double")
    found = {r["zone_id"]: r for r in zones.local_zones(table, "produced").collect()}
    assert (found[1]["origin_lon"], found[1]["origin_lat"]) == pytest.approx((-71.4, 41.6))
    assert found[3]["x_miles"] is None
    back = stage(zones.local_zones(table, "produced")).select("zone_id", "lon", "lat", zones.degrees_of(
        *[F.col(c) for c in ("x_miles", "y_miles", "origin_lon", "origin_lat")]).alias("b")).where("zone_id < 3").collect()
    assert all((r["b"]["lon"], r["b"]["lat"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-6) for r in back)
    none = zones.weighted_origin(spark.createDataFrame([], "lon double, lat double, w double"), "w").first()
    assert none["origin_lon"] is None and none["total_weight"] is None
