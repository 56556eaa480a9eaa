"""Nearest searches look at few pairs, and the large paths give what the small ones do."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from metrosift.operators import fleet, graph, matching, spatial


def test_first_radius_holds_few_stations(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(spatial, "ONE_PASS_ROWS", 1000)
    stations = [(i, 10 + rng.random(), 20 + rng.random()) for i in range(3000)]
    tried, search = [], spatial._search_cells
    monkeypatch.setattr(spatial, "_search_cells", lambda places, radius, h: tried.append((radius, h)) or search(places, radius, h))
    table = spark.createDataFrame(stations, "station_id long, lat double, lon double")
    places = spark.createDataFrame([(i, 10 + rng.random(), 20 + rng.random()) for i in range(30)] + [(99, 50.0, 20.0)], "place_id long, lat double, lon double")
    found = rows(spatial.nearest_stations(places, table, 3, 100.0), "place_id", "nearness")
    assert found == [(i, n) for i in range(30) for n in (1, 2, 3)]
    radius, h = tried[0]
    meets = search(places.limit(1), radius, h).join(spatial._station_cells(table, h), ["_band", "_cell"]).count()
    assert meets < 1000  # before: all 3000


@pytest.mark.parametrize("few", [True, False])
def test_nearest_beyond_by_cells(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(spatial, "MATRIX_ROWS", 0)
    rng = random.Random(6)
    points = [(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(300)] + [(1000 + i, 3.0, 4.0) for i in range(50)] + [(7, 30.0, 30.0), (None, 1.0, 1.0)]
    places = [(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(40)] + [(90, 3.0, 4.0), (91, -20.0, 3.0), (92, 0.0, 0.0), (92, 0.0, 0.0), (93, None, 1.0)]
    got = spatial.nearest_beyond(spark.createDataFrame(places, "place_id long, place_x double, place_y double"),
                                 spark.createDataFrame(points, "point_id long, x double, y double"), 0.5, 0.75)
    want = set()
    for k, a, b in places:
        if a is not None:
            near = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, -1 if p is None else p) for p, x, y in points]
            want.add((k, min(n for n in near if n[0] >= 0.5)[1]))
    assert {(r["place_id"], -1 if r["point_id"] is None else r["point_id"]) for r in got.collect()} == want


@pytest.mark.parametrize("few", [True, False])
def test_nearest_feasible_by_cells(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(spatial, "MATRIX_ROWS", 0)
        monkeypatch.setattr(spatial, "MATRIX_LEFT", 7)
    rng = random.Random(7)
    vehicles = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9), "IDLE" if i % 4 else "CHARGING", rng.uniform(30, 70)) for i in range(200)]
    vehicles += [(500 + i, 1.0, 1.0, "IDLE", 60.0) for i in range(20)] + [(600, 20.0, 20.0, "IDLE", 900.0)]
    requests = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(60)]
    requests += [(80, 1.0, 1.0, 2.0, 2.0), (81, 50.0, 50.0, 0.0, 0.0), (82, 1.5, 1.0, 2.0, 2.0), (82, 1.5, 1.0, 2.0, 2.0), (83, None, 1.0, 0.0, 0.0)]
    got = fleet.nearest_feasible(spark.createDataFrame(requests, "request_id long, ox double, oy double, dx double, dy double"),
                                 spark.createDataFrame(vehicles, "vehicle_id long, x double, y double, state string, range_miles double"))

    def miles(a, b, c, d):
        return fleet.ROAD_DISTANCE_MULTIPLIER * ((a - c) ** 2 + (b - d) ** 2) ** 0.5

    want = []
    for k, a, b, c, d in requests:
        fit = [] if a is None else [(round(miles(x, y, a, b), 9), v) for v, x, y, s, r in vehicles if s == "IDLE" and miles(x, y, a, b) <= 5.0
                                    and r + 1e-9 >= miles(x, y, a, b) + miles(a, b, c, d) + miles(c, d, 0, 0) + fleet.RESERVE_FRACTION * fleet.BATTERY_RANGE_MILES]
        want.append((k, min(fit)[1] if fit else None))
    assert sorted((r["request_id"], r["vehicle_id"]) for r in got.collect()) == sorted(want)


def test_snapping_by_cells_equals_snapping_by_boxes(spark, monkeypatch):
    rng = random.Random(8)
    lines = [(i, 1, x, y, x + rng.uniform(-1, 1), y + rng.uniform(-1, 1), 2.0) for i, (x, y) in enumerate((rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(150))]
    lines += [(900, 1, -40.0, 5.0, 60.0, 5.1, 0.0), (901, 2, 4.0, 4.0, 4.0, 4.0, 1.0), (902, 1, 3.0, 3.0, 3.0, 6.0, 1.0), (903, 1, 3.0, 6.0, 3.0, 3.0, 1.0), (904, 1, None, 3.0, 3.0, 3.0, 1.0)]
    points = [(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(200)] + [(500, -39.0, 5.2), (501, 4.0, 4.0), (502, 80.0, 80.0), (502, 3.2, 4.0), (503, None, 1.0), (504, 3.0, 4.5)]
    segments = spark.createDataFrame(lines, "edge_id long, seg long, ax double, ay double, bx double, by double, start double")
    table = spark.createDataFrame(points, "point_id long, x double, y double")
    want = sorted(map(tuple, spatial.snap_to_segments(table, segments, 0.5).collect()))
    monkeypatch.setattr(spatial, "MATRIX_ROWS", 0)
    monkeypatch.setattr(spatial, "MATRIX_LEFT", 5)
    joined, join = [], spatial.box_join
    monkeypatch.setattr(spatial, "box_join", lambda points, boxes, by, **how: joined.append(boxes.count()) or join(points, boxes, by, **how))
    assert sorted(map(tuple, spatial.snap_to_segments(table, segments, 0.5).collect())) == want and len(want) > 100
    assert joined == [1]  # before: pairs of all points and boxes were rows of a join


@pytest.mark.parametrize("crowded", [False, True])
def test_clusters_across_tiles_equal_brute_force(spark, monkeypatch, crowded):
    """Chains over many tiles are one cluster; groups are kept apart; crowded cells are linked with those around."""
    if crowded:
        monkeypatch.setattr(graph, "CROWDED_TILE", 20)
        monkeypatch.setattr(graph, "CROWDED_CELL", 3)
    monkeypatch.setattr(graph, "SPOTS_PER_TASK", 40)
    rng = random.Random(5)
    spots = [(0.9 * i - 60, 0.3 * (i % 2)) for i in range(90)] + [(rng.uniform(-25, 25), rng.uniform(-25, 25)) for _ in range(160)]
    spots += [(rng.uniform(8, 9), rng.uniform(8, 9)) for _ in range(30)] + [(5.0, 5.0)] * 4
    rows = [(g, f"{g}{i:04d}" if i % 7 else f"{g}a{9999 - i}", x, y) for g in "pq" for i, (x, y) in enumerate(spots) if (g, i % 5) != ("q", 0)]
    rows += [(None, "none", 1.0, 1.0), ("p", "nowhere", None, 1.0)]
    df = spark.createDataFrame(rows, "metro string, node string, x double, y double").withColumn(
        "node", F.struct("metro", F.substring("node", 2, 9).alias("id")))
    got = {tuple(r["node"]): tuple(r["cluster"]) for r in graph.proximity_clusters(df, 1.0, by="metro").collect()}
    want = {}
    for g in "pq":
        own = [((g, n[1:]), x, y) for m, n, x, y in rows if m == g and x is not None]
        label = {n: n for n, _, _ in own}

        def top(n):
            while label[n] != n:
                n = label[n]
            return n

        for i, (a, ax, ay) in enumerate(own):
            for b, bx, by in own[:i]:
                if (ax - bx) ** 2 + (ay - by) ** 2 <= 1.0:
                    low, high = sorted((top(a), top(b)))
                    label[high] = low
        want |= {n: top(n) for n in label}
    assert got == want


def test_clustering_links_few_cells_across_tiles(spark, monkeypatch):
    """Neighboring cells within a tile leave their task as one cluster, not as pairs."""
    asked, real = [], graph.components
    monkeypatch.setattr(graph, "components", lambda links: asked.append(links.count()) or real(links))
    side = [(i, j) for i in range(60) for j in range(60)]
    points = spark.createDataFrame([(n, 0.5 * i, 0.5 * j) for n, (i, j) in enumerate(side)], "node long, x double, y double")
    assert {r["cluster"] for r in graph.proximity_clusters(points, 1.0).collect()} == {0}
    assert sum(asked) < len(side)


def test_rows_visit_blocks_packed_and_only_near_ones_are_measured():
    """A block gets its visitors as matrices; one product tells which few pairs are summed as ``distances`` does."""
    rng = np.random.default_rng(3)
    x, y, weights = rng.normal(size=(50, 32)), rng.normal(size=(400, 32)), [1 / 32] * 32
    y[7] = x[4]
    exact = matching.distances(x, y, weights)
    row, at = matching._may_be_near(x, y, np.full(50, np.inf), weights, 3)
    assert len(row) < 50 * 8
    told = set(zip(row.tolist(), at.tolist()))
    assert all((i, j) in told for i in range(50) for j in np.argsort(exact[i])[:4].tolist())
    limits = np.sort(exact, axis=1)[:, 1]  # a limit is kept in the last bit
    row, at = matching._may_be_near(x, y, limits, weights, 3)
    told = set(zip(row.tolist(), at.tolist()))
    assert all((i, j) in told for i, j in np.argwhere(exact <= limits[:, None]).tolist())
    visitors = pa.table([pa.array([[f"e{i}" for i in range(50)]]), pa.array([x.tobytes()]), pa.array([limits.tobytes()])], ["ids", "x", "limits"])
    block = pa.table([pa.array(y.tolist()), pa.array([[{"r": f"r{j:03d}", "e": f"f{j}"}] for j in range(400)])], ["v", "m"])
    out = matching._visit(weights, 3)(visitors, block).to_pylist()
    assert [(r["entity_id"], r["distance"], r["reference_id"]) for r in out] == [
        (f"e{i}", exact[i, j], f"r{j:03d}") for i in range(50) for j in np.argsort(exact[i])[:2].tolist()]


@pytest.mark.parametrize("few", [True, False])
def test_radius_neighbors_joins_totals_to_places_not_to_pairs(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(spatial, "MATRIX_ROWS", 0)
        monkeypatch.setattr(spatial, "MATRIX_PAIRS", 200)
    rng = random.Random(8)
    points = [(i, rng.uniform(0, 9), rng.uniform(0, 9), i % 9 + 1) for i in range(300)] + [(7, 3.0, 4.0, 5), (None, 3.0, 4.0, 2), (901, 3.0, None, 2), (902, 3.0, 4.0, None)]
    places = [(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(40)] + [(5, 3.0, 4.5), (5, 3.0, 4.5), (None, 3.0, 4.0), (77, 90.0, 90.0), (78, None, 1.0)]
    joined, join = [], spatial.join_lookup
    monkeypatch.setattr(spatial, "join_lookup", lambda big, *more: joined.append(big.count()) or join(big, *more))
    got = spatial.radius_neighbors(spark.createDataFrame(places, "place_id long, place_x double, place_y double"),
                                   spark.createDataFrame(points, "point_id long, x double, y double, weight long"), 0.5, 2.0).collect()
    near = [(k, p, ((x - a) ** 2 + (y - b) ** 2) ** 0.5, w) for k, a, b in places if k is not None and a is not None
            for p, x, y, w in points if y is not None]
    near = [n for n in near if 0.5 <= n[2] <= 2.0]
    total = {k: sum(n[3] or 0 for n in near if n[0] == k) for k in {n[0] for n in near}}
    want = [(k, -1 if p is None else p, round(d, 9), -1 if w is None else round(w / total[k], 12)) for k, p, d, w in near]
    assert sorted((r["place_id"], -1 if r["point_id"] is None else r["point_id"], round(r["distance"], 9),
                   -1 if r["share"] is None else round(r["share"], 12)) for r in got) == sorted(want)
    assert joined == [len(places)]  # before: all pairs


def test_snapping_compares_few_pairs_of_a_crowded_tile(monkeypatch):
    """Within a tile pairs grow with the points, not with the product of points and segments."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(spatial, "SNAP_PAIRS", 5000)
    compared, real = [], spatial._to_segment

    def counted(reach):
        measure = real(reach)
        return lambda point, line: compared.append(len(point["x"])) or measure(point, line)

    monkeypatch.setattr(spatial, "_to_segment", counted)
    x, y = rng.uniform(0, 2, (2, 1500))
    line = dict(zip(("ax", "ay"), rng.uniform(0, 2, (2, 4000))))
    line |= {"bx": line["ax"] + rng.uniform(-1, 1, 4000), "by": line["ay"] + rng.uniform(-1, 1, 4000)}
    x[:3], y[:3], line["ax"][7], line["bx"][8] = (5.0, np.nan, 2.4), (5.0, 1.0, 2.4), np.nan, line["ax"][8]
    point, segment = spatial._close_pairs(x, y, line, 0.5)
    assert sum(compared) < 1500 * 4000 / 8  # before: all of them
    with np.errstate(invalid="ignore"):
        d, sure, perhaps = real(0.5)({"x": x[:, None], "y": y[:, None]}, {c: v[None, :] for c, v in line.items()})
        best = np.where(sure, d, np.inf).min(axis=1)
        want = np.argwhere(perhaps & (d <= best[:, None] * (1 + 1e-9) + 1e-12))
    assert sorted(zip(point.tolist(), segment.tolist())) == sorted(map(tuple, want.tolist()))


def test_snapping_files_a_segment_once(spark, monkeypatch):
    """Points go to the tiles, and crowded tiles are cut on both sides."""
    rng = random.Random(11)
    monkeypatch.setattr(spatial, "MATRIX_LEFT", 9)
    monkeypatch.setattr(spatial, "SNAP_SEGMENTS", 6)
    lines = [(i, 1, x, y, x + rng.uniform(-s, s), y + rng.uniform(-s, s), 2.0) for i in range(200) for s in [rng.choice([0.2, 1, 3, 9])]
             for x, y in [(rng.uniform(-9, 9), rng.uniform(-9, 9))]] + [(300, 1, None, 1.0, 1.0, 1.0, 2.0), (301, 2, 4.0, 4.0, 4.0, 4.0, 1.0)]
    points = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(150)] + [(500, 4.0, 4.0), (500, 4.0, 4.0), (None, 1.0, 1.0)]
    segments = spark.createDataFrame(lines, "edge_id long, seg long, ax double, ay double, bx double, by double, start double")
    table = spark.createDataFrame(points, "point_id long, x double, y double")
    want = sorted(map(repr, spatial.snap_to_segments(table, segments, 0.5).collect()))
    monkeypatch.setattr(spatial, "MATRIX_ROWS", 0)
    assert sorted(map(repr, spatial.snap_to_segments(table, segments, 0.5).collect())) == want and len(want) > 100
    near = spatial._near_segments(table, segments, 0.5, 2.0).groupBy("point_id", "x", "y", "edge_id").count()
    assert near.where("count > 1 AND point_id <> 500").isEmpty()


def test_visitors_of_a_block_travel_in_small_rows(spark, monkeypatch):
    """No stored table holds packed visitors, and no row of the shuffle more than a few."""
    monkeypatch.setattr(matching, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(matching, "PACKED_ROWS", 5)
    rng = random.Random(12)
    table = spark.createDataFrame([(f"e{i:03d}", [rng.random() for _ in range(16)]) for i in range(200)] + [("none", None)], "entity_id string, v array<double>")
    groups = matching.group_references(table.where("v IS NOT NULL").select(F.col("entity_id").alias("reference_id"), "entity_id", "v"), F.col("v"))
    stored, stage, visit = [], matching.stage, matching._visit
    monkeypatch.setattr(matching, "stage", lambda df, *label: stored.append(df.dtypes) or stage(df, *label))
    held = spark.sparkContext.accumulator(0)

    def visited(weights, k):
        real = visit(weights, k)

        def most(rows, block):
            held.add(max([0, *(len(r) > 5 for r in rows["ids"].to_pylist())]))
            return real(rows, block)

        return most

    monkeypatch.setattr(matching, "_visit", visited)
    found = {r["entity_id"]: r for r in matching.tree_matches(table, groups, [1 / 16] * 16).collect()}
    assert len(found) == 200 and held.value == 0
    assert not any(kind == "binary" for columns in stored for _, kind in columns)  # before: up to 10,000 visitors in one stored row
    rows = {r["entity_id"]: np.array(r["v"]) for r in table.where("v IS NOT NULL").collect()}
    for name in ("e000", "e077"):
        d = sorted((float(np.sqrt(((rows[name] - v) ** 2 / 16).sum())), e) for e, v in rows.items() if e != name)[:3]
        assert [m["reference_id"] for m in found[name]["matches"]] == [e for _, e in d]
