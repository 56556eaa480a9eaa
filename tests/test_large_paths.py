"""The branches small inputs never take: hot keys, blocks, growing radii, crowded cells."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrosift.operators import graph, joins, matching, spatial
from metrosift.session import stage


@pytest.fixture
def nothing_fits(monkeypatch):
    """No side may be broadcast, so every join takes its large form."""
    monkeypatch.setattr(joins, "estimated_bytes", lambda df: 1 << 60)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    for module in (joins, spatial):
        monkeypatch.setattr(module, "fits", lambda df, limit=0: False)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 30)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_with_hot_keys(spark, nothing_fits, how):
    big = spark.createDataFrame([(0 if i % 3 else i % 50, i) for i in range(600)], "k long, i long")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40)], "k long, v string")
    got = joins.join_lookup(big, lookup, ["k"], how)
    want = big.join(lookup, "k", how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, nothing_fits, how):
    left = spark.createDataFrame([(0 if i % 2 else i % 60, i) for i in range(500)], "k long, i long")
    right = spark.createDataFrame([(k, j) for k in range(30) for j in range(3)], "k long, j long")
    got = joins.salted_join(left, right, ["k"], F.col("i"), how)
    want = left.join(right, "k", how)
    assert sorted(map(repr, got.select("k", "i", "j").collect())) == sorted(map(repr, want.select("k", "i", "j").collect()))


def test_size_check_sees_exploded_rows_and_long_arrays(spark):
    exploded = spark.range(10).select(F.explode(F.sequence(F.lit(1), F.lit(1_000_000))).alias("n"))
    assert not joins.fits(exploded)
    rings = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: i * 1.5).alias("ring"))
    assert not joins.fits(rings)
    assert joins.fits(spark.range(1000)) and joins.fits(spark.createDataFrame([(1, "a")], "k long, v string"))


def test_hot_key_meets_as_many_tasks_as_its_size_needs(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 100_000)
    rows = spark.range(1_100_000).select(F.when(F.col("id") < 1_000_000, 0).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in joins.hot_keys(rows, ["k"]).collect()] == [(0, 10)]


def test_repeated_hot_lookup_is_refused(spark, nothing_fits):
    big = spark.createDataFrame([(0, i) for i in range(100)], "k long, i long")
    with pytest.raises(ValueError):
        joins.join_lookup(big, spark.createDataFrame([(0, "a"), (0, "b")], "k long, v string"), ["k"])


def _entities(spark, n, dims, seed):
    rng = random.Random(seed)
    rows = [(f"e{i:03d}", [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(dims)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "entity_id string, v array<double>")


def brute_matches(candidates, refs, weights, k=3):
    out = {}
    for entity, v in candidates:
        seen, found = set(), []
        for rid, rentity, rv in sorted(refs):
            if rentity == entity or tuple(rv) in seen:
                continue
            seen.add(tuple(rv))
            found.append((math.sqrt(sum(w * (a - b) ** 2 for w, a, b in zip(weights, v, rv))), rid))
        out[entity] = [r for _, r in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("dims, limit", [(4, 512), (4, 1), (16, 512)])
def test_matches_equal_brute_force(spark, monkeypatch, dims, limit):
    """Constant array, blocks and Arrow batches; many references share a vector."""
    monkeypatch.setattr(matching, "BLOCK_VECTORS", 7)
    rows, df = _entities(spark, 60, dims, dims + limit)
    refs = [(f"r{i:03d}", e, v) for i, (e, v) in enumerate(rows[:40])] + [(f"s{i:03d}", e, v) for i, (e, v) in enumerate(rows[20:30])]
    table = spark.createDataFrame(refs, "reference_id string, entity_id string, v array<double>")
    weights = [1 / dims] * dims
    groups = matching.group_references(table, F.col("v"))
    got = matching.add_matches(df, groups, F.col("v"), weights, limit=limit)
    assert {r["entity_id"]: [m["reference_id"] for m in r["matches"]] for r in got.collect()} == brute_matches(rows, refs, weights)


@pytest.mark.parametrize("dims", [3, 16, 20])
def test_tree_agrees_with_the_small_path_in_every_bit(spark, monkeypatch, dims):
    """Clustered vectors with repeats, ties and a row without a vector; far blocks are never looked at."""
    monkeypatch.setattr(matching, "BLOCK_VECTORS", 8)
    monkeypatch.setattr(matching, "VISITS_PER_TASK", 15)
    rng = random.Random(dims)
    centres = [[rng.uniform(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = [(f"e{i:03d}", [c + rng.choice([0, 0.01, 0.02, rng.gauss(0, 0.02)]) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(f"x{i}", rows[0][1]) for i in range(60)]
    refs = [(f"r{i:03d}", e, v) for i, (e, v) in enumerate(rows[:200])] + [(f"s{i:03d}", e, v) for i, (e, v) in enumerate(rows[150:180])]
    table = spark.createDataFrame(refs, "reference_id string, entity_id string, v array<double>")
    df = spark.createDataFrame([*rows, ("null", None)], "entity_id string, v array<double>")
    weights = [(1 + i % 3) / dims for i in range(dims)]
    groups = matching.group_references(table, F.col("v"))
    take = lambda d: {r["entity_id"]: [tuple(m) for m in r["matches"]] for r in d.where("v IS NOT NULL").collect()}
    small = take(matching.add_matches(df.where("v IS NOT NULL"), groups, F.col("v"), weights))
    large = take(matching.add_matches(df, groups, F.col("v"), weights, limit=1))
    assert large == small
    blocks = -(-groups.count() // 8)
    looked = matching.tree_matches(df, groups, weights).agg(F.avg("visited"), F.count(F.lit(1))).first()
    assert looked[1] == len(rows) and looked[0] < blocks / 2


def test_boxes_bound_distances_from_below():
    rng = np.random.default_rng(5)
    points, weights = rng.random((40, 7)), [0.1, 0.3, 0.05, 0.2, 0.15, 0.1, 0.1]
    x = rng.random((60, 7)) * 2 - 0.5
    least = matching.box_distances(x, points.min(0)[None], points.max(0)[None], weights)
    assert (least <= matching.distances(x, points, weights)).all()


def _km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("per", [None, "kind"])
def test_nearest_with_growing_radii(spark, nothing_fits, monkeypatch, per):
    monkeypatch.setattr(spatial, "CELL_ROWS", 5)
    rng = random.Random(3)
    # A dense town with copies of one spot, a thin countryside, the poles and the date line.
    spots = [(10 + rng.random() / 5, 20 + rng.random() / 5) for _ in range(120)] + [(10.1, 20.1)] * 40
    spots += [(rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)) for _ in range(150)]
    spots += [(89.8, x) for x in (-170.0, 0.0, 90.0)] + [(0.0, 179.9), (0.1, -179.9), (-89.9, 10.0)]
    stations = [(i, a, b, "xy"[i % 2]) for i, (a, b) in enumerate(spots)]
    places = [(i, rng.uniform(9.5, 10.7), rng.uniform(19.5, 20.7)) for i in range(20)]
    places += [(100 + i, a, b) for i, (a, b) in enumerate([(89.9, 100.0), (0.05, -179.95), (-89.95, -170.0), (45.0, 0.0)])]
    got = spatial.nearest_stations(
        spark.createDataFrame(places, "place_id long, lat double, lon double"),
        spark.createDataFrame(stations, "station_id long, lat double, lon double, kind string"), 3, 300.0, per)
    want = set()
    for pid, lat, lon in places:
        for kind in ("x", "y") if per else (None,):
            near = sorted((_km((lat, lon), (a, b)), i) for i, a, b, c in stations if kind in (None, c))
            want |= {(pid, i, n) for n, (d, i) in enumerate([x for x in near if x[0] <= 300][:3], 1)}
    assert {(r["place_id"], r["station_id"], r["nearness"]) for r in got.collect()} == want


def test_points_in_boxes_of_all_sizes(spark, nothing_fits):
    rng = random.Random(8)
    shapes = []
    for i in range(60):
        x, y, s = rng.uniform(0, 50), rng.uniform(0, 50), 10 ** rng.uniform(-2, 1.6)
        shapes.append((i, [(x, y), (x + s, y), (x + s, y + s / 2), (x + s / 2, y + s / 2), (x + s / 2, y + s), (x, y + s)]))
    points = [(i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(300)] + [(1000 + i, 5.0, 5.0) for i in range(100)]

    def inside(px, py, ring):
        (x, y), s = ring[0], ring[1][0] - ring[0][0]
        return x < px < x + s and y < py < y + s and not (px >= x + s / 2 and py >= y + s / 2)

    polygons = spark.createDataFrame([(i, [{"x": a, "y": b} for a, b in r]) for i, r in shapes], "polygon_id long, ring array<struct<x: double, y: double>>")
    table = spark.createDataFrame(points, "point_id long, x double, y double")
    pairs = {tuple(r) for r in spatial.points_in_polygons(table, polygons).collect()}
    want = {(p, i) for p, x, y in points for i, r in shapes if inside(x, y, r)}
    assert pairs == want
    first = {r["point_id"]: r["polygon_id"] for r in spatial.assign_points(table, polygons).collect()}
    assert first == {p: min((i for q, i in want if q == p), default=None) for p, _, _ in points}


def brute_clusters(points, tolerance):
    label = {n: n for n, _, _ in points}
    changed = True
    while changed:
        changed = False
        for a, ax, ay in points:
            for b, bx, by in points:
                if (ax - bx) ** 2 + (ay - by) ** 2 <= tolerance**2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("large", [False, True])
def test_clusters_equal_brute_force(spark, monkeypatch, request, large):
    """Crowded cells are cut and compared again until every pair of cells is settled."""
    if large:
        request.getfixturevalue("nothing_fits")
    monkeypatch.setattr(graph, "PAIRS_PER_CELLS", 6)
    rng = random.Random(21)
    points = [(i, rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(60)]
    points += [(100 + i, 7 + rng.random() / 2, 7 + rng.random() / 2) for i in range(40)]
    points += [(200 + i, 8.35 + rng.random() / 4, 7 + rng.random() / 2) for i in range(30)] + [(300 + i, 1.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(points, "node long, x double, y double")
    got = {r["node"]: r["cluster"] for r in graph.proximity_clusters(df, 0.5).collect()}
    assert got == brute_clusters(points, 0.5)


@pytest.mark.parametrize("large", [False, True])
def test_components_of_a_long_chain_and_a_hub(spark, request, large):
    if large:
        request.getfixturevalue("nothing_fits")
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(900, 900)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 580)}, 900: 900}


@pytest.mark.parametrize("large", [False, True])
def test_shortest_paths(spark, request, large):
    if large:
        request.getfixturevalue("nothing_fits")
    rng = random.Random(4)
    edges = [(rng.randrange(25), rng.randrange(25), rng.randrange(1, 30)) for _ in range(60)]
    cost = {(s, n): (0 if s == n else math.inf) for s in (0, 7) for n in range(25)}
    for _ in range(25):
        for a, b, w in edges:
            for s in (0, 7):
                cost[s, b] = min(cost[s, b], cost[s, a] + w)
                cost[s, a] = min(cost[s, a], cost[s, b] + w)
    got = graph.shortest_paths(spark.createDataFrame(edges, "a long, b long, length long"),
                               spark.createDataFrame([(0,), (7,)], "source long")).collect()
    assert {(r["source"], r["node"]): r["cost"] for r in got} == {k: v for k, v in cost.items() if v < math.inf}
    for r in got:
        if r["previous"] is not None:
            assert any({a, b} == {r["previous"], r["node"]} and cost[r["source"], r["previous"]] + w == r["cost"] for a, b, w in edges)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_contracted_paths_and_their_routes(spark, kind):
    """Long chains, rings hanging on one node and alone, dead ends, parallel and self-looping edges, a source within a chain."""
    rng = random.Random(13)
    w = (lambda: rng.randrange(1, 9)) if kind == "long" else (lambda: rng.randrange(1, 9) / 4)
    edges = [(i, i + 1, w()) for i in range(0, 70)]  # one chain of 71 nodes
    edges += [(20, 200, w()), *[(200 + i, 201 + i, w()) for i in range(25)], (225, 50, w())]  # a second way round
    edges += [(50, 300, w()), *[(300 + i, 301 + i, w()) for i in range(9)], (309, 50, w())]  # a ring on one node
    edges += [(400 + i, 400 + (i + 1) % 6, w()) for i in range(6)]  # a ring of its own
    edges += [(10, 10, w()), (10, 11, w()), (10, 11, w()), (70, 500, w()), (70, 501, w()), (900, 901, w())]
    sources = [0, 33, 210, 402, 900]
    least = {}
    for a, b, c in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                least[x, y] = min(c, least.get((x, y), math.inf))
    cost = {}
    for s in sources:
        heap, done = [(0, s)], {}
        while heap:
            c, n = heapq.heappop(heap)
            if n not in done:
                done[n] = c
                for (x, y), d in least.items():
                    if x == n and y not in done:
                        heapq.heappush(heap, (c + d, y))
        cost.update({(s, n): c for n, c in done.items()})
    table = spark.createDataFrame(edges, f"a long, b long, length {kind}")
    asked = spark.createDataFrame([(s,) for s in sources], "source long")
    found = stage(graph.shortest_paths(table, asked))
    assert {(r["source"], r["node"]): r["cost"] for r in found.collect()} == pytest.approx(cost)
    for r in found.join(graph.routes(found), ["source", "node"]).collect():
        legs = [least[x, y] for x, y in zip(r["route"], r["route"][1:])]
        assert r["route"][0] == r["source"] and r["route"][-1] == r["node"] and sum(legs) == pytest.approx(r["cost"])
        assert r["previous"] == (r["route"][-2] if legs else None)
    near = graph.shortest_paths(table, asked, 12)
    assert {(r["source"], r["node"]) for r in near.collect()} == {k for k, c in cost.items() if c <= 12}


@pytest.mark.parametrize("large", [False, True])
def test_points_with_repeated_ids_keep_their_rows(spark, request, large):
    if large:
        request.getfixturevalue("nothing_fits")
    square = spark.sql("SELECT 7L AS polygon_id, array(struct(0D AS x, 0D AS y), struct(2D AS x, 0D AS y),"
                       " struct(2D AS x, 2D AS y), struct(0D AS x, 2D AS y)) AS ring")
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 5.0, 5.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (None, 1.5, 1.0)],
                                   "point_id long, x double, y double")
    got = sorted(map(tuple, spatial.assign_points(points, square).collect()), key=repr)
    assert got == sorted([(1, 1.0, 1.0, 7), (1, 5.0, 5.0, None), (2, 1.0, 1.0, 7), (2, 1.0, 1.0, 7), (None, 1.5, 1.0, 7)], key=repr)
