"""Dead ends and the chains between them are gone before any round of least costs."""

import random

from conftest import rows

from metrosift.operators import graph


def brute(edges, source):
    cost, again = {source: 0}, True
    while again:
        again = False
        for a, b, n in edges + [(b, a, n) for a, b, n in edges]:
            if a in cost and cost[a] + n < cost.get(b, 10**9):
                cost[b], again = cost[a] + n, True
    return cost


def test_road_with_dead_ends_needs_no_rounds(spark, monkeypatch):
    road = [(i, i + 1, i % 5 + 1) for i in range(120)]
    ends = [(i, 1000 + i, 7) for i in range(1, 120, 3)] + [(1000 + i, 2000 + i, 2) for i in range(1, 120, 6)]
    ring = [(500, 501, 1), (501, 502, 2), (502, 500, 1), (500, 3, 4), (502, 503, 1)]
    left, least = [], graph._least_costs
    monkeypatch.setattr(graph, "_least_costs", lambda ways, sources, limit: left.append(ways.count()) or least(ways, sources, limit))
    table = spark.createDataFrame(road + ends + ring + [(9000, 9001, 1)], "a long, b long, length long")
    sources = spark.createDataFrame([(0,), (60,)], "source long")
    for limit in (None, 40):
        want = {(s, n, c) for s in (0, 60) for n, c in brute(road + ends + ring, s).items() if limit is None or c <= limit}
        assert set(rows(graph.shortest_paths(table, sources, limit), "source", "node", "cost")) == want
    assert max(left) < 20  # before: more than a hundred ways, as many rounds as the road has dead ends


def test_trees_of_any_shape(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(max(0, i - 6), i), i, rng.randrange(1, 9)) for i in range(1, 150)] + [(5, 140, 3)]
    found = graph.shortest_paths(spark.createDataFrame(edges, "a long, b long, length long"), spark.createDataFrame([(0,), (77,)], "source long"))
    assert set(rows(found, "source", "node", "cost")) == {(s, n, c) for s in (0, 77) for n, c in brute(edges, s).items()}


def test_a_graph_without_chains_is_written_once(spark, monkeypatch):
    rng = random.Random(6)
    edges = list({tuple(sorted(rng.sample(range(60), 2))) for _ in range(500)})
    edges = [(a, b, rng.randrange(1, 9)) for a, b in edges]
    assert min(sum(n in e[:2] for e in edges) for n in range(60)) > 2
    twice = edges + [(b, a, n + 1) for a, b, n in edges[:50]] + [(3, 3, 1), (None, 4, 1), (4, None, 1)]
    whole, stage = [], graph.stage

    def counted(df, *label):
        out = stage(df, *label)
        if out.count() >= len(edges):
            whole.append(label)
        return out

    monkeypatch.setattr(graph, "stage", counted)
    table = spark.createDataFrame(twice, "a long, b long, length long")
    found = graph.shortest_paths(table, spark.createDataFrame([(0,), (31,)], "source long"))
    assert set(rows(found, "source", "node", "cost")) == {(s, n, c) for s in (0, 31) for n, c in brute(edges, s).items()}
    assert len(whole) == 1  # before: five
