"""Whole routes leave one walk, in slices, and no round or shuffle writes them."""

import random

import pytest
from pyspark.sql import functions as F

from metrosift.operators import graph


def brute(paths):
    previous = {(s, n): p for s, n, p in paths}

    def route(s, n):
        out = [n]
        while previous[s, n] is not None:
            n = previous[s, n]
            out.append(n)
        return out[::-1]

    return {(s, n): route(s, n) for s, n, _ in paths}


@pytest.mark.parametrize("text", [None, ">"])
@pytest.mark.parametrize("shape", ["chain", "tree", "hub"])
def test_long_routes_by_one_walk(spark, monkeypatch, shape, text):
    for name, value in (("ANCHOR_EVERY", 4), ("ANCHORS_PER_SLICE", 5), ("ROUTES_PER_SLICE", 7), ("ROUTE_BYTES", 500)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(3)
    above = {"chain": lambda i: i - 1, "tree": lambda i: rng.randrange(max(0, i - 5), i), "hub": lambda i: i - 1 if i < 90 else 45}[shape]
    paths = [(s, s if i == 0 else s + i, None if i == 0 else s + above(i)) for s, n in ((0, 150), (1000, 40), (5000, 1)) for i in range(n)]
    table = spark.createDataFrame([(*p, 7 * p[1]) for p in paths] + [(None, None, None, 0)], "source long, node long, previous long, cost long")
    got = graph.routes(table, ["cost"], text).collect()
    assert len(got) == len(paths) + 1
    for r in got:
        if r["source"] is not None:
            want = brute(paths)[r["source"], r["node"]]
            assert r["route"] == (want if text is None else text.join(map(str, want))) and r["cost"] == 7 * r["node"]


def test_no_round_writes_whole_routes(spark, monkeypatch):
    """Stretches between anchors are short: what is stored grows with the nodes, not with their square."""
    held, real = [], graph.stage

    def stage(df, *label):
        out = real(df, *label)
        if "route" in out.columns:
            held.append(out.agg(F.max(F.size("route"))).first()[0] or 0)
        return out

    monkeypatch.setattr(graph, "stage", stage)
    n = 1500
    table = spark.createDataFrame([(0, i, i - 1 if i else None) for i in range(n)], "source long, node long, previous long")
    assert {r["node"]: r["n"] for r in graph.routes(table).select("node", F.size("route").alias("n")).collect()} == {i: i + 1 for i in range(n)}
    assert max(held) < n / 4  # before: the last round wrote the whole routes
