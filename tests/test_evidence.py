"""Evidence ids through factors and explanations, lookups, and many weight sets from one scoring."""

import functools
import operator
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from metrosift.functions.registry import PILLARS
from metrosift.operators import evidence, ordered, scoring
from metrosift.operators.checks import CheckFailed

FEATURES = "entity_id string, key string, value double, provenance_ids array<string>"


def test_unions_are_sorted_distinct_and_whole(spark):
    table = spark.createDataFrame([("a", ["z", "b"]), ("a", ["b", None]), ("a", ["a"]), ("b", []), ("c", None)] + [("h", ["x", "y"])] * 500,
                                  "k string, provenance_ids array<string>")
    assert rows(evidence.union_of_ids(table, ["k"])) == [("a", ["a", "b", "z"]), ("b", []), ("c", []), ("h", ["x", "y"])]
    one = spark.range(1).select(evidence.merged_ids(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit(None))).alias("m"))
    assert one.first()["m"] == ["a", "b"]


def test_factors_keep_the_ids_of_their_measurement(spark):
    factor = "array<struct<key: string, points: double>>"
    scored = spark.createDataFrame([("a", [("k", 1.0), ("l", 2.0), ("none", 0.0)]), ("b", []), ("x", [("k", 1.0)])], f"entity_id string, factors {factor}")
    features = spark.createDataFrame([("a", "k", 1.0, ["p2", "p1"]), ("a", "l", 2.0, ["p1"]), ("b", "k", 1.0, ["p9"]), ("a", "none", None, None)], FEATURES)
    found = {r["entity_id"]: r for r in evidence.with_factor_evidence(scored, features).collect()}
    assert [f["provenance_ids"] for f in found["a"]["factors"]] == [["p2", "p1"], ["p1"], []]
    assert found["a"]["evidence_ids"] == ["p1", "p2"] and found["b"]["evidence_ids"] == [] == found["x"]["evidence_ids"]


def test_explanations_cite_own_and_reference_ids(spark):
    explained = spark.createDataFrame([("a", 1, "s"), ("b", None, "t")], "entity_id string, rank long, summary string")
    scored = spark.createDataFrame([("a", ["p1"], [("r1",)]), ("b", ["p7"], [])], "entity_id string, evidence_ids array<string>, matches array<struct<reference_id: string>>")
    references = spark.createDataFrame([("r1", ["p0", "p1"]), ("r2", ["p5"])], "id string, provenance_ids array<string>")
    ranking = spark.createDataFrame([("id-1",)], "ranking_id string")
    found = evidence.explained(explained, scored, references, ranking)
    assert rows(found, "entity_id", "evidence_ids", "mode", "ranking_id") == [("a", ["p0", "p1"], "template", "id-1"), ("b", [], "template", "id-1")]


def test_ranking_ids_follow_their_inputs(spark):
    refs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "id string")
    shares = {p: 1 / 3 for p in PILLARS}
    made = lambda r, s, v: evidence.ranking_id(r, s, F.lit(v)).first()["ranking_id"]
    base = made(refs, shares, "v1")
    assert base == made(refs.orderBy(F.desc("id")).repartition(3), dict(reversed(shares.items())), "v1") and len(base) == 64
    assert len({base, made(refs.limit(2), shares, "v1"), made(refs, shares, "v2"), made(refs, {**shares, PILLARS[0]: 0.5}, "v1"), made(refs.limit(0), shares, "v1")}) == 5


def test_lookup_gives_one_entity_with_its_records(spark):
    entities = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "again")], "entity_id string, name string")
    features = spark.createDataFrame([("a", "l", 2.0, ["p1"]), ("a", "k", 1.0, ["p2", "p1"]), ("b", "k", 1.0, ["p9"])], FEATURES)
    records = spark.createDataFrame([("a", "p1", "u1"), ("a", "p2", "u2"), ("a", "unused", "u3"), ("b", "p9", "u9")], "entity_id string, id string, url string")
    found = evidence.lookup("a", entities, features, records).collect()
    assert len(found) == 1 and found[0]["name"] == "A"
    assert [tuple(f) for f in found[0]["features"]] == [("k", 1.0, ["p2", "p1"]), ("l", 2.0, ["p1"])]
    assert [tuple(e) for e in found[0]["evidence"]] == [("p1", "u1"), ("p2", "u2")]
    for unknown in ("b", "nobody"):
        with pytest.raises(LookupError):
            evidence.lookup(unknown, entities, features, records)
    with pytest.raises(CheckFailed):
        evidence.lookup("a", entities, features, records.where("id <> 'p2'"))


def test_a_hundred_weight_sets_equal_single_rankings(many_slices, monkeypatch):
    spark, rng = many_slices, random.Random(7)
    table = [(f"e{i:03d}", *[rng.choice([10.0, 55.5, rng.uniform(0, 100)]) for _ in PILLARS]) for i in range(60)]
    sets = {f"w{i:03d}": scoring.RankingRequest({p: rng.choice([0, 1, 2, 5]) + 0.1 for p in PILLARS}) for i in range(100)}
    columns = ", ".join(f"{p} double" for p in PILLARS)
    scored = spark.createDataFrame([(*r, 1.0) for r in table] + [("out", None, None, None, None)], f"entity_id string, {columns}, expansion_score double")
    calls = []
    monkeypatch.setattr(scoring, "stage", lambda df, label: calls.append(label) or ordered.stage(df, label))
    ranks = scoring.ranks_by_weights(scored, sets).collect()
    assert calls == ["pillars"] and len(ranks) == 6000
    for name, request in sets.items():
        shares = request.shares()
        total = {e: functools.reduce(operator.add, (v * shares[p] for p, v in zip(PILLARS, values))) for e, *values in table}
        want = {e: i for i, e in enumerate(sorted(total, key=lambda e: (-total[e], e)), 1)}
        assert {r["entity_id"]: r["rank"] for r in ranks if r["weights"] == name} == want
