"""Transforms, bounds, ranking invariants and, when a golden folder is named, full replays."""

import glob
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from metrosift.functions import registry as reg
from metrosift.operators import features as fx
from metrosift.operators import scoring as sc
from metrosift.operators.checks import CheckFailed

SPECS = reg.check_registry(reg.TEN_FEATURES, 10)
REFS = "id string, entity_id string, category string, enabled boolean"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def norm(spark, v, lo, hi, kind="linear"):
    return value(spark, reg.normalized(reg.transformed(F.lit(float(v)), kind), lo, hi))


def test_normalize_and_clip(spark):
    assert [norm(spark, v, 10, 30) for v in (10, 20, 30, 5, 50)] == [0, 0.5, 1, 0, 1]
    assert [norm(spark, v, 0, math.log1p(15), "log1p") for v in (3, 0, 30)] == pytest.approx([0.5, 0, 1])
    assert norm(spark, 5, 7, 7) is None


@pytest.mark.parametrize("kind, bad", [("log1p", -0.1), ("log1p", float("nan")), ("linear", float("inf")), ("linear", float("nan"))])
def test_bad_values_stop(spark, kind, bad):
    with pytest.raises(Exception, match="domain"):
        value(spark, reg.transformed(F.lit(bad), kind))
    spec = reg.FeatureSpec("x", "X", "familiarity", "u", kind, 1.0)
    with pytest.raises(Exception, match="domain"):
        spark.createDataFrame([(bad,)], "x double").select(F.expr(reg.normal_sql(spec, 0.0, 1.0))).collect()


def test_registry_rules(spark, tmp_path):
    assert sum(s.weight for s in reg.FIFTEEN_FEATURES) == pytest.approx(3)
    reg.check_registry(reg.FIFTEEN_FEATURES, 15)
    with pytest.raises(CheckFailed, match="transform"):
        reg.transformed(F.lit(1.0), "square")
    with pytest.raises(CheckFailed, match="unique"):
        reg.check_registry(reg.TEN_FEATURES + reg.TEN_FEATURES[:1])
    with pytest.raises(CheckFailed, match="sum to 1"):
        reg.check_registry(reg.TEN_FEATURES[:-1])
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({"features": [s.__dict__ for s in reg.FIFTEEN_FEATURES]}))
    assert reg.load_registry(spark, str(path)) == reg.FIFTEEN_FEATURES


def small_market(spark, n=12, change=None):
    rows = []
    for i in range(n):
        row = {s.key: float((i * (7 + j)) % 11 + 1) / (12 if s.maximum == 1.0 else 1) for j, s in enumerate(SPECS)}
        row["entity_id"] = f"cbsa:{i:05d}"
        rows.append(row)
    for i, key, v in change or []:
        rows[i][key] = v
    columns = ["entity_id", *[s.key for s in SPECS]]
    schema = "entity_id string, " + ", ".join(f"`{s.key}` double" for s in SPECS)
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)


def references(spark, *ids):
    return spark.createDataFrame([(f"ref-{i}", f"cbsa:{i:05d}", "commercial", True) for i in ids], REFS)


def bounds(wide):
    return fx.bounds_of(fx.freeze_bounds(wide.where(fx.is_complete(SPECS)), SPECS), SPECS)


def ranked_rows(spark, wide, refs, b=None, **kw):
    out = sc.rank_entities(wide, refs, SPECS, b or bounds(wide), **kw).collect()
    return {r["entity_id"]: r for r in out}


def test_scores_add_up(spark):
    wide = small_market(spark)
    got = ranked_rows(spark, wide, references(spark, 0, 1))
    ranked = sorted((r for r in got.values() if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 11))
    for r in ranked:
        assert r["expansion_score"] == pytest.approx(0.4 * r["familiarity"] + 0.2 * r["readiness"] + 0.4 * r["opportunity"])
        for pillar in ("readiness", "opportunity"):
            assert r[pillar] == pytest.approx(sum(f["score_points"] for f in r["factors"] if f["pillar"] == pillar))
        d = math.sqrt(sum(f["distance_component"] for f in r["factors"] if f["pillar"] == "familiarity"))
        assert r["familiarity"] == pytest.approx(100 * (1 - min(1, d)))
        assert len(r["strongest"]) == len(r["weakest"]) == 2 and r["coverage"] == 1.0
    order = [(-r["expansion_score"], r["entity_id"]) for r in ranked]
    assert order == sorted(order)
    assert got["cbsa:00000"]["exclusion_reasons"] == [sc.REFERENCE_REASON]


def test_missing_feature_is_unranked(spark):
    wide = small_market(spark, change=[(5, "population", None)])
    row = ranked_rows(spark, wide, references(spark, 0, 1))["cbsa:00005"]
    assert row["rank"] is None and row["coverage"] == 0.9 and row["factors"] == []
    assert row["exclusion_reasons"] == ["Missing feature: population"]


def test_identical_vector_is_fully_familiar(spark):
    wide = small_market(spark)
    first = wide.where("entity_id = 'cbsa:00001'").first()
    same = [(4, s.key, first[s.key]) for s in SPECS if s.pillar == "familiarity"]
    wide = small_market(spark, change=same)
    row = ranked_rows(spark, wide, references(spark, 0, 1))["cbsa:00004"]
    assert row["familiarity"] == 100 and row["matches"][0]["reference_id"] == "ref-1" and row["matches"][0]["distance"] == 0


def test_constant_pillar_ranks_nobody(spark):
    wide = small_market(spark)
    b = bounds(wide)
    b |= {s.key: (1.0, 1.0) for s in SPECS if s.pillar == "readiness"}
    got = ranked_rows(spark, wide, references(spark, 0, 1), b)
    assert all(r["rank"] is None and "No discriminating features in readiness" in r["exclusion_reasons"] for r in got.values())


def test_reference_rules(spark):
    wide = small_market(spark, change=[(2, "population", None)])
    with pytest.raises(CheckFailed, match="Incomplete reference"):
        ranked_rows(spark, wide, references(spark, 2))
    with pytest.raises(CheckFailed, match="must exist"):
        ranked_rows(spark, wide, references(spark, 0).withColumn("enabled", F.lit(False)))
    with pytest.raises(CheckFailed, match="not both"):
        sc.RankingRequest(reference_ids=("a",), reference_categories=("commercial",))
    with pytest.raises(CheckFailed, match="Weights"):
        sc.RankingRequest(weights={"familiarity": 1.0})
    only = ranked_rows(spark, wide, references(spark, 0, 1), request=sc.RankingRequest(reference_ids=("ref-1",)))
    assert {m["reference_id"] for r in only.values() for m in r["matches"]} == {"ref-1"}


def test_references_never_match_themselves(spark):
    wide, refs = small_market(spark), references(spark, 0, 1, 3)
    got = {r["entity_id"]: r for r in sc.rank_references(wide, refs, SPECS, bounds(wide)).collect()}
    assert len(got) == 3 and all(r["rank"] for r in got.values())
    assert all(m["entity_id"] != e for e, r in got.items() for m in r["matches"])
    alone = sc.rank_references(wide, references(spark, 0), SPECS, bounds(wide)).collect()
    assert alone[0]["exclusion_reasons"] == [sc.NO_MATCH_REASON]


def test_duplicate_features_and_rankable_gate(spark):
    long = fx.to_long(small_market(spark), [s.key for s in SPECS])
    assert fx.to_wide(long, SPECS).count() == 12
    with pytest.raises(Exception, match="Repeated feature"):
        fx.to_wide(long.unionByName(long.limit(1)), SPECS).collect()
    wide = small_market(spark)
    ranked = sc.rank_entities(wide, references(spark, 0, 1), SPECS, bounds(wide))
    assert sc.require_rankable(ranked, 10) is ranked
    with pytest.raises(CheckFailed, match="at least 11"):
        sc.require_rankable(ranked, 11)


GOLDEN = os.environ.get("METROSIFT_GOLDEN_DIR", "")


@pytest.mark.skipif(not GOLDEN, reason="METROSIFT_GOLDEN_DIR names no folder")
def test_golden_explanations(spark):
    """Metro documents, config and explanations of a published demo release, replayed."""
    def read(pattern):
        return [json.load(open(p, encoding="utf-8")) for p in sorted(glob.glob(f"{GOLDEN}/{pattern}"))]

    def repair(text):  # the stored texts were decoded once too often
        return text.encode("cp1252").decode("utf-8") if "Â" in text else text

    metros, config = read("city-*.json"), read("config.json")[0]
    long = spark.createDataFrame([(m["city_id"], k, f["value"]) for m in metros for k, f in m["features"].items()], "entity_id string, key string, value double")
    names = spark.createDataFrame([(m["city_id"], m["display_name"]) for m in metros], "entity_id string, display_name string")
    refs = spark.createDataFrame([(r["id"], r["city_id"], r["category"], r["enabled"]) for r in config["references"]], REFS)
    frozen = {k: (b["lower"], b["upper"]) for k, b in config["bounds"].items()}
    ranked = sc.rank_entities(fx.to_wide(long, SPECS), refs, SPECS, frozen)
    got = {r["entity_id"]: r for r in sc.explain_rows(ranked, names, SPECS, prefix="Illustrative mock ranking. ").collect()}
    golden = read("explanation-*.json")
    assert len(golden) == 20
    for e in golden:
        row = got[e["city_id"]]
        assert row["summary"] == e["summary"] and row["tradeoffs"] == e["tradeoffs"]
        assert row["advantages"] == [repair(a) for a in e["advantages"]]
