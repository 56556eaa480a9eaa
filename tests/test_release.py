"""Releases, publication, validation and reconciliation."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from metrosift.functions.registry import TEN_FEATURES, UNSCORED_UNITS, registry_table
from metrosift.operators import audit, features as fx, release
from metrosift.operators.checks import CheckFailed

SPECS = TEN_FEATURES
FEATURE = "entity_id string, key string, value double, unit string, quality string, missing_reason string, provenance_ids array<string>"
REFS = "id string, entity_id string, category string, enabled boolean"


def inputs(spark, change=None):
    data = []
    for i in range(6):
        for j, s in enumerate(SPECS):
            v = float((i * 3 + j) % 7) / (7 if s.maximum == 1.0 else 1)
            data.append([f"{i:05d}", s.key, v, s.unit, "derived", None, ["src"]])
    for i, key, fields in change or []:
        row = next(r for r in data if r[0] == f"{i:05d}" and r[1] == key)
        for at, v in fields.items():
            row[at] = v
    features = spark.createDataFrame([tuple(r) for r in data], FEATURE)
    refs = spark.createDataFrame([("r4", "00004", "commercial", True), ("r5", "cbsa:00005", "commercial", True)], REFS)
    candidates = spark.createDataFrame([(f"{i:05d}",) for i in range(4)], "entity_id string")
    provenance = spark.createDataFrame([(f"{i:05d}", "src") for i in range(6)], "entity_id string, id string")
    return features, refs, candidates, provenance


def build(spark, change=None, **kw):
    return release.build_release(*inputs(spark, change), SPECS, UNSCORED_UNITS, **kw)


MISSING = {2: None, 4: "missing", 5: "gone", 6: []}


def test_build_release(spark):
    extra = spark.createDataFrame([("page",)], "id string")
    built = build(spark, [(3, "population", MISSING), (5, "population", MISSING)], reference_provenance=extra)
    assert rows(built.candidates)[0] == ("cbsa:00000",)
    assert rows(built.references, "id", "enabled") == [("r4", True), ("r5", False)]
    assert [r[0] for r in rows(built.cohort)] == [f"cbsa:0000{i}" for i in (0, 1, 2, 4)]
    assert built.features.count() == 6 * 12 and built.features.where("key = 'average_aadt' AND quality = 'missing'").count() == 6
    assert rows(built.exclusions, "subject") == [("cbsa:00003",), ("r5",)]
    assert sorted(built.provenance.where("id = 'page'").select("entity_id").collect()) == [("cbsa:00004",), ("cbsa:00005",)]
    assert not audit.measurement_violations(built.features, SPECS).count()


def test_invalid_measurements(spark):
    bad = [(1, "population", {6: []})]
    with pytest.raises(CheckFailed, match="Refusing"):
        build(spark, bad)
    built = build(spark, bad, allow_invalid=True)
    row = built.features.where("entity_id = 'cbsa:00001' AND key = 'population'").first()
    assert row["value"] is None and row["quality"] == "missing" and row["missing_reason"]
    assert "cbsa:00001 population" in [r[0] for r in rows(built.exclusions, "subject")]


def test_closed_inputs(spark):
    features, refs, candidates, provenance = inputs(spark)
    with pytest.raises(CheckFailed, match="overlap"):
        release.build_release(features, refs, candidates.union(refs.select("entity_id")), provenance, SPECS, {})
    with pytest.raises(CheckFailed, match="Unknown candidates"):
        release.build_release(features.where("entity_id <> '00001'"), refs, candidates, provenance, SPECS, {})
    with pytest.raises(CheckFailed, match="Duplicate"):
        release.build_release(features.union(features.limit(1)), refs, candidates, provenance, SPECS, {})


def test_correction_changes_one_key(spark):
    parent = build(spark)
    new = parent.features.where("key = 'mean_commute_minutes'").withColumn("value", F.col("value") + 50).drop("key")
    child = release.correct_release(parent, "mean_commute_minutes", new, SPECS)
    release.require_only_key_changed(parent.features, child.features, "mean_commute_minutes")
    before, after = (dict((r["key"], (r["lower"], r["upper"])) for r in x.bounds.collect()) for x in (parent, child))
    assert {k for k in before if before[k] != after[k]} == {"mean_commute_minutes"}
    with pytest.raises(CheckFailed, match="lacks entities"):
        release.replace_feature(parent.features, "population", new.limit(2))
    with pytest.raises(CheckFailed, match="may change"):
        release.require_only_key_changed(parent.features, child.features, "population")
    cohort = fx.to_wide(parent.features, SPECS).join(parent.cohort, "entity_id", "left_semi")
    assert audit.bounds_differences(cohort, SPECS, parent.bounds).isEmpty()
    assert audit.bounds_differences(cohort, SPECS, child.bounds).count() == 2


def test_publish_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    path = str(tmp_path / "release")
    first = release.publish(df, path)
    assert release.publish(df.orderBy(F.desc("id")).repartition(3), path) == first
    with pytest.raises(CheckFailed, match="already stored"):
        release.publish(df.withColumn("id", F.col("id") + 1), path)
    assert release.digest_of(df) != release.digest_of(df.union(df.limit(1)))


def test_publication_gate(spark):
    df, ranked = spark.range(3).toDF("id"), spark.range(2).toDF("rank")
    hashes = spark.createDataFrame([("h1",), ("h2",)], "raw_sha256 string")
    ok = (df, release.digest_of(df), ranked, release.digest_of(ranked))
    release.publication_gate(*ok, hashes.limit(1), hashes)
    with pytest.raises(CheckFailed, match="another parent"):
        release.publication_gate(df, "x", *ok[2:], hashes, hashes)
    with pytest.raises(CheckFailed, match="another ranking"):
        release.publication_gate(*ok[:3], "x", hashes, hashes)
    with pytest.raises(CheckFailed, match="Source hashes"):
        release.publication_gate(*ok, hashes.withColumn("raw_sha256", F.lit("h3")), hashes)


def test_validation_rows(spark):
    features = spark.createDataFrame([
        ("a", "transit_commute_share", 1.2, "fraction", "derived", None, ["p"]),
        ("a", "population", None, "residents", "derived", None, []),
        ("b", "population", 5.0, "residents", "derived", None, ["unknown"]),
        ("b", "average_aadt", 5.0, "cars", "derived", None, ["p"]),
    ], FEATURE)
    got = rows(audit.measurement_violations(features, SPECS))
    assert got == [("a", "population", "missing without reason"), ("a", "transit_commute_share", "above maximum"), ("b", "average_aadt", "wrong unit")]
    provenance = spark.createDataFrame([("a", "p"), ("b", "p")], "entity_id string, id string")
    assert rows(audit.unresolved_provenance(features, provenance)) == [("b", "unknown")]
    entities = spark.createDataFrame([("cbsa:00001", 10.0, 20.0), ("1", 91.0, None)], "entity_id string, latitude double, longitude double")
    assert [r[1] for r in rows(audit.entity_violations(entities))] == ["id", "latitude", "longitude"]
    legal = spark.createDataFrame([("documented_pathway", []), ("unresolved", []), ("maybe", ["p"])], "category string, provenance_ids array<string>")
    assert audit.legal_violations(legal).count() == 2
    wide = fx.to_wide(features.where("entity_id = 'a'"), SPECS)
    assert wide.select(fx.coverage(SPECS)).first()[0] == 0.1
    assert registry_table(spark, SPECS).count() == 10


def test_report_and_determinism(spark):
    df = spark.range(4)
    got = {r["check"]: (r["violations"], r["passed"]) for r in audit.report({"none": df.limit(0), "four": df}).collect()}
    assert got == {"none": (0, True), "four": (4, False)}
    assert audit.is_deterministic(lambda: spark.range(10).repartition(3))
    assert not audit.is_deterministic(iter([spark.range(3), spark.range(4)]).__next__)


def test_measurement_struct(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double").select(fx.measurement(F.col("v"), "u", F.array(F.lit("p")), reason="no source").alias("m")).select("m.*")
    assert [tuple(r) for r in df.collect()] == [(1.0, "u", "derived", None, ["p"]), (None, "u", "missing", "no source", [])]
