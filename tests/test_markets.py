"""Composite market jobs on hand-made rows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from metrosift.operators import audit, fleet, markets
from metrosift.functions.registry import FIFTEEN_FEATURES

ESTIMATES = ("metro string, population double, land_area_km2 double, households double, zero_vehicle_households double, "
             "workers double, transit_workers double, mean_commute_minutes double")


def estimates(spark):
    return spark.createDataFrame([("m", 1000.0, 10.0, 400.0, 40.0, 500.0, 50.0, 30.0), ("n", 10.0, 0.0, 0.0, 0.0, 5.0, 1.0, None)], ESTIMATES)


SOURCES = {"acs": "a", "charging": "c", "roads": "r", "climate": "n"}


def test_market_features(spark):
    charging = spark.createDataFrame([("m", 7.0, 0.5), ("n", 0.0, None)], "metro string, ports_per_100k double, population_share_with_ports double")
    got = markets.market_features(estimates(spark), charging, None, None, SOURCES)
    assert got.groupBy("entity_id").count().where("count <> 17").isEmpty()
    values = {(r["entity_id"], r["key"]): r["value"] for r in got.collect()}
    assert values["m", "zero_vehicle_household_share"] == values["m", "transit_commute_share"] == 0.1
    assert values["m", "population_density_per_km2"] == 100 and values["m", "mean_commute_minutes"] == 30
    assert values["n", "public_dc_ports_per_100k"] == 0 and values["n", "zero_vehicle_household_share"] is None
    absent = got.where("key IN ('hot_days_32c', 'freeway_share', 'average_aadt')")
    assert absent.where("value IS NOT NULL OR quality <> 'missing' OR missing_reason IS NULL").isEmpty()
    assert audit.measurement_violations(got, FIFTEEN_FEATURES).isEmpty()


def test_refresh_touches_only_its_keys(spark):
    before = markets.market_features(estimates(spark), None, None, None, SOURCES)
    charging = spark.createDataFrame([("m", 7.0, 0.5), ("n", 0.0, None)], "entity_id string, ports_per_100k double, population_share_with_ports double")
    commute = spark.createDataFrame([("m", 99.0), ("n", 21.0)], "entity_id string, value double")
    after = markets.refresh(before, commute, charging, "dp", "af")
    values = {(r["entity_id"], r["key"]): (r["value"], list(r["provenance_ids"])) for r in after.collect()}
    assert values["m", "mean_commute_minutes"][0] == 30 and values["n", "mean_commute_minutes"] == (21, ["dp"])
    assert values["m", "public_dc_ports_per_100k"] == (7, ["af", "a"]) and values["n", "population_share_in_counties_with_dc"] == (None, [])
    touched = {"mean_commute_minutes", *markets.CHARGING_KEYS}
    same = lambda df: df.where(~F.col("key").isin(*touched))
    assert same(before).exceptAll(same(after)).isEmpty() and before.count() == after.count()


def test_ratio_mismatches(spark):
    features = markets.market_features(estimates(spark), None, None, None, SOURCES)
    e = estimates(spark).withColumnRenamed("metro", "entity_id")
    assert markets.ratio_mismatches(features, e).isEmpty()
    wrong = features.withColumn("value", F.when(F.col("key") == "population", F.col("value") + 1).otherwise(F.col("value")))
    assert rows(markets.ratio_mismatches(wrong, e), "entity_id", "key") == [("m", "population"), ("n", "population")]


def test_edge_nodes_and_road_features(spark):
    schema = "edge_id string, from_node string, to_node string, from_x double, from_y double, to_x double, to_y double"
    edges = spark.createDataFrame([(c, "n1", f"p{c}", 0.0, 0.0, 9.0, 9.0) for c in "abcd"] + [("a", "n1", "n1", 0.0, 0.0, 0.0, 0.0), ("e", "0", None, 1.0, 1.0, 1.0, 1.0)], schema)
    assert rows(markets.edge_nodes(edges).where("degree >= 3"), "node", "degree") == [("n1", 4)]
    cols = "metro int, county int, road_class string, length_km double, from_node long, to_node long, from_x double, from_y double, to_x double, to_y double"
    star = [(m, 1, "local" if i else "freeway", 1.0, 1, 10 + i, 0.0, 0.0, 100.0 * i, 50.0) for m in (1, 2) for i in range(4)]
    near = [(1, 1, "arterial", 2.0, 2, 20 + i, 10.0, 0.0, -100.0 * i, -50.0) for i in range(3)]
    areas = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 1.0)], "metro int, land_area_km2 double")
    got = {r["metro"]: r for r in markets.road_features(spark.createDataFrame(star + near, cols), areas).collect()}
    assert (got[1]["intersections"], got[2]["intersections"], got[3]["intersections"]) == (1, 1, 0)
    assert got[1]["freeway_share"] == pytest.approx(0.1) and got[2]["intersection_density_per_km2"] == 0.25
    assert got[3]["freeway_share"] is None and got[3]["intersection_density_per_km2"] is None


def test_playback_order(spark):
    df = spark.createDataFrame([(2, 5.0, 6.0), (1, 3.0, 4.0), (1, 0.0, 3.0), (2, 0.0, 5.0)], "vehicle_id long, start_minute double, end_minute double")
    assert [tuple(r)[:2] for r in fleet.playback_order(df).collect()] == [(1, 0.0), (1, 3.0), (2, 0.0), (2, 5.0)]
