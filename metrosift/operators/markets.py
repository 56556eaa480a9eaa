"""Composite jobs: area catalog, road features, the 17 market measurements and their refresh."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrosift.functions.registry import FIFTEEN_FEATURES, UNSCORED_UNITS
from metrosift.operators import census, features as fx, graph
from metrosift.operators.audit import reconcile
from metrosift.operators.joins import join_lookup
from metrosift.operators.spatial import assign_points, points_in_polygons

ROAD_KEYS = ("road_density_km_per_km2", "intersection_density_per_km2", "freeway_share", "arterial_share", "local_road_share")
CLIMATE_KEYS = ("annual_precipitation_mm", "annual_snowfall_mm", "hot_days_32c")
CHARGING_KEYS = ("public_dc_ports_per_100k", "population_share_in_counties_with_dc")


def area_catalog(areas: DataFrame, counties: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, county map) of whole-county areas.

    ``areas``: polygon_id, name, shape (or ring). ``counties``: point_id, x, y (a point inside the
    county), land_m2, state. ``roles``: polygon_id, role (candidate or reference). A county
    belongs to the area its point lies within; an area's land and states are its counties'.
    """
    placed = assign_points(counties, areas).where("polygon_id IS NOT NULL")
    members = placed.select(F.col("point_id").alias("county"), F.col("polygon_id").alias("metro"), "state", "land_m2")
    rolled = census.area_rollup(members)
    flags = roles.groupBy(F.col("polygon_id").alias("metro")).agg(
        F.bool_or(F.col("role") == "candidate").alias("candidate_market"),
        F.bool_or(F.col("role") == "reference").alias("reference_market"))
    names = areas.select(F.col("polygon_id").alias("metro"), "name")
    catalog = names.join(rolled, "metro", "left").join(flags, "metro", "left").fillna(
        False, ["candidate_market", "reference_market"])
    return catalog, members.select("county", "metro", F.substring("county", 1, 2).alias("state_fips"))


def edge_nodes(edges: DataFrame) -> DataFrame:
    """(node, degree, x, y) with degree counting distinct incident edges, not endpoints.

    ``edges``: edge_id, from_node, to_node, from_x, from_y, to_x, to_y; node 0, blank or
    null is no node. A node's position is that of its lowest edge.
    """
    ends = edges.select("edge_id", F.explode(F.array(*[
        F.struct(F.col(f"{s}_node").cast("string").alias("node"), F.col(f"{s}_x").alias("x"), F.col(f"{s}_y").alias("y"))
        for s in ("from", "to")])).alias("e")).select("edge_id", "e.*")
    ends = ends.where("node IS NOT NULL AND trim(node) NOT IN ('', '0', 'None')")
    once = ends.groupBy("node", "edge_id").agg(F.min(F.struct("x", "y")).alias("p"))
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min(F.struct("edge_id", "p")).alias("m")).select(
        "node", "degree", F.col("m.p.x").alias("x"), F.col("m.p.y").alias("y"))


def road_features(edges: DataFrame, areas: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """Class shares, road density and intersection density per metro.

    ``edges``: metro, county, road_class, length_km and endpoint columns as in
    ``node_degrees``. Nodes of one metro within ``tolerance`` are one intersection.
    """
    lengths = edges.select("metro", "road_class", "length_km")
    shares = census.road_shares(lengths, areas)
    ends = edges.select("metro", "county", F.explode(F.array(*[
        F.struct(F.col(f"{b}_node").alias("node"), F.col(f"{b}_x").alias("x"), F.col(f"{b}_y").alias("y"))
        for b in ("from", "to")])).alias("e")).select("metro", "county", "e.*").where(
        "node > 0 AND x IS NOT NULL AND y IS NOT NULL")
    nodes = ends.groupBy("metro", "county", "node").agg(F.count(F.lit(1)).alias("d"), F.avg("x").alias("x"), F.avg("y").alias("y")).groupBy(
        "metro", "node").agg(F.sum("d").alias("degree"), F.min(F.struct("county", "x", "y")).alias("p")).where("degree >= 3")
    placed = nodes.select(F.struct("metro", "node").alias("node"), "metro", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    clusters = graph.proximity_clusters(placed, tolerance, by="metro").groupBy(F.col("node.metro").alias("metro"), "cluster").agg(
        F.lit(1).alias("one")).groupBy("metro").agg(F.sum("one").alias("intersections"))
    out = shares.join(areas, "metro").join(clusters, "metro", "left").fillna(0, ["intersections"])
    usable = (F.col("total_km") > 0) & (F.col("land_area_km2") > 0)
    return out.withColumn("intersection_density_per_km2", F.when(usable, F.col("intersections") / F.col("land_area_km2")))


def market_features(
    estimates: DataFrame, charging: DataFrame | None, roads: DataFrame | None, climate: DataFrame | None,
    sources: Mapping[str, str],
) -> DataFrame:
    """The 17 measurements of every market as long rows.

    ``estimates``: metro, population, land_area_km2, households, zero_vehicle_households,
    workers, transit_workers, mean_commute_minutes. ``charging``, ``roads`` and ``climate``
    are keyed by metro; None means the source was not retrieved, so its measurements are
    missing (never zero). ``sources`` maps acs, charging, roads, climate to provenance ids.
    """
    wide = estimates
    for table in (charging, roads, climate):
        if table is not None:
            keep = [c for c in table.columns if c == "metro" or c not in wide.columns]
            wide = wide.join(table.select(*keep), "metro", "left")
    population, land = F.col("population"), F.nullif(F.col("land_area_km2"), F.lit(0.0))

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.nullif(F.col(b), F.lit(0))

    units = {s.key: s.unit for s in FIFTEEN_FEATURES} | UNSCORED_UNITS
    null = F.lit(None).cast("double")
    cells: dict[str, tuple[Column, str, str, str]] = {
        "population": (population, "acs", "observed", "Population estimate unavailable."),
        "population_density_per_km2": (population / land, "acs", "derived", "Population or land area unavailable."),
        "mean_commute_minutes": (F.col("mean_commute_minutes"), "acs", "derived", "Mean commute estimate unavailable."),
        "zero_vehicle_household_share": (share("zero_vehicle_households", "households"), "acs", "derived", "Household estimates unavailable."),
        "transit_commute_share": (share("transit_workers", "workers"), "acs", "derived", "Worker estimates unavailable."),
    }
    names = {"public_dc_ports_per_100k": "ports_per_100k", "population_share_in_counties_with_dc": "population_share_with_ports"}
    for keys, table, source, quality in ((CHARGING_KEYS, charging, "charging", "derived"), (ROAD_KEYS, roads, "roads", "derived"),
                                         (CLIMATE_KEYS, climate, "climate", "proxy")):
        for key in keys:
            value = null if table is None else F.col(names.get(key, key))
            reason = f"The {source} source was not retrieved." if table is None else f"The {source} source has no complete value for this area."
            cells[key] = (value, source, quality, reason)
    for key in UNSCORED_UNITS:
        cells[key] = (null, "roads", "derived", "No complete comparable segment-level source was ingested.")
    rows = F.array(*[
        F.struct(F.lit(key).alias("key"), fx.measurement(value, units[key], F.array(F.lit(sources[source])), quality, reason).alias("m"))
        for key, (value, source, quality, reason) in cells.items()
    ])
    return wide.select(F.col("metro").alias("entity_id"), F.explode(rows).alias("r")).select("entity_id", "r.key", "r.m.*")


def refresh(
    features: DataFrame, commute: DataFrame | None = None, charging: DataFrame | None = None,
    commute_source: str = "commute", charging_source: str = "charging",
) -> DataFrame:
    """Targeted refresh: fill missing commutes and rewrite the two charging measurements.

    ``commute``: entity_id, value. ``charging``: entity_id, ports_per_100k and
    population_share_with_ports. Every other row is passed through unchanged.
    """
    out = features
    if commute is not None:
        out = fx.fill_from(out, "mean_commute_minutes", commute, commute_source)
    if charging is None:
        return out
    people = out.where("key = 'population'").select("entity_id", F.col("provenance_ids").alias("_p"))
    old = out.where(F.col("key").isin(*CHARGING_KEYS))
    new = charging.select("entity_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(c).cast("double").alias("_v"))
        for k, c in zip(CHARGING_KEYS, ("ports_per_100k", "population_share_with_ports"))])).alias("n")).select("entity_id", "n.*")
    joined = old.join(new, ["entity_id", "key"], "left").join(people, "entity_id", "left")
    ids = F.array_distinct(F.concat(F.array(F.lit(charging_source)), F.coalesce("_p", F.array().cast("array<string>"))))
    present = F.col("_v").isNotNull()
    rewritten = joined.select(
        "entity_id", "key", F.col("_v").alias("value"), "unit",
        F.when(present, "derived").otherwise("missing").alias("quality"),
        F.when(~present, "County population estimates are incomplete for this area.").alias("missing_reason"),
        F.when(present, ids).otherwise(F.array().cast("array<string>")).alias("provenance_ids"))
    return out.where(~F.col("key").isin(*CHARGING_KEYS)).unionByName(rewritten)


def ratio_mismatches(features: DataFrame, estimates: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Census measurements that their published estimates do not give.

    ``estimates``: entity_id, population, households, zero_vehicle_households, workers,
    transit_workers, mean_commute_minutes.
    """
    expected = estimates.select(
        "entity_id", F.col("population").cast("double").alias("population"),
        (F.col("zero_vehicle_households") / F.nullif(F.col("households"), F.lit(0))).alias("zero_vehicle_household_share"),
        (F.col("transit_workers") / F.nullif(F.col("workers"), F.lit(0))).alias("transit_commute_share"), "mean_commute_minutes")
    keys = expected.columns[1:]
    want = fx.to_long(expected, keys)
    have = features.where(F.col("key").isin(keys)).select("entity_id", "key", "value")
    return reconcile(want, have, ["entity_id", "key"], "value", tolerance).where("status <> 'equal'")


def charging_mismatches(stations: DataFrame, recorded: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, problem): recorded sites that an independent recount does not confirm.

    ``stations``: raw rows for ``qualifying_sites``. ``recorded``: id, metro, dc_fast_ports.
    ``areas``: polygon_id, shape (or ring). The recount filters the stations again and places them by
    the many-to-many containment join.
    """
    sites = census.qualifying_sites(stations)
    points = sites.select(F.col("id").alias("point_id"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    placed = points_in_polygons(points, areas).select(F.col("point_id").alias("id"), F.col("polygon_id").alias("_metro"))
    truth = join_lookup(placed, sites.select("id", F.col("dc_fast_ports").alias("_ports")), ["id"]).withColumn("_there", F.lit(True))
    joined = recorded.withColumn("_recorded", F.lit(True)).join(truth, "id", "full")
    problem = (
        F.when(F.col("_there").isNull(), "not qualifying").when(F.col("_recorded").isNull(), "omitted")
        .when(F.col("_metro") != F.col("metro"), "area").when(F.col("_ports") != F.col("dc_fast_ports"), "ports")
    )
    return joined.select("id", problem.alias("problem")).where("problem IS NOT NULL")
