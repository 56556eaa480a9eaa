"""Registered queries of the composite market jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrosift.operators import audit, markets
from metrosift.operators.joins import join_lookup
from metrosift.operators.spatial import off_border
from metrosift.plans import scoring as sc
from metrosift.plans.common import SQL_OFF_BORDER, big, board, point_x, point_y, r4, sql_x, sql_y, table
from metrosift.plans.graph import SUPPLIER_BASE
from metrosift.plans.spatial import _INSIDE, _SHAPES, _nation_shapes


def area_catalog(spark, folder):
    """Nations as areas; customers stand for counties, placed by their point."""
    k = F.col("c_custkey")
    counties = table(spark, folder, "customer").select(
        F.lpad(k.cast("string"), 9, "0").alias("point_id"), point_x(k).alias("x"), point_y(k).alias("y"),
        (k * 1000).alias("land_m2"), F.substring("c_mktsegment", 1, 2).alias("state"))
    areas = _nation_shapes(spark, folder).join(
        table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("polygon_id"), F.col("n_name").alias("name"), "n_regionkey"), "polygon_id")
    roles = areas.select("polygon_id", F.when(F.col("n_regionkey") == 0, "reference").when(F.col("n_regionkey") < 3, "candidate").alias("role"))
    catalog, _ = markets.area_catalog(areas, counties, roles)
    return catalog.select("metro", "name", r4("land_area_km2").alias("land_area_km2"), F.array_join("state_codes", ",").alias("states"),
                          "member_counties", "candidate_market", "reference_market")


def _estimates(spark, folder):
    """Census-like counts per nation from customers and their orders."""
    wide = sc.market_wide(spark, folder)
    people = F.col("population")
    return wide.select(
        F.substring("entity_id", 6, 5).cast("int").alias("metro"), people.alias("population"), (people / F.col("population_density_per_km2")).alias("land_area_km2"),
        people.alias("households"), F.round(F.col("zero_vehicle_household_share") * people).alias("zero_vehicle_households"),
        people.alias("workers"), F.round(F.col("transit_commute_share") * people).alias("transit_workers"), "mean_commute_minutes",
        *[F.col(c) for c in markets.CLIMATE_KEYS],
        F.col("public_dc_ports_per_100k").alias("ports_per_100k"), F.col("population_share_in_counties_with_dc").alias("population_share_with_ports"))


def _features(spark, folder, roads=None):
    e = _estimates(spark, folder)
    charging = e.select("metro", "ports_per_100k", "population_share_with_ports")
    climate = e.select("metro", *markets.CLIMATE_KEYS)
    base = e.drop("ports_per_100k", "population_share_with_ports", *markets.CLIMATE_KEYS)
    return markets.market_features(base, charging, roads, climate, {"acs": "a", "charging": "c", "roads": "r", "climate": "n"})




def _rows(features):
    return features.select("entity_id", "key", r4("value").alias("value"), "quality", F.array_join("provenance_ids", ",").alias("cited"))


def market_features(spark, folder):
    """17 measurements per nation from all four sources; two that no source reports are missing."""
    return _rows(_features(spark, folder, _roads(spark, folder)))


def refresh_features(spark, folder):
    """Charging rewritten with doubled rates, and no value where the nation number is even."""
    features = _features(spark, folder, _roads(spark, folder))
    new = _estimates(spark, folder).select(
        F.col("metro").alias("entity_id"), (F.col("ports_per_100k") * 2).alias("ports_per_100k"),
        F.when(F.col("metro") % 2 == 1, F.col("population_share_with_ports")).alias("population_share_with_ports"))
    commute = new.select("entity_id", F.lit(30.0).alias("value"))
    return _rows(markets.refresh(features, commute, new))


def ratio_verification(spark, folder):
    """Measurements against their estimates; every fifth nation's share is altered first."""
    features = _features(spark, folder)
    broken = features.withColumn("value", F.when((F.col("entity_id") % 5 == 2) & (F.col("key") == "transit_commute_share"), F.col("value") + 0.1).otherwise(F.col("value")))
    out = markets.ratio_mismatches(broken, _estimates(spark, folder).withColumnRenamed("metro", "entity_id"))
    return out.select("entity_id", "key", r4("source_value").alias("source_value"), r4("release_value").alias("release_value"), "status")


def charging_verification(spark, folder):
    """Recorded sites of suppliers with three kinds of errors planted."""
    k = F.col("s_suppkey")
    s = table(spark, folder, "supplier")
    stations = s.select(k.alias("id"), F.lit("E").alias("status_code"), F.lit("public").alias("access_code"), point_y(k).alias("latitude"),
                        point_x(k).alias("longitude"), F.array((k % 7).cast("string")).alias("ev_dc_fast_num"))
    x, y = point_x(k), point_y(k)
    home = (F.floor(x / 20) + 5 * F.floor(y / 20)).cast("long")
    recorded = s.where("s_suppkey % 11 <> 0").select(
        k.alias("id"), F.when(k % 13 == 0, home + 1).otherwise(home).alias("metro"), F.when(k % 5 == 0, k % 7 + 1).otherwise(k % 7).alias("dc_fast_ports"))
    return markets.charging_mismatches(stations, recorded, _nation_shapes(spark, folder))


def network_intersections(spark, folder):
    """Nodes off the border by distinct incident orders: parts and suppliers as nodes of order edges."""
    p, q = F.col("l_partkey") + 1, F.col("l_suppkey") + SUPPLIER_BASE
    edges = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("edge_id"), p.alias("from_node"), q.alias("to_node"), point_x(p).alias("from_x"), point_y(p).alias("from_y"),
        point_x(q).alias("to_x"), point_y(q).alias("to_y"))
    out = off_border(markets.edge_nodes(edges).where("degree >= 3"), board(spark), 2.0, "node")
    return out.select("node", big("degree").alias("degree"), r4("x").alias("x"), r4("y").alias("y"))


def _roads(spark, folder):
    """Line items as roads of the supplier's nation."""
    p, q = F.col("l_partkey") + 1, F.col("l_suppkey") + SUPPLIER_BASE
    kind = F.element_at(F.array(*[F.lit(x) for x in ("freeway", "arterial", "local")]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    home = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    edges = join_lookup(table(spark, folder, "lineitem"), home, ["l_suppkey"]).select(
        F.col("s_nationkey").alias("metro"), F.col("l_linenumber").alias("county"), kind.alias("road_class"), F.col("l_quantity").alias("length_km"),
        p.alias("from_node"), q.alias("to_node"), point_x(p).alias("from_x"), point_y(p).alias("from_y"), point_x(q).alias("to_x"), point_y(q).alias("to_y"))
    areas = table(spark, folder, "nation").select(F.col("n_nationkey").alias("metro"), F.lit(100.0).alias("land_area_km2"))
    return markets.road_features(edges, areas, 0.3)


def road_features(spark, folder):
    """Lengths, class shares, road and intersection density per nation."""
    return _roads(spark, folder).select("metro", big("intersections").alias("intersections"), r4("total_km").alias("total_km"), *[
        r4(c).alias(c) for c in markets.ROAD_KEYS])


def reference_status(spark, folder):
    """Reference rows from two sources: tuples found in one of them only."""
    recorded = sc.references(spark, folder).select("id", "entity_id", "category", "enabled")
    found = recorded.withColumn("category", F.when(F.col("id") == "ref-10", "announced").otherwise(F.col("category")))
    return audit.table_differences(found, recorded)


QUERIES = {f.__name__: f for f in (
    area_catalog, market_features, refresh_features, ratio_verification, charging_verification, network_intersections, road_features,
    reference_status,
)}

_M = sc._MARKETS
_KEYS = "', '".join(k for k in ("population", "population_density_per_km2", "mean_commute_minutes", "zero_vehicle_household_share", "transit_commute_share"))
_ROADS = f"""e AS (SELECT s_nationkey m, l_partkey + 1 a, l_suppkey + {SUPPLIER_BASE} b, l_quantity q, l_linenumber % 3 c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    ends AS (SELECT m, node, CAST({sql_x('node')} AS DOUBLE) x, CAST({sql_y('node')} AS DOUBLE) y FROM (SELECT m, a node FROM e UNION ALL SELECT m, b FROM e) GROUP BY 1, 2 HAVING count(*) >= 3),
    links AS (SELECT p.m, p.node a, q.node b FROM ends p JOIN ends q ON p.m = q.m AND abs(p.x - q.x) <= 0.3 AND abs(p.y - q.y) <= 0.3 AND pow(p.x - q.x, 2) + pow(p.y - q.y, 2) <= 0.09),
    reach AS (SELECT m, a node, b FROM links UNION SELECT reach.m, reach.node, links.b FROM reach JOIN links ON links.a = reach.b AND links.m = reach.m),
    i AS (SELECT m, count(DISTINCT c) k FROM (SELECT m, node, min(b) c FROM reach GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT m, sum(q) q, sum(q) FILTER (c = 0) f, sum(q) FILTER (c = 1) ar, sum(q) FILTER (c = 2) lo FROM e GROUP BY 1),
    roads AS MATERIALIZED (SELECT n_nationkey metro, coalesce(k, 0) intersections, coalesce(q, 0) total_km, CASE WHEN q > 0 THEN q / 100.0::DOUBLE END road_density_km_per_km2,
        CASE WHEN q > 0 THEN coalesce(k, 0) / 100.0::DOUBLE END intersection_density_per_km2, coalesce(f, 0) / q freeway_share, coalesce(ar, 0) / q arterial_share, coalesce(lo, 0) / q local_road_share
        FROM nation LEFT JOIN t ON t.m = n_nationkey LEFT JOIN i ON i.m = n_nationkey)"""
_ROAD_KEYS = ", ".join(markets.ROAD_KEYS)
_ALL = f"""{_M.replace("WITH ", "WITH RECURSIVE ", 1)}, {_ROADS}, a AS (SELECT CAST(substring(entity_id, 6, 5) AS INT) entity_id, key, value FROM feat
    UNION ALL SELECT metro, key, value FROM (SELECT metro, {_ROAD_KEYS} FROM roads) UNPIVOT INCLUDE NULLS (value FOR key IN ({_ROAD_KEYS}))
    UNION ALL SELECT n_nationkey, unnest(['average_aadt', 'lane_miles_per_km2']), NULL FROM nation),
    b AS (SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN key = 'population' THEN 'observed' WHEN key IN ('annual_precipitation_mm', 'annual_snowfall_mm', 'hot_days_32c') THEN 'proxy' ELSE 'derived' END quality,
    CASE WHEN value IS NULL THEN '' WHEN key IN ('{_KEYS}') THEN 'a' WHEN key LIKE '%_dc%' THEN 'c' WHEN key IN ('{"', '".join(markets.ROAD_KEYS)}') THEN 'r' ELSE 'n' END cited FROM a)"""

ORACLES = {
    "area_catalog": f"""WITH {_SHAPES}, points AS (SELECT c_custkey k, CAST({sql_x('c_custkey')} AS DOUBLE) x, CAST({sql_y('c_custkey')} AS DOUBLE) y, substring(c_mktsegment, 1, 2) st FROM customer),
        m AS (SELECT polygon_id, sum(k * 1000) / 1e6 land, string_agg(DISTINCT st, ',' ORDER BY st) states, count(*) n FROM points JOIN shapes ON {_INSIDE} GROUP BY 1)
        SELECT CAST(n_nationkey AS BIGINT) AS metro, n_name AS name, round(CAST(land AS DOUBLE), 4) + 0.0 AS land_area_km2, states, n AS member_counties, n_regionkey IN (1, 2) AS candidate_market, n_regionkey = 0 AS reference_market
        FROM nation LEFT JOIN m ON polygon_id = n_nationkey""",
    "market_features": f"{_ALL} SELECT entity_id, key, round(value, 4) + 0.0 AS value, quality, cited FROM b",
    "refresh_features": f"""{_ALL}, c AS (SELECT entity_id, key, CASE WHEN key = 'public_dc_ports_per_100k' THEN value * 2 WHEN key LIKE '%_dc' AND entity_id % 2 = 0 THEN NULL ELSE value END v, quality, cited FROM b)
        SELECT entity_id, key, round(v, 4) + 0.0 AS value, CASE WHEN key LIKE '%_dc%' AND v IS NULL THEN 'missing' ELSE quality END AS quality,
        CASE WHEN key LIKE '%_dc%' THEN CASE WHEN v IS NULL THEN '' ELSE 'charging,a' END ELSE cited END AS cited FROM c""",
    "ratio_verification": f"""{_ALL} SELECT entity_id, key, round(value, 4) + 0.0 AS source_value, round(value + 0.1, 4) + 0.0 AS release_value, 'different' AS status FROM b
        WHERE key = 'transit_commute_share' AND entity_id % 5 = 2""",
    "charging_verification": f"""WITH {_SHAPES}, s AS (SELECT s_suppkey k, CAST({sql_x('s_suppkey')} AS DOUBLE) x, CAST({sql_y('s_suppkey')} AS DOUBLE) y FROM supplier),
        t AS (SELECT k, polygon_id FROM s JOIN shapes ON {_INSIDE} WHERE k % 7 > 0), r AS (SELECT *, CAST(floor(x / 20) + 5 * floor(y / 20) AS BIGINT) + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END metro FROM s WHERE k % 11 <> 0)
        SELECT k AS id, CASE WHEN polygon_id IS NULL THEN 'not qualifying' WHEN metro IS NULL THEN 'omitted' WHEN metro <> polygon_id THEN 'area' ELSE 'ports' END AS problem
        FROM r FULL JOIN t USING (k) WHERE polygon_id IS NULL OR metro IS NULL OR metro <> polygon_id OR k % 5 = 0""",
    "network_intersections": f"""WITH e AS (SELECT l_orderkey o, l_partkey + 1 node FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey + {SUPPLIER_BASE} FROM lineitem)
        SELECT CAST(node AS VARCHAR) AS node, degree, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM (SELECT node, count(DISTINCT o) degree, CAST({sql_x('node')} AS DOUBLE) x, CAST({sql_y('node')} AS DOUBLE) y
        FROM e GROUP BY node) WHERE degree >= 3 AND {SQL_OFF_BORDER}""",
    "road_features": f"""WITH RECURSIVE {_ROADS} SELECT metro, intersections, round(total_km, 4) + 0.0 AS total_km,
        {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in markets.ROAD_KEYS)} FROM roads""",
    "reference_status": f"""{_M}, r AS (SELECT {sc._REF_COLUMNS}, 'commercial' category FROM wide WHERE n_nationkey = 10)
        SELECT reference_id AS id, entity_id, 'announced' AS category, true AS enabled, 'first' AS side FROM r UNION ALL SELECT reference_id, entity_id, 'commercial', true, 'second' FROM r""",
}
