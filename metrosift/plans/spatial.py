"""Registered queries of the spatial joins and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrosift.operators import spatial, zones
from metrosift.operators.matching import add_matches, group_references
from metrosift.plans.common import big, point_x, point_y, r4, sql_x, sql_y, table


def _customer_points(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(k.alias("point_id"), point_x(k).alias("x"), point_y(k).alias("y"))


def _square(x0, y0, low, high):
    return F.array(*[F.struct((x0 + a).alias("x"), (y0 + b).alias("y")) for a, b in ((low, low), (high, low), (high, high), (low, high))])


def _nation_shapes(spark, folder):
    """Two parts per nation on a 5 x 5 board of 20 x 20 squares: an L with a hole, and in its corner a square with a hole."""
    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("polygon_id"))
    x0, y0 = F.pmod("polygon_id", F.lit(5)) * 20.0, F.floor(F.col("polygon_id") / 5) * 20.0
    corners = [(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)]
    outline = F.array(*[F.struct((x0 + a).alias("x"), (y0 + b).alias("y")) for a, b in corners])
    return n.withColumn("shape", F.array(F.array(outline, _square(x0, y0, 2, 6)), F.array(_square(x0, y0, 12, 18), _square(x0, y0, 14, 16))))


def point_in_polygon(spark, folder):
    out = spatial.assign_points(_customer_points(spark, folder), _nation_shapes(spark, folder))
    return out.select("point_id", "polygon_id")


def points_per_polygon(spark, folder):
    pairs = spatial.points_in_polygons(_customer_points(spark, folder), _nation_shapes(spark, folder))
    return pairs.groupBy("polygon_id").agg(F.count(F.lit(1)).alias("points"))


def _places(spark, folder):
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        k.alias("place_id"), (25 + F.pmod(k * 37, F.lit(2003)) / 100.0).alias("lat"),
        (-120 + F.pmod(k * 91, F.lit(5003)) / 100.0).alias("lon"))


def _stations(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        k.alias("station_id"), (25 + F.pmod(k * 7919, F.lit(20011)) / 1000.0).alias("lat"),
        (-120 + F.pmod(k * 104729, F.lit(50021)) / 1000.0).alias("lon"), "c_acctbal")


def nearest_station(spark, folder):
    """Each supplier's nearest reporting customer station per data type within 100 km."""
    k = F.col("station_id")
    kinds = F.array_compact(F.array(F.when(k % 3 > 0, "precipitation"), F.when((k % 4 > 0) & (F.col("c_acctbal") >= 0), "snowfall")))
    stations = _stations(spark, folder).select("station_id", "lat", "lon", F.explode(kinds).alias("datatype"))
    out = spatial.nearest_stations(_places(spark, folder), stations, 1, 100.0, "datatype")
    return out.select("place_id", "datatype", "station_id", r4("distance_km").alias("distance_km"))


def nearest3_avg(spark, folder):
    """Mean over up to three nearest stations with a usable count of at most 366."""
    stations = _stations(spark, folder).where("c_acctbal >= 0").withColumn("days", F.col("c_acctbal") / 10).where("days <= 366")
    near = spatial.nearest_stations(_places(spark, folder), stations.drop("c_acctbal"), 3, 100.0)
    return near.groupBy("place_id").agg(
        r4(F.avg("days")).alias("hot_days"), F.count(F.lit(1)).alias("stations"), F.min("station_id").alias("lowest_station"))


def nearest_complete_mean(spark, folder):
    k = F.col("station_id")
    stations = _stations(spark, folder).select(
        "station_id", "lat", "lon", F.when(k % 3 > 0, F.col("c_acctbal")).alias("rain"),
        F.when(k % 5 > 0, k % 400).cast("double").alias("snow"))
    out = spatial.nearest_complete_mean(_places(spark, folder), stations, ["rain", "snow"], 3, 100.0)
    return out.select("place_id", r4("rain").alias("rain"), r4("snow").alias("snow"), "stations")


def _depots(spark, folder):
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(k.alias("place_id"), point_x(k + 5000).alias("place_x"), point_y(k + 5000).alias("place_y"))


def _weighted_points(spark, folder):
    return _customer_points(spark, folder).withColumn("weight", F.col("point_id") % 9 + 1)


def radius_band_neighbors(spark, folder):
    out = spatial.radius_neighbors(_depots(spark, folder), _weighted_points(spark, folder), 0.5, 2.0)
    return out.select("place_id", "point_id", r4("distance").alias("distance"), r4("share").alias("share"))


def nearest_beyond(spark, folder):
    """Where a leg towards the nearest far-enough point ends, for every depot."""
    out = spatial.nearest_beyond(_depots(spark, folder), _customer_points(spark, folder), 0.5, 0.75)
    return out.select("place_id", "point_id", *[r4(c).alias(c) for c in ("distance", "end_x", "end_y")])


def snap_to_edge(spark, folder):
    p = F.col("l_partkey")
    x, y = point_x(p), point_y(p)
    segments = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("edge_id"), F.col("l_linenumber").alias("seg"), x.alias("ax"), y.alias("ay"),
        (x + (F.pmod(F.col("l_suppkey") * 31, F.lit(201)) - 100) / 100.0).alias("bx"),
        (y + (F.pmod(F.col("l_suppkey") * 17, F.lit(201)) - 100) / 100.0).alias("by"), F.col("l_quantity").alias("start"))
    # Lines with the same ends are one segment; the lowest one wins as it would in a tie.
    merged = segments.groupBy("ax", "ay", "bx", "by").agg(F.min(F.struct("edge_id", "seg", "start")).alias("m")).select(
        "ax", "ay", "bx", "by", "m.*")
    out = spatial.snap_to_segments(_customer_points(spark, folder), merged, 0.5)
    return out.select("point_id", "edge_id", "seg", *[r4(c).alias(c) for c in ("distance", "along", "snap_x", "snap_y")])


def in_polygon_sample(spark, folder):
    """32 seeded points inside an L-shape at every supplier."""
    k = F.col("s_suppkey")
    corners = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    shapes = table(spark, folder, "supplier").select(k.alias("polygon_id"), F.array(*[
        F.struct((point_x(k) + a).alias("x"), (point_y(k) + b).alias("y")) for a, b in corners]).alias("ring"))
    out = spatial.sample_in_polygons(shapes, 32, "seed")
    return out.select("polygon_id", big("sample").alias("sample"), big("attempt").alias("attempt"), r4("x").alias("x"), r4("y").alias("y"))


def weighted_choice(spark, folder):
    weighted = table(spark, folder, "part").select(F.col("p_partkey").alias("zone_id"), F.col("p_size").cast("long").alias("weight"))
    requests = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"), spatial.hash_uniform(F.lit("zone"), F.col("o_orderkey")).alias("u"))
    return spatial.weighted_choice(requests, weighted)


def nearest_vector(spark, folder):
    """Three nearest other vectors of every vector; copies of one vector count as their lowest id."""
    e = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("entity_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    refs = e.select(F.format_string("%09d", "vec_id").alias("reference_id"), "entity_id", "v")
    out = add_matches(e, group_references(refs, F.col("v")), F.col("v"), [1 / 64] * 64)
    return out.select("vec_id", F.posexplode("matches").alias("i", "m")).select(
        "vec_id", big(F.col("i") + 1).alias("position"), "m.reference_id", r4("m.distance").alias("distance"))


def charging_by_location(spark, folder):
    """Sites placed by point-in-polygon instead of by their recorded metro."""
    k = F.col("s_suppkey")
    points = table(spark, folder, "supplier").where("s_suppkey % 7 > 0").select(
        k.alias("point_id"), point_x(k).alias("x"), point_y(k).alias("y"), (k % 7).alias("ports"))
    placed = spatial.assign_points(points, _nation_shapes(spark, folder)).where("polygon_id IS NOT NULL")
    return placed.groupBy(F.col("polygon_id").alias("metro")).agg(
        F.sum("ports").cast("long").alias("ports"), F.count(F.lit(1)).alias("sites"))


def zone_profile(spark, folder):
    """Nations as zones in degrees: area, points, weighted origin and local miles there and back."""
    degrees = F.transform("shape", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(
        (p["x"] / 100 - 75).alias("x"), (p["y"] / 100 + 41).alias("y")))))
    n = _nation_shapes(spark, folder).withColumn("shape", degrees).withColumn("produced", F.pmod(F.col("polygon_id") * 7, F.lit(11)) + 1)
    out = zones.local_zones(n.withColumnRenamed("polygon_id", "zone_id"), "produced")
    back = zones.degrees_of(*[F.col(c) for c in ("x_miles", "y_miles", "origin_lon", "origin_lat")])
    return out.select("zone_id", r4(F.col("area") * 10_000).alias("area"), *[r4(c, 6).alias(c) for c in (
        "centroid_lon", "centroid_lat", "lon", "lat", "origin_lon", "origin_lat")], r4("x_miles").alias("x_miles"), r4("y_miles").alias("y_miles"),
        r4(back["lon"], 5).alias("back_lon"), r4(back["lat"], 5).alias("back_lat"))


QUERIES = {f.__name__: f for f in (
    zone_profile, point_in_polygon, points_per_polygon, charging_by_location, nearest_station, nearest3_avg, nearest_complete_mean,
    radius_band_neighbors, nearest_beyond, snap_to_edge, in_polygon_sample, weighted_choice, nearest_vector,
)}

_INSIDE = """((x > x0 AND x < x0 + 20 AND y > y0 AND y < y0 + 20 AND NOT (x >= x0 + 10 AND y >= y0 + 10) AND NOT (x BETWEEN x0 + 2 AND x0 + 6 AND y BETWEEN y0 + 2 AND y0 + 6))
    OR (x > x0 + 12 AND x < x0 + 18 AND y > y0 + 12 AND y < y0 + 18 AND NOT (x BETWEEN x0 + 14 AND x0 + 16 AND y BETWEEN y0 + 14 AND y0 + 16)))"""
_SHAPES = "shapes AS (SELECT CAST(n_nationkey AS BIGINT) polygon_id, (n_nationkey % 5) * 20.0::DOUBLE x0, (n_nationkey // 5) * 20.0::DOUBLE y0 FROM nation)"
_POINTS = f"points AS (SELECT c_custkey point_id, CAST({sql_x('c_custkey')} AS DOUBLE) x, CAST({sql_y('c_custkey')} AS DOUBLE) y FROM customer)"
_NEAR = """places AS (SELECT s_suppkey place_id, 25 + CAST((s_suppkey * 37) % 2003 AS DOUBLE) / 100 lat, -120 + CAST((s_suppkey * 91) % 5003 AS DOUBLE) / 100 lon FROM supplier),
    stations AS (SELECT c_custkey station_id, 25 + CAST((c_custkey * 7919) % 20011 AS DOUBLE) / 1000 slat, -120 + CAST((c_custkey * 104729) % 50021 AS DOUBLE) / 1000 slon, c_acctbal FROM customer),
    near AS (SELECT * FROM (SELECT *, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2)))) d
    FROM places CROSS JOIN stations WHERE abs(slat - lat) < 1) WHERE d <= 100)"""
_DEPOTS = f"depots AS (SELECT s_suppkey place_id, CAST({sql_x('s_suppkey + 5000')} AS DOUBLE) px, CAST({sql_y('s_suppkey + 5000')} AS DOUBLE) py FROM supplier)"

ORACLES = {
    "zone_profile": f"""WITH {_SHAPES}, z AS (SELECT polygon_id zone_id, polygon_id * 7 % 11 + 1 w, x0 / 100 - 75 x, y0 / 100 + 41 y FROM shapes),
        p AS (SELECT *, x + 0.05 lon, y + 0.15 lat FROM z), o AS (SELECT round(sum(lon * w) / sum(w), 8) ox, round(sum(lat * w) / sum(w), 8) oy FROM p)
        SELECT zone_id, 316.0::DOUBLE AS area, round(x + 29.16 / 316, 6) + 0.0 AS centroid_lon, round(y + 29.16 / 316, 6) + 0.0 AS centroid_lat, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat,
        round(ox, 6) + 0.0 AS origin_lon, round(oy, 6) + 0.0 AS origin_lat, round((lon - ox) * 69.172 * cos(radians(oy)), 4) + 0.0 AS x_miles, round((lat - oy) * 69.0, 4) + 0.0 AS y_miles,
        round(lon, 5) + 0.0 AS back_lon, round(lat, 5) + 0.0 AS back_lat FROM p, o""",
    "point_in_polygon": f"WITH {_SHAPES}, {_POINTS} SELECT point_id, polygon_id FROM points LEFT JOIN shapes ON {_INSIDE}",
    "points_per_polygon": f"WITH {_SHAPES}, {_POINTS} SELECT polygon_id, count(*) AS points FROM points JOIN shapes ON {_INSIDE} GROUP BY 1",
    "charging_by_location": f"""WITH {_SHAPES}, points AS (SELECT s_suppkey k, CAST({sql_x('s_suppkey')} AS DOUBLE) x, CAST({sql_y('s_suppkey')} AS DOUBLE) y FROM supplier WHERE s_suppkey % 7 > 0)
        SELECT polygon_id AS metro, CAST(sum(k % 7) AS BIGINT) AS ports, count(*) AS sites FROM points JOIN shapes ON {_INSIDE} GROUP BY 1""",
    "nearest_station": f"""WITH {_NEAR}, kinds AS (SELECT *, 'precipitation' datatype FROM near WHERE station_id % 3 > 0
        UNION ALL SELECT *, 'snowfall' FROM near WHERE station_id % 4 > 0 AND c_acctbal >= 0)
        SELECT place_id, datatype, station_id, round(d, 4) + 0.0 AS distance_km FROM kinds
        QUALIFY row_number() OVER (PARTITION BY place_id, datatype ORDER BY d, station_id) = 1""",
    "nearest3_avg": f"""WITH {_NEAR}, top AS (SELECT * FROM near WHERE c_acctbal >= 0 AND c_acctbal / 10 <= 366
        QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY d, station_id) <= 3)
        SELECT place_id, round(avg(c_acctbal / 10), 4) + 0.0 AS hot_days, count(*) AS stations, min(station_id) AS lowest_station FROM top GROUP BY 1""",
    "nearest_complete_mean": f"""WITH {_NEAR}, top AS (SELECT * FROM near WHERE c_acctbal >= 0 AND station_id % 3 > 0 AND station_id % 5 > 0
        QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY d, station_id) <= 3)
        SELECT place_id, round(avg(c_acctbal), 4) + 0.0 AS rain, round(avg(station_id % 400), 4) + 0.0 AS snow, count(*) AS stations FROM top GROUP BY 1""",
    "radius_band_neighbors": f"""WITH {_DEPOTS}, {_POINTS}, pairs AS (SELECT place_id, point_id, sqrt(pow(x - px, 2) + pow(y - py, 2)) d, point_id % 9 + 1 w FROM depots JOIN points ON abs(x - px) <= 2 AND abs(y - py) <= 2)
        SELECT place_id, point_id, round(d, 4) + 0.0 AS distance, round(CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY place_id), 4) + 0.0 AS share FROM pairs WHERE d BETWEEN 0.5 AND 2""",
    "nearest_beyond": f"""WITH {_DEPOTS}, {_POINTS}, pairs AS (SELECT *, sqrt(pow(x - px, 2) + pow(y - py, 2)) d FROM depots CROSS JOIN points),
        best AS (SELECT * FROM pairs WHERE d >= 0.5 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY d, point_id) = 1)
        SELECT place_id, point_id, round(d, 4) + 0.0 AS distance, round(px + (x - px) * least(1, 0.75 / d), 4) + 0.0 AS end_x, round(py + (y - py) * least(1, 0.75 / d), 4) + 0.0 AS end_y FROM best""",
    "snap_to_edge": f"""WITH {_POINTS}, line AS (SELECT l_orderkey e, l_linenumber s, CAST(l_quantity AS DOUBLE) q, CAST({sql_x('l_partkey')} AS DOUBLE) ax, CAST({sql_y('l_partkey')} AS DOUBLE) ay,
        CAST(((l_suppkey * 31) % 201 - 100) / 100.0 AS DOUBLE) ox, CAST(((l_suppkey * 17) % 201 - 100) / 100.0 AS DOUBLE) oy FROM lineitem),
        seg AS (SELECT ax, ay, ax + ox bx, ay + oy AS "by", min({{'e': e, 's': s, 'q': q}}) m FROM line GROUP BY ALL),
        near AS (SELECT point_id, x, y, ax, ay, bx - ax dx, "by" - ay dy, m FROM points JOIN seg ON x BETWEEN ax - 1.5 AND ax + 1.5 AND y BETWEEN ay - 1.5 AND ay + 1.5),
        part AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(1, greatest(0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END f FROM near),
        far AS (SELECT *, sqrt(pow(x - (ax + dx * f), 2) + pow(y - (ay + dy * f), 2)) d FROM part)
        SELECT point_id, m.e AS edge_id, m.s AS seg, round(d, 4) + 0.0 AS distance, round(m.q + f * sqrt(dx * dx + dy * dy), 4) + 0.0 AS along, round(ax + f * dx, 4) + 0.0 AS snap_x, round(ay + f * dy, 4) + 0.0 AS snap_y
        FROM far WHERE d <= 0.5 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(d, 9), m.e, m.s) = 1""",
    "in_polygon_sample": f"""WITH u AS (SELECT s_suppkey k, i, CAST(('0x' || substring(md5('seed:' || s_suppkey || ':' || i || ':x'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE ux,
        CAST(('0x' || substring(md5('seed:' || s_suppkey || ':' || i || ':y'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE uy FROM supplier CROSS JOIN range(256) r(i)),
        kept AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) - 1 n FROM u WHERE NOT (ux >= 0.5 AND uy >= 0.5))
        SELECT k AS polygon_id, n AS sample, i AS attempt, round({sql_x('k')} + ux * 2, 4) + 0.0 AS x, round({sql_y('k')} + uy * 2, 4) + 0.0 AS y FROM kept WHERE n < 32""",
    "weighted_choice": """WITH z AS (SELECT p_partkey zone_id, sum(p_size) OVER (ORDER BY p_partkey) - p_size s FROM part WHERE p_size > 0),
        r AS (SELECT o_orderkey request_id, CAST(floor(CAST(('0x' || substring(md5('zone:' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * (SELECT sum(p_size) FROM part)) AS BIGINT) t FROM orders)
        SELECT request_id, zone_id FROM r ASOF JOIN z ON r.t >= z.s""",
    "nearest_vector": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings),
        copies AS (SELECT v, list_sort(list(vec_id)) ids FROM e GROUP BY v),
        d AS (SELECT e.vec_id, list_filter(ids, lambda i: i <> e.vec_id)[1] rid, list_distance(e.v, c.v) / 8 d FROM e JOIN copies c ON len(list_filter(ids, lambda i: i <> e.vec_id)) > 0)
        SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY d, rid) AS position, printf('%09d', rid) AS reference_id, round(d, 4) + 0.0 AS distance FROM d
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, rid) <= 3""",
}
