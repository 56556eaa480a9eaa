"""Registered queries of the census, charging-site and road aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrosift.functions import parsing
from metrosift.operators import census, features as fx
from metrosift.operators.joins import join_lookup
from metrosift.plans.common import big, r4, table
from metrosift.plans.scoring import charging, sites
from metrosift.sources.readers import newest_complete_file


def ratio_of_sums(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("saved", F.col("l_extendedprice") * F.col("l_discount")).withColumn(
        "taxed", F.col("l_extendedprice") * F.col("l_tax"))
    out = census.ratio_of_sums(lines, ["l_suppkey"], {"saved_share": ("saved", "l_extendedprice"), "tax_share": ("taxed", "l_extendedprice"),
                                                      "saved_per_tax": ("saved", "taxed")})
    return out.select("l_suppkey", *[r4(c).alias(c) for c in ("saved_share", "tax_share", "saved_per_tax")])


def binned_mean(spark, folder):
    lines = table(spark, folder, "lineitem")
    bins = {f"bin_{i:02d}": m for i, m in enumerate(census.COMMUTE_MIDPOINTS)}
    spot = F.floor((F.col("l_quantity") - 1) * 12 / 50)
    rows = lines.select("l_suppkey", F.lit(1).alias("total"),
                        *[F.when(spot == i, 1).otherwise(0).alias(b) for i, b in enumerate(bins)])
    out = census.binned_mean(rows, ["l_suppkey"], bins, "total", "mean_minutes")
    return out.select("l_suppkey", big("total").alias("total"), r4("mean_minutes").alias("mean_minutes"))


def rate_per_100k(spark, folder):
    return charging(spark, folder).select("metro", big("ports").alias("ports"), r4("ports_per_100k").alias("ports_per_100k"))


def county_coverage(spark, folder):
    return charging(spark, folder).select("metro", big("population").alias("population"),
                                          r4("population_share_with_ports").alias("population_share_with_ports"))


def ports_by_county_map(spark, folder):
    out = census.ports_with_county_map(census.ports_by_area(sites(spark, folder)))
    entries = F.transform(F.array_sort(F.map_entries("county_ports")),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("metro", big("public_dc_ports").alias("public_dc_ports"), F.array_join(entries, ",").alias("county_ports"))


def qualifying_sites(spark, folder):
    """Suppliers as stations; every tenth is listed twice with the same content."""
    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    stations = s.withColumn("copy", F.explode(F.when(k % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(
        k.alias("id"), F.when(k % 3 == 0, "P").otherwise("E").alias("status_code"),
        F.when(k % 4 == 0, "PUBLIC").when(k % 4 == 1, "private").otherwise("public").alias("access_code"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("latitude"), F.col("s_acctbal").alias("longitude"),
        F.array((k % 7).cast("string"), F.lit("n/a"), F.lit("2")).alias("ev_dc_fast_num"))
    return census.qualifying_sites(stations).select("id", "latitude", "longitude", big("dc_fast_ports").alias("dc_fast_ports"))


def dedupe_conflicts(spark, folder):
    lines = table(spark, folder, "lineitem")
    out = census.merge_duplicates(lines, "l_partkey", ["l_returnflag", "l_linestatus"])
    return out.select("l_partkey", big("copies").alias("copies"), "conflict", "l_returnflag", "l_linestatus")


def _flagged(spark, folder):
    e = table(spark, folder, "events")
    kind, k = F.col("event_type"), F.col("user_id") % 6
    measure = F.when(kind == "click", " ").when(kind == "error", "M").when(kind == "purchase", "").otherwise("X")
    complete = F.when(k == 1, "S").when(k == 2, "R").when(k == 3, "P").when(k == 4, " ").when(k == 5, "E")
    text = F.when(F.col("event_id") % 17 == 0, "-9999").otherwise(F.col("value").cast("string"))
    return e.select("event_id", text.alias("text"), measure.alias("measure"), complete.alias("complete"))


def published_normal(spark, folder):
    rows = _flagged(spark, folder)
    return rows.select("event_id", r4(parsing.published_normal(F.col("text"), F.col("measure"), F.col("complete"))).alias("normal"))


def flag_frequencies(spark, folder):
    rows = _flagged(spark, folder).where("complete IS NOT NULL")
    return census.flag_frequencies(rows, F.col("measure"), F.col("complete"))


def moe_status(spark, folder):
    p = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("code"), F.col("p_retailprice").cast("long").alias("B01003_E001"),
        F.when(F.col("p_partkey") % 5 == 0, parsing.CONTROLLED_TOTAL_MARGIN).otherwise(F.col("p_size")).alias("B01003_M001"))
    return census.inspect_margins(p, "code", ["B01003_E001", "B01003_M001"], ["B01003_M001"])


def max_relative_margin(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    both = join_lookup(lines, table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    out = census.max_relative_margin(both, "o_totalprice", "l_extendedprice")
    return out.select(r4("max_relative_margin").alias("max_relative_margin"))


def strict_commute(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("o_totalprice")).alias("m")).join(
        c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    geo = F.concat(F.lit("310M700US"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0"))
    minutes = per.select(geo.alias("GEO_ID"), F.col("m").cast("string").alias("B08013_E001"), F.lit("400").alias("B08013_M001"))
    workers = per.select(geo.alias("GEO_ID"), F.col("n").cast("string").alias("B08303_E001"), F.lit("20").alias("B08303_M001"))
    codes = per.select(F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("code"))
    out = census.commute_ratio(minutes, workers, codes)
    return out.select("code", big("B08013_E001").alias("minutes"), big("B08303_E001").alias("workers"),
                      r4("mean_commute_minutes").alias("mean_commute_minutes"))


def tract_full_merge(spark, folder):
    """Three tables keyed by number; each has keys the others lack."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("size"))
    sold = table(spark, folder, "lineitem").groupBy((F.col("l_partkey") + 7).alias("k")).agg(F.count(F.lit(1)).alias("size"))
    suppliers = table(spark, folder, "supplier").select((F.col("s_suppkey") * 30).alias("k"), F.col("s_nationkey").cast("long").alias("nation"))
    return census.merge_tracts({"parts": parts, "sold": sold, "suppliers": suppliers}, ["k"])


def market_estimates(spark, folder):
    """Inner join of the area rows of two summary tables, sentinels dropped."""
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    geo = F.concat(F.lit("310M700US"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0"))
    c = table(spark, folder, "customer")
    a = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select(
        geo.alias("GEO_ID"), F.when(F.col("c_nationkey") % 6 == 5, "-666666666").otherwise(F.col("n").cast("string")).alias("E1"))
    b = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n")).select(
        geo.alias("GEO_ID"), F.col("n").cast("string").alias("E2"))
    return census.market_estimates({"a": (a, {"population": "E1"}), "b": (b, {"households": "E2"})})


def latest_complete_file(spark, folder):
    """Ship years as files: the newest whose fully discounted lines cover every line number."""
    lines = table(spark, folder, "lineitem")
    usable = lines.where("l_discount >= 0.1").select(
        F.concat(F.lit("profile-"), F.year("l_shipdate")).alias("file"), F.year("l_shipdate").alias("stamp"), "l_linenumber")
    out = newest_complete_file(usable, lines.select("l_linenumber").distinct(), "l_linenumber", "file", "stamp")
    return out.select("file", big("stamp").alias("stamp"))


def road_shares(spark, folder):
    """Line items as road edges of the supplier's metro, lengths in quantities."""
    codes = ["S1100", "S1630", "S1200", "S1400", "S1640", "S1730", "S1500"]
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), F.col("l_linenumber"))
    edges = table(spark, folder, "lineitem").where(census.is_road(F.when(F.col("l_returnflag") == "A", "N").otherwise("y"))).select(
        "l_suppkey", census.road_class(code).alias("road_class"), F.col("l_quantity").alias("length_km")).where("road_class IS NOT NULL")
    by_supplier = edges.groupBy("l_suppkey", "road_class").agg(F.sum("length_km").alias("length_km"))
    s = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("metro"))
    areas = table(spark, folder, "nation").select(F.col("n_nationkey").alias("metro"), (10.0 * (1 + F.col("n_nationkey") % 7)).alias("land_area_km2"))
    out = census.road_shares(by_supplier.join(s, F.col("l_suppkey") == F.col("s_suppkey")), areas)
    return out.select("metro", *[r4(c).alias(c) for c in (
        "total_km", "freeway_share", "arterial_share", "local_road_share", "road_density_km_per_km2")])


def area_rollup(spark, folder):
    counties = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("metro"), F.col("c_mktsegment").alias("county")).agg(
        (F.count(F.lit(1)) * 1000).alias("land_m2")).withColumn("state", F.substring("county", 1, 2))
    out = census.area_rollup(counties)
    return out.select("metro", r4("land_area_km2").alias("land_area_km2"), F.array_join("state_codes", ",").alias("states"),
                      "member_counties")


def _part_features(spark, folder):
    """Long features of parts: a size for all, a price for two thirds of them."""
    p = table(spark, folder, "part")
    row = lambda key, value, there: F.when(there, F.struct(F.lit(key).alias("key"), value.cast("double").alias("value")))
    return p.select(F.col("p_partkey").alias("entity_id"), F.explode(F.array_compact(F.array(
        row("size", F.when(F.col("p_size") > 5, F.col("p_size")), F.lit(True)),
        row("price", F.col("p_retailprice"), F.col("p_partkey") % 3 > 0)))).alias("f")).select(
        "entity_id", "f.key", "f.value", F.lit("units").alias("unit"),
        F.when(F.col("f.value").isNull(), "missing").otherwise("derived").alias("quality"),
        F.when(F.col("f.value").isNull(), "none").alias("missing_reason"), F.array(F.lit("p")).alias("provenance_ids"))


def absent_features(spark, folder):
    out = fx.fill_absent(_part_features(spark, folder), {"size": "units", "price": "usd", "weight": "kg"}, "not reported")
    return out.select("entity_id", "key", r4("value").alias("value"), "unit", "quality", "missing_reason")


def fill_from_second(spark, folder):
    second = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.avg("l_quantity").alias("value"))
    out = fx.fill_from(_part_features(spark, folder), "size", second, "second")
    return out.select("entity_id", "key", r4("value").alias("value"), "quality", F.array_join("provenance_ids", ",").alias("provenance_ids"))


QUERIES = {f.__name__: f for f in (
    ratio_of_sums, binned_mean, rate_per_100k, county_coverage, ports_by_county_map, qualifying_sites, dedupe_conflicts,
    published_normal, flag_frequencies, moe_status, max_relative_margin, strict_commute, tract_full_merge, market_estimates,
    latest_complete_file, road_shares, area_rollup, absent_features, fill_from_second,
)}

_FLAGGED = """WITH flagged AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN -9999 ELSE value END v,
    CASE event_type WHEN 'click' THEN '' WHEN 'error' THEN 'M' WHEN 'purchase' THEN '' ELSE 'X' END m,
    CASE user_id % 6 WHEN 1 THEN 'S' WHEN 2 THEN 'R' WHEN 3 THEN 'P' WHEN 4 THEN '' WHEN 5 THEN 'E' END c FROM events)"""
_SITE = """WITH site AS (SELECT s_nationkey metro, list_element(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], s_suppkey % 5 + 1) county,
    s_suppkey % 7 ports FROM supplier WHERE s_suppkey % 7 > 0)"""
_FEATURES = """WITH f AS (SELECT p_partkey entity_id, 'size' AS key, CAST(CASE WHEN p_size > 5 THEN p_size END AS DOUBLE) AS value FROM part
    UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_partkey % 3 > 0)"""

ORACLES = {
    "ratio_of_sums": """SELECT l_suppkey, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 4) + 0.0 AS saved_share,
        round(sum(l_extendedprice * l_tax) / sum(l_extendedprice), 4) + 0.0 AS tax_share,
        round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice * l_tax), 0), 4) + 0.0 AS saved_per_tax FROM lineitem GROUP BY 1""",
    "binned_mean": f"""WITH m AS (SELECT unnest({[float(x) for x in census.COMMUTE_MIDPOINTS]}) mid, unnest(range(12)) i)
        SELECT l_suppkey, count(*) AS total, round(CAST(sum(mid) AS DOUBLE) / count(*), 4) + 0.0 AS mean_minutes
        FROM lineitem JOIN m ON i = CAST(floor((l_quantity - 1) * 12 / 50) AS INT) GROUP BY 1""",
    "rate_per_100k": f"""{_SITE} SELECT c_nationkey AS metro, CAST(coalesce(any_value(p), 0) AS BIGINT) AS ports,
        round(coalesce(any_value(p), 0) / CAST(count(*) AS DOUBLE) * 100000, 4) + 0.0 AS ports_per_100k
        FROM customer LEFT JOIN (SELECT metro, sum(ports) p FROM site GROUP BY 1) x ON metro = c_nationkey GROUP BY 1""",
    "county_coverage": f"""{_SITE} SELECT c_nationkey AS metro, count(*) AS population,
        round(count(*) FILTER (EXISTS (SELECT 1 FROM site WHERE metro = c_nationkey AND county = c_mktsegment)) / CAST(count(*) AS DOUBLE), 4) + 0.0
        AS population_share_with_ports FROM customer GROUP BY 1""",
    "ports_by_county_map": f"""{_SITE} SELECT metro, CAST(sum(p) AS BIGINT) AS public_dc_ports, string_agg(county || '=' || p, ',' ORDER BY county) AS county_ports
        FROM (SELECT metro, county, CAST(sum(ports) AS BIGINT) p FROM site GROUP BY 1, 2) GROUP BY 1""",
    "qualifying_sites": """SELECT s_suppkey AS id, s_acctbal AS latitude, s_acctbal AS longitude, CAST(s_suppkey % 7 + 2 AS BIGINT) AS dc_fast_ports
        FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 1 AND s_acctbal >= 0""",
    "dedupe_conflicts": """SELECT l_partkey, count(*) AS copies, count(DISTINCT (l_returnflag, l_linestatus)) > 1 AS conflict,
        min((l_returnflag, l_linestatus))[1] AS l_returnflag, min((l_returnflag, l_linestatus))[2] AS l_linestatus FROM lineitem GROUP BY 1""",
    "published_normal": f"""{_FLAGGED} SELECT event_id, CASE WHEN m IN ('', 'X') AND (c IS NULL OR c IN ('S','R','P','E')) AND v >= 0
        THEN round(v, 4) + 0.0 END AS normal FROM flagged""",
    "flag_frequencies": f"""{_FLAGGED} SELECT (CASE WHEN m = '' THEN 'blank' ELSE m END) || '/' || c AS flags, count(*) AS n FROM flagged WHERE c IS NOT NULL GROUP BY 1""",
    "moe_status": """SELECT CAST(p_partkey AS VARCHAR) AS code, 'B01003_E001' AS "column", 'reported' AS status, CAST(trunc(p_retailprice) AS BIGINT) AS value FROM part
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'B01003_M001', CASE WHEN p_partkey % 5 = 0 THEN 'controlled_total' ELSE 'reported' END,
        CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS BIGINT) END FROM part""",
    "max_relative_margin": "SELECT round(max(l_extendedprice / o_totalprice), 4) + 0.0 AS max_relative_margin FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "strict_commute": """SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS code, CAST(sum(floor(o_totalprice)) AS BIGINT) AS minutes, count(*) AS workers,
        round(sum(floor(o_totalprice)) / count(*), 4) + 0.0 AS mean_commute_minutes FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "tract_full_merge": """SELECT k, a.size AS size, b.size AS size_sold, nation FROM (SELECT p_partkey k, CAST(p_size AS BIGINT) size FROM part) a
        FULL JOIN (SELECT l_partkey + 7 k, count(*) size FROM lineitem GROUP BY 1) b USING (k)
        FULL JOIN (SELECT s_suppkey * 30 k, CAST(s_nationkey AS BIGINT) nation FROM supplier) c USING (k)""",
    "market_estimates": """SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS code, CAST(count(DISTINCT c_custkey) AS DOUBLE) AS population,
        CAST(count(o_orderkey) AS DOUBLE) AS households FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey % 6 <> 5 GROUP BY 1""",
    "latest_complete_file": """SELECT 'profile-' || y AS file, y AS stamp FROM (SELECT year(l_shipdate) y, count(DISTINCT l_linenumber) n FROM lineitem
        WHERE l_discount >= 0.1 GROUP BY 1) WHERE n = (SELECT count(DISTINCT l_linenumber) FROM lineitem) ORDER BY y DESC LIMIT 1""",
    "road_shares": """WITH e AS (SELECT s_nationkey metro, l_linenumber i, l_quantity q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'A' AND l_linenumber < 7),
        t AS (SELECT metro, sum(q) total, coalesce(sum(q) FILTER (i <= 2), 0) f, coalesce(sum(q) FILTER (i = 3), 0) a, coalesce(sum(q) FILTER (i >= 4), 0) l FROM e GROUP BY 1)
        SELECT n_nationkey AS metro, round(coalesce(total, 0), 4) + 0.0 AS total_km, round(f / total, 4) + 0.0 AS freeway_share, round(a / total, 4) + 0.0 AS arterial_share,
        round(l / total, 4) + 0.0 AS local_road_share, round(total / (10.0 * (1 + n_nationkey % 7)), 4) + 0.0 AS road_density_km_per_km2
        FROM nation LEFT JOIN t ON metro = n_nationkey""",
    "area_rollup": """SELECT c_nationkey AS metro, round(CAST(count(*) AS DOUBLE) * 1000 / 1e6, 4) + 0.0 AS land_area_km2,
        string_agg(DISTINCT substring(c_mktsegment, 1, 2), ',' ORDER BY substring(c_mktsegment, 1, 2)) AS states, count(DISTINCT c_mktsegment) AS member_counties FROM customer GROUP BY 1""",
    "absent_features": f"""{_FEATURES} SELECT entity_id, key, round(value, 4) + 0.0 AS value, 'units' AS unit, CASE WHEN value IS NULL THEN 'missing' ELSE 'derived' END AS quality,
        CASE WHEN value IS NULL THEN 'none' END AS missing_reason FROM f
        UNION ALL SELECT p_partkey, k, NULL, u, 'missing', 'not reported' FROM part CROSS JOIN (VALUES ('size', 'units'), ('price', 'usd'), ('weight', 'kg')) r(k, u)
        WHERE NOT EXISTS (SELECT 1 FROM f WHERE entity_id = p_partkey AND key = k)""",
    "fill_from_second": f"""{_FEATURES}, s AS (SELECT l_partkey, avg(l_quantity) v FROM lineitem GROUP BY 1)
        SELECT entity_id, key, round(CASE WHEN key = 'size' THEN coalesce(value, v) ELSE value END, 4) + 0.0 AS value,
        CASE WHEN key = 'size' AND value IS NULL AND v IS NOT NULL THEN 'observed' WHEN value IS NULL THEN 'missing' ELSE 'derived' END AS quality,
        CASE WHEN key = 'size' AND value IS NULL AND v IS NOT NULL THEN 'second' ELSE 'p' END AS provenance_ids FROM f LEFT JOIN s ON l_partkey = entity_id""",
}
