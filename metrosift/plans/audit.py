"""Registered queries of releases, reconciliation and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrosift.functions.registry import UNSCORED_UNITS, FeatureSpec
from metrosift.operators import audit, features as fx, release
from metrosift.operators.scoring import rank_entities
from metrosift.operators.spatial import nearest_stations
from metrosift.plans import scoring as sc
from metrosift.plans.common import big, r4, table
from metrosift.plans.spatial import _places, _stations
from metrosift.session import stage
from metrosift.sources.readers import union_feeds
from metrosift.sources.writers import detail_rows, wide_values

SPECS = sc.SPECS


def _cited(spark, folder):
    """Labelled documents cite their own record, and good ones also the next one's."""
    ids = F.array_compact(F.array(F.concat(F.lit("d-"), F.col("doc_id")), F.when(F.col("quality") == 1, F.concat(F.lit("d-"), F.col("doc_id") + 1))))
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("entity_id"), F.lit("quality").alias("key"), F.col("quality").cast("double").alias("value"),
        F.lit("flag").alias("unit"), F.lit("derived").alias("quality"), F.lit(None).cast("string").alias("missing_reason"),
        ids.alias("provenance_ids"))


def _records(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("entity_id"), F.concat(F.lit("d-"), F.col("doc_id")).alias("id"),
        F.when(F.col("doc_id") % 50 == 0, "Synthetic feed").otherwise(F.col("source")).alias("source_name"),
        F.col("lang").alias("dataset_id"), F.concat(F.when(F.col("doc_id") % 9 == 0, "http://").otherwise("https://"), "source").alias("source_url"),
        F.when(F.col("doc_id") % 31 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256)).alias("raw_sha256"))


def provenance_resolve(spark, folder):
    return audit.unresolved_provenance(_cited(spark, folder), _records(spark, folder))


def provenance_violations(spark, folder):
    return audit.provenance_violations(_records(spark, folder), verified=True)


def provenance_counts(spark, folder):
    records = _records(spark, folder)
    known = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select(F.sha2("text", 256).alias("raw_sha256"))
    return audit.provenance_counts(records, known).select(*[big(c).alias(c) for c in ("records", "distinct_hashes", "unknown_hashes")])


def reconcile_sources(spark, folder):
    """Documents' size class against the quality label on record."""
    source = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") % 2).cast("long").alias("v"))
    recorded = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("long").alias("v"))
    return audit.reconcile(source, recorded, ["doc_id"], "v")


def manifest_check(spark, folder):
    """Documents as raw files: some manifest rows name a wrong size, hash or file."""
    d = table(spark, folder, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    k = F.col("doc_id")
    manifest = d.select(
        F.when(k % 41 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("path"),
        F.when(k % 43 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("bytes"),
        F.when(k % 47 == 0, F.lit("0")).otherwise(F.sha2("text", 256)).alias("sha256"), (k % 5 > 0).alias("retained"))
    return audit.manifest_check(manifest, files).select("path", "problem")


BREAKABLE = (
    FeatureSpec("size", "Size", "familiarity", "units", "linear", 1.0, 40.0),
    FeatureSpec("price", "Price", "readiness", "usd", "log1p", 1.0, 2000.0),
)


def _breakable(spark, folder):
    """Part measurements with every kind of defect somewhere."""
    p, k = table(spark, folder, "part"), F.col("p_partkey")
    value = F.when(F.col("key") == "size", F.col("p_size")).otherwise(F.col("p_retailprice"))
    rows = p.withColumn("key", F.explode(F.array(F.lit("size"), F.lit("price"))))
    value = F.when(k % 13 == 0, None).when(k % 17 == 0, -value).otherwise(value).cast("double")
    return rows.select(
        k.alias("entity_id"), "key", value.alias("value"),
        F.when(k % 19 == 0, "miles").when(F.col("key") == "size", "units").otherwise("usd").alias("unit"),
        F.when((k % 13 == 0) & (k % 2 == 0), "missing").when(k % 23 == 0, "guessed").otherwise("derived").alias("quality"),
        F.when(k % 26 == 0, "not reported").alias("missing_reason"),
        F.when(k % 29 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p"))).alias("provenance_ids"))


def validate_entities(spark, folder):
    return audit.measurement_violations(_breakable(spark, folder), BREAKABLE)


def invalid_measurements(spark, folder):
    return fx.invalid_measurements(_breakable(spark, folder)).select("entity_id", "key")


def measurement_policy(spark, folder):
    """Invalid measurements become explicit missing ones."""
    fixed, _ = release.apply_measurement_policy(_breakable(spark, folder), allow_invalid=True)
    return fixed.select("entity_id", "key", r4("value").alias("value"), "quality", "missing_reason",
                        F.size("provenance_ids").cast("long").alias("cited"))


def share_sums(spark, folder):
    """Suppliers whose three line shares do not add up because one line class is left out."""
    lines = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("l_returnflag") == f).alias(f"flag_{f}") for f in ("A", "N", "R")])
    cut = F.when(F.col("l_suppkey") % 4 == 0, F.col("flag_N") - 1).otherwise(F.col("flag_N"))
    wide = lines.select(F.col("l_suppkey").alias("entity_id"), (F.col("flag_A") / F.col("lines")).alias("freeway_share"),
                        (cut / F.col("lines")).alias("arterial_share"), (F.col("flag_R") / F.col("lines")).alias("local_road_share"))
    return audit.share_sum_violations(fx.to_long(wide, ["freeway_share", "arterial_share", "local_road_share"])).select(
        "entity_id", r4("share_sum").alias("share_sum"))


def release_diff(spark, folder):
    """A correction of part prices: some change, some vanish, some are new."""
    p = table(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    k = F.col("p_partkey")
    after = p.where(k % 11 != 3).select(
        F.when(k % 13 == 5, k + 1_000_000_000).otherwise(k).alias("p_partkey"),
        F.when(k % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"))
    out = release.changed_cells(p, after, ["p_partkey"], "price")
    return out.select("p_partkey", r4("before").alias("before"), r4("after").alias("after"), "change")


def content_digest(spark, folder):
    """Order-free digests of two tables, which agree with their own reshuffled copies."""
    out = None
    for name in ("part", "lineitem"):
        one = release.content_digest(table(spark, folder, name)).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _market_release(spark, folder):
    wide = stage(sc.market_wide(spark, folder), "markets")
    keys = [s.key for s in SPECS]
    unit = F.create_map(*[F.lit(x) for s in SPECS for x in (s.key, s.unit)])
    long = fx.to_long(wide, keys).select(
        F.substring("entity_id", 6, 5).alias("entity_id"), "key", "value", unit[F.col("key")].alias("unit"),
        F.when(F.col("value").isNull(), "missing").otherwise("derived").alias("quality"),
        F.when(F.col("value").isNull(), "none").alias("missing_reason"),
        F.when(F.col("value").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("src"))).alias("provenance_ids"))
    refs = sc.references(spark, folder)
    candidates = wide.select("entity_id").join(refs, "entity_id", "left_anti")
    provenance = wide.select("entity_id", F.lit("src").alias("id"), F.lit("0" * 64).alias("raw_sha256"))
    one = spark.createDataFrame([("status-page", "1" * 64)], "id string, raw_sha256 string")
    built = release.build_release(long, refs, candidates, provenance, SPECS, UNSCORED_UNITS, one)
    return built


def release_exclusions(spark, folder):
    return _market_release(spark, folder).exclusions


def release_summary(spark, folder):
    """Row counts of a built release's tables."""
    built = _market_release(spark, folder)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in built.tables().items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def corrected_bounds(spark, folder):
    """Commute values replaced, bounds frozen again over the parent's cohort."""
    parent = _market_release(spark, folder)
    old = parent.features.where("key = 'mean_commute_minutes'")
    rows = old.drop("key").withColumn("value", F.col("value") * 1.5)
    child = release.correct_release(parent, "mean_commute_minutes", rows, SPECS)
    release.require_only_key_changed(parent.features, child.features, "mean_commute_minutes")
    return child.bounds.select("key", r4("lower").alias("lower"), r4("upper").alias("upper"))


def climate_mismatches(spark, folder):
    """Suppliers' climate values against the stations their cited addresses name.

    Every seventh supplier's precipitation is off by one, so it must be reported.
    """
    stations = _stations(spark, folder).where("c_acctbal >= 0").select("station_id", "lat", "lon", F.col("c_acctbal").alias("reading"))
    near = stage(nearest_stations(_places(spark, folder), stations, 1, 100.0), "claims")
    k = F.col("place_id")
    claims = near.select(
        k.alias("entity_id"), F.lit("rain").alias("key"),
        (F.col("reading") * 25.4 + F.when(k % 7 == 0, 1.0).otherwise(0.0)).alias("value"),
        F.array(F.concat(F.lit("n-"), "station_id")).alias("provenance_ids"))
    provenance = near.select(k.alias("entity_id"), F.concat(F.lit("n-"), "station_id").alias("id"), F.concat(
        F.lit("https://normals.example.org/v1?dataset=normals&stations="), "station_id", F.lit("&format=json")).alias("source_url"))
    readings = stations.select(F.col("station_id").cast("string").alias("station_id"), F.lit("rain").alias("key"), F.col("reading").alias("value"))
    return audit.climate_mismatches(claims, provenance, readings, []).select(
        "entity_id", "key", r4("value").alias("value"), r4("expected").alias("expected"))


def selection_mismatches(spark, folder):
    """Stations chosen by a filter that skips some, against the full recomputation."""
    stations = _stations(spark, folder).drop("c_acctbal")
    chosen = nearest_stations(_places(spark, folder), stations.where("station_id % 10 <> 0"), 3, 100.0)
    again = nearest_stations(_places(spark, folder), stations, 3, 100.0)
    cols = ["place_id", F.lit("hot").alias("key"), "nearness", "station_id"]
    out = audit.selection_mismatches(chosen.select(*cols), again.select(*cols))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["station_id"].cast("string")), ",")
    return out.select("place_id", ids(F.col("claimed")).alias("claimed"), ids(F.col("recomputed")).alias("recomputed"))


def verification_report(spark, folder):
    wide, refs, frozen = sc.setup(spark, folder)
    cohort = wide.join(release.cohort_of(wide, wide.select("entity_id"), refs, SPECS), "entity_id", "left_semi")
    ranked = rank_entities(wide, refs, SPECS, fx.bounds_of(frozen, SPECS))
    return audit.report({
        "frozen_bounds": audit.bounds_differences(cohort, SPECS, frozen),
        "provenance": provenance_resolve(spark, folder),
        "measurements": validate_entities(spark, folder),
        "unranked_candidates": ranked.where("rank IS NULL"),
    })


def wide_export(spark, folder):
    keys = ["size", "price"]
    out = wide_values(_breakable(spark, folder), keys)
    return out.select("entity_id", *[r4(f"{k}_value").alias(f"{k}_value") for k in keys], *[f"{k}_quality" for k in keys])


def detail_export(spark, folder):
    out = detail_rows(_cited(spark, folder))
    return out.select("entity_id", "key", r4("value").alias("value"), "provenance_ids")


def feed_union(spark, folder):
    feeds = {
        "turns": table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "role"),
        "pages": table(spark, folder, "pages").select(F.col("page_id").alias("id"), "url"),
        "items": table(spark, folder, "benchmark").select(F.col("item_id").alias("id")),
    }
    return union_feeds(feeds)


def universe_ids(spark, folder):
    """Candidates and references together, distinct."""
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("id")).union(
        table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))).distinct()


def key_differences(spark, folder):
    """Customers with orders against customers in debt: keys on one side only."""
    a = table(spark, folder, "orders").select(F.col("o_custkey").alias("id")).distinct()
    b = table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return audit.table_differences(a, b)


QUERIES = {f.__name__: f for f in (
    provenance_resolve, provenance_violations, provenance_counts, reconcile_sources, manifest_check, validate_entities,
    invalid_measurements, measurement_policy, share_sums, release_diff, content_digest, release_exclusions, release_summary,
    corrected_bounds, climate_mismatches, selection_mismatches, verification_report, wide_export, detail_export, feed_union,
    universe_ids, key_differences,
)}

_RECORDS = """WITH r AS (SELECT doc_id entity_id, 'd-' || doc_id id, CASE WHEN doc_id % 50 = 0 THEN 'Synthetic feed' ELSE source END sn, lang ds,
    CASE WHEN doc_id % 9 = 0 THEN 'http://' ELSE 'https://' END || source url, doc_id % 31 = 0 badhash FROM documents)"""
_CITED = """WITH c AS (SELECT doc_id, unnest(CASE WHEN quality = 1 THEN [doc_id, doc_id + 1] ELSE [doc_id] END) cited FROM labels)"""
_BROKEN = """WITH v AS (SELECT p_partkey k, key, CASE WHEN key = 'size' THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END raw FROM part CROSS JOIN (VALUES ('size'), ('price')) x(key)),
    m AS (SELECT k AS entity_id, key, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN -raw ELSE raw END AS value,
    CASE WHEN k % 19 = 0 THEN 'miles' WHEN key = 'size' THEN 'units' ELSE 'usd' END unit,
    CASE WHEN k % 13 = 0 AND k % 2 = 0 THEN 'missing' WHEN k % 23 = 0 THEN 'guessed' ELSE 'derived' END quality,
    CASE WHEN k % 26 = 0 THEN 'not reported' END reason, CASE WHEN k % 29 = 0 THEN 0 ELSE 1 END cited FROM v)"""
_BAD = "value IS NOT NULL AND (quality = 'missing' OR reason IS NOT NULL OR cited = 0)"
_MARKETS = sc._MARKETS


def _near(extra: str) -> str:
    from metrosift.plans.spatial import _NEAR
    return f"WITH {_NEAR}, {extra}"


_RULES = " UNION ALL ".join(f"SELECT entity_id, key, '{rule}' AS rule FROM m WHERE {test}" for rule, test in {
    "missing without reason": "value IS NULL AND (quality <> 'missing' OR reason IS NULL)",
    "value marked missing": "value IS NOT NULL AND (quality = 'missing' OR reason IS NOT NULL)",
    "value without provenance": "value IS NOT NULL AND cited = 0",
    "unknown quality": "quality NOT IN ('observed', 'derived', 'proxy', 'missing')",
    "negative": "value < 0",
    "above maximum": "value > CASE key WHEN 'size' THEN 40 ELSE 2000 END",
    "wrong unit": "unit <> CASE key WHEN 'size' THEN 'units' ELSE 'usd' END",
}.items())
_RELEASE_RULES = """incomplete AS (SELECT entity_id FROM wide WHERE entity_id NOT IN (SELECT entity_id FROM complete))"""
_EXCLUSIONS = f"""{_MARKETS}, {_RELEASE_RULES}, ex AS (
    SELECT entity_id AS subject, 'incomplete measurements' AS reason FROM incomplete WHERE entity_id NOT IN (SELECT entity_id FROM all_refs)
    UNION ALL SELECT 'ref-' || substring(entity_id, 9, 2), 'disabled because ' || entity_id || ' has incomplete measurements' FROM incomplete WHERE entity_id IN (SELECT entity_id FROM all_refs)
    UNION ALL SELECT key, 'constant in the complete cohort; removed globally from scoring' FROM bounds WHERE lo = hi)"""

ORACLES = {
    "provenance_resolve": f"{_CITED} SELECT DISTINCT doc_id AS entity_id, 'd-' || cited AS id FROM c WHERE cited <> doc_id OR NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.doc_id)",
    "provenance_violations": f"""{_RECORDS} SELECT entity_id, id, 'hash' AS rule FROM r WHERE badhash UNION ALL SELECT entity_id, id, 'synthetic' FROM r WHERE contains(lower(sn || ds), 'synthetic')
        UNION ALL SELECT entity_id, id, 'https' FROM r WHERE NOT starts_with(url, 'https://')""",
    "provenance_counts": """WITH h AS (SELECT CASE WHEN doc_id % 31 = 0 THEN upper(sha256(text)) ELSE sha256(text) END x FROM documents)
        SELECT count(*) AS records, count(DISTINCT x) AS distinct_hashes, count(DISTINCT x) FILTER (x NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))) AS unknown_hashes FROM h""",
    "reconcile_sources": """SELECT doc_id, n_chars % 2 AS source_value, CAST(quality AS BIGINT) AS release_value, CASE WHEN n_chars IS NULL THEN 'release_only' WHEN quality IS NULL THEN 'source_only'
        WHEN n_chars % 2 = quality THEN 'equal' ELSE 'different' END AS status FROM documents FULL JOIN labels USING (doc_id)""",
    "manifest_check": """SELECT CASE WHEN doc_id % 41 = 0 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS path,
        CASE WHEN doc_id % 41 = 0 THEN 'missing' WHEN doc_id % 43 = 0 THEN 'size' ELSE 'hash' END AS problem FROM documents WHERE doc_id % 5 > 0 AND (doc_id % 41 = 0 OR doc_id % 43 = 0 OR doc_id % 47 = 0)""",
    "validate_entities": f"{_BROKEN} {_RULES}",
    "invalid_measurements": f"{_BROKEN} SELECT entity_id, key FROM m WHERE {_BAD}",
    "measurement_policy": f"""{_BROKEN} SELECT entity_id, key, CASE WHEN {_BAD} THEN NULL ELSE round(value, 4) + 0.0 END AS value, CASE WHEN {_BAD} THEN 'missing' ELSE quality END AS quality,
        CASE WHEN {_BAD} THEN coalesce(reason, 'Source record failed measurement completeness validation.') ELSE reason END AS missing_reason,
        CAST(CASE WHEN {_BAD} THEN 0 ELSE cited END AS BIGINT) AS cited FROM m""",
    "share_sums": """SELECT l_suppkey AS entity_id, round(CAST(count(*) - 1 AS DOUBLE) / count(*), 4) + 0.0 AS share_sum FROM lineitem WHERE l_suppkey % 4 = 0 GROUP BY 1""",
    "release_diff": """WITH b AS (SELECT CASE WHEN p_partkey % 13 = 5 THEN p_partkey + 1000000000 ELSE p_partkey END p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 1 ELSE p_retailprice END price FROM part WHERE p_partkey % 11 <> 3)
        SELECT p_partkey, round(p_retailprice, 4) + 0.0 AS "before", round(price, 4) + 0.0 AS "after", CASE WHEN p_retailprice IS NULL THEN 'added' WHEN price IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM part FULL JOIN b USING (p_partkey) WHERE p_retailprice IS DISTINCT FROM price""",
    "release_exclusions": f"{_EXCLUSIONS} SELECT subject, reason FROM ex",
    "release_summary": f"""{_EXCLUSIONS}, cohort AS (SELECT entity_id FROM complete)
        SELECT 'features' AS "table", (SELECT count(*) FROM wide) * 12 AS rows UNION ALL SELECT 'references', (SELECT count(*) FROM all_refs)
        UNION ALL SELECT 'candidates', (SELECT count(*) FROM wide) - (SELECT count(*) FROM all_refs) UNION ALL SELECT 'cohort', (SELECT count(*) FROM cohort)
        UNION ALL SELECT 'bounds', 10 UNION ALL SELECT 'exclusions', (SELECT count(*) FROM ex) UNION ALL SELECT 'provenance', (SELECT count(*) FROM wide) + (SELECT count(*) FROM all_refs)""",
    "corrected_bounds": f"""{_MARKETS} SELECT key, round(CASE WHEN key = 'mean_commute_minutes' THEN lo * 1.5 ELSE lo END, 4) + 0.0 AS lower,
        round(CASE WHEN key = 'mean_commute_minutes' THEN hi * 1.5 ELSE hi END, 4) + 0.0 AS upper FROM bounds""",
    "climate_mismatches": _near("""one AS (SELECT * FROM near WHERE c_acctbal >= 0 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY d, station_id) = 1)
        SELECT place_id AS entity_id, 'rain' AS key, round(c_acctbal * 25.4 + 1, 4) + 0.0 AS value, round(c_acctbal * 25.4, 4) + 0.0 AS expected FROM one WHERE place_id % 7 = 0"""),
    "selection_mismatches": _near("""a AS (SELECT place_id, string_agg(station_id, ',' ORDER BY d, station_id) s FROM (SELECT * FROM near WHERE station_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY d, station_id) <= 3) GROUP BY 1),
        b AS (SELECT place_id, string_agg(station_id, ',' ORDER BY d, station_id) s FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY d, station_id) <= 3) GROUP BY 1)
        SELECT place_id, a.s AS claimed, b.s AS recomputed FROM a FULL JOIN b USING (place_id) WHERE a.s IS DISTINCT FROM b.s"""),
    "verification_report": f"""{_MARKETS}, n AS (SELECT 'frozen_bounds' AS "check", 0 AS violations UNION ALL
        SELECT 'provenance', (SELECT count(*) FROM (SELECT doc_id, doc_id + 1 FROM labels WHERE quality = 1)) UNION ALL
        SELECT 'measurements', (SELECT count(*) FROM ({_BROKEN} {_RULES})) UNION ALL SELECT 'unranked_candidates', (SELECT count(*) FROM wide) - (SELECT count(*) FROM ranked))
        SELECT "check", CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM n""",
    "wide_export": f"""{_BROKEN} SELECT entity_id, round(max(value) FILTER (key = 'size'), 4) + 0.0 AS size_value, round(max(value) FILTER (key = 'price'), 4) + 0.0 AS price_value,
        max(quality) FILTER (key = 'size') AS size_quality, max(quality) FILTER (key = 'price') AS price_quality FROM m GROUP BY 1""",
    "detail_export": """SELECT doc_id AS entity_id, 'quality' AS key, CAST(quality AS DOUBLE) AS value, CASE WHEN quality = 1 THEN 'd-' || doc_id || '; d-' || (doc_id + 1) ELSE 'd-' || doc_id END AS provenance_ids FROM labels""",
    "feed_union": """SELECT conv_id AS id, role, NULL AS url, 'turns' AS feed FROM conversations UNION ALL SELECT page_id, NULL, url, 'pages' FROM pages UNION ALL SELECT item_id, NULL, NULL, 'items' FROM benchmark""",
    "universe_ids": "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0",
    "key_differences": """WITH a AS (SELECT DISTINCT o_custkey id FROM orders), b AS (SELECT c_custkey id FROM customer WHERE c_acctbal < 0)
        SELECT id, 'first' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'second' FROM b WHERE id NOT IN (SELECT id FROM a)""",
}
