"""Registered queries of the scoring model.

Stand-ins: a metro is a nation, its counties are its customers' market segments,
residents are customers and sites are suppliers. For ranking at size an entity is a
part described by its line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.functions.registry import PILLARS, TEN_FEATURES, FeatureSpec, check_registry, registry_table
from metrosift.operators import audit, evidence, features as fx, release, scoring
from metrosift.operators.census import charging_coverage, ports_by_area
from metrosift.plans.common import big, r4, table
from metrosift.session import stage

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SPECS = check_registry(TEN_FEATURES, 10)
PART_SPECS = check_registry((
    FeatureSpec("mean_quantity", "Mean quantity", "familiarity", "units", "linear", 0.5),
    FeatureSpec("mean_discount", "Mean discount", "familiarity", "fraction", "linear", 0.3),
    FeatureSpec("mean_price", "Mean price", "familiarity", "usd", "log1p", 0.2),
    FeatureSpec("lines", "Lines", "readiness", "lines", "log1p", 1.0),
    FeatureSpec("revenue", "Revenue", "opportunity", "usd", "log1p", 0.6),
    FeatureSpec("returned_share", "Returned share", "opportunity", "fraction", "linear", 0.4),
))
ALTERNATIVE = scoring.RankingRequest({"familiarity": 0.2, "readiness": 0.5, "opportunity": 0.3})


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """(metro, county, ports) of suppliers standing in for charging sites."""
    segment = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, folder, "supplier").where("s_suppkey % 7 > 0").select(
        F.col("s_nationkey").alias("metro"), segment.alias("county"), (F.col("s_suppkey") % 7).alias("ports"))


def charging(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    counties = customers.groupBy(F.col("c_nationkey").alias("metro"), F.col("c_mktsegment").alias("county")).agg(
        F.count(F.lit(1)).alias("population"))
    people = customers.groupBy(F.col("c_nationkey").alias("metro")).agg(F.count(F.lit(1)).alias("population"))
    return charging_coverage(ports_by_area(sites(spark, folder)), counties, people)


def market_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per nation with the ten scored features; large tables aggregate first."""
    c = table(spark, folder, "customer")
    people = c.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"),
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"),
        F.avg(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).alias("rain"),
        F.avg(F.col("c_custkey") % 90).alias("snow"), F.avg(F.col("c_custkey") % 366).alias("hot"),
    )
    spent = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("orders"))
    trips = c.select("c_custkey", "c_nationkey").join(spent, F.col("c_custkey") == F.col("o_custkey")).groupBy(
        "c_nationkey").agg(F.sum("total").alias("total"), F.sum("orders").alias("orders"))
    nations = table(spark, folder, "nation").select("n_nationkey")
    joined = (
        nations.join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left").drop("c_nationkey")
        .join(trips, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(charging(spark, folder).drop("population"), F.col("n_nationkey") == F.col("metro"), "left")
    )
    k = F.col("n_nationkey")
    return joined.select(
        F.concat(F.lit("cbsa:"), F.lpad(k.cast("string"), 5, "0")).alias("entity_id"),
        F.col("rain").alias("annual_precipitation_mm"),
        F.when(k % 12 != 7, F.col("snow")).alias("annual_snowfall_mm"),
        F.col("hot").alias("hot_days_32c"),
        (F.col("total") / F.col("orders") / 1000).alias("mean_commute_minutes"),
        F.col("ports_per_100k").alias("public_dc_ports_per_100k"),
        F.col("population_share_with_ports").alias("population_share_in_counties_with_dc"),
        F.col("n").cast("double").alias("population"),
        (F.col("n") / (10 * (1 + k % 7))).alias("population_density_per_km2"),
        (F.col("negative") / F.col("n")).alias("zero_vehicle_household_share"),
        (F.col("building") / F.col("n")).alias("transit_commute_share"),
    )


def references(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of region 0 and nation 7 (which is incomplete, so it gets disabled)."""
    k = F.col("n_nationkey")
    return table(spark, folder, "nation").where("n_regionkey = 0 OR n_nationkey = 7").select(
        F.concat(F.lit("ref-"), F.lpad(k.cast("string"), 2, "0")).alias("id"),
        F.concat(F.lit("cbsa:"), F.lpad(k.cast("string"), 5, "0")).alias("entity_id"),
        F.when(k == 20, "announced").otherwise("commercial").alias("category"), F.lit(True).alias("enabled"))


def setup(spark: SparkSession, folder: str):
    """Staged wide features, checked references and frozen bounds of the markets."""
    wide = stage(market_wide(spark, folder), "markets")
    refs = stage(release.disable_incomplete(references(spark, folder), wide, SPECS), "references")
    # Here every nation is a candidate or a reference, so the cohort is the complete rows.
    return wide, refs, fx.freeze_bounds(wide.where(fx.is_complete(SPECS)), SPECS)


def ranked_markets(spark, folder, request=scoring.RankingRequest()):
    wide, refs, frozen = setup(spark, folder)
    return scoring.rank_entities(wide, refs, SPECS, fx.bounds_of(frozen, SPECS), request)


SCORES = ["entity_id", "rank", "expansion_score", *PILLARS]


def _scores(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "entity_id", big("rank").alias("rank"), r4("expansion_score").alias("expansion_score"),
        *[r4(p).alias(p) for p in PILLARS],
        F.get(F.col("matches"), F.lit(0))["reference_id"].alias("nearest_reference"),
    )


def rank_markets(spark, folder):
    return _scores(ranked_markets(spark, folder))


def reference_matches(spark, folder):
    wide, refs, frozen = setup(spark, folder)
    scored = scoring.score(wide, refs, SPECS, fx.bounds_of(frozen, SPECS))
    return scored.select("entity_id", F.posexplode("matches").alias("i", "m")).select(
        "entity_id", big(F.col("i") + 1).alias("position"), "m.reference_id", r4("m.distance").alias("distance"),
        r4("m.similarity").alias("similarity"))


def rank_reference_markets(spark, folder):
    wide, refs, frozen = setup(spark, folder)
    return _scores(scoring.rank_references(wide, refs, SPECS, fx.bounds_of(frozen, SPECS)))


def weight_sensitivity(spark, folder):
    """Ranks under other weights beside the default ones, from one scoring."""
    wide, refs, frozen = setup(spark, folder)
    scored = scoring.score(wide, refs, SPECS, fx.bounds_of(frozen, SPECS))
    sets = {"default": scoring.RankingRequest(), "readiness first": ALTERNATIVE, "even": scoring.RankingRequest({p: 1.0 for p in PILLARS})}
    out = scoring.weight_sensitivity(scoring.ranks_by_weights(scored, sets), "default")
    return out.select(
        "weights", "entity_id", big("rank").alias("rank"), big("baseline_rank").alias("baseline_rank"),
        big("rank_change").alias("rank_change"), r4("expansion_score").alias("expansion_score"),
        r4("score_change").alias("score_change"))


def _cited(spark, folder):
    """Measurements of the markets with the ids they cite: one of the measurement, one shared by a third of the nations."""
    long = fx.to_long(market_wide(spark, folder), [s.key for s in SPECS])
    feed = F.concat(F.lit("fed-"), (F.substring("entity_id", 6, 5).cast("int") % 3).cast("string"))
    return long.withColumn("provenance_ids", F.array(F.concat(F.lit("src-"), "key"), feed))


def top_markets(spark, folder):
    ranked = ranked_markets(spark, folder).where("rank IS NOT NULL")
    return ranked.orderBy(F.desc("expansion_score"), "entity_id").limit(3).select(
        "entity_id", big("rank").alias("rank"), r4("expansion_score").alias("expansion_score"))


def factor_table(spark, folder):
    wide, refs, frozen = setup(spark, folder)
    scored = scoring.score(wide, refs, SPECS, fx.bounds_of(frozen, SPECS))
    cited = evidence.with_factor_evidence(scored, _cited(spark, folder))
    f = cited.select("entity_id", F.explode("factors").alias("f")).select("entity_id", "f.*")
    return f.select("entity_id", "key", "pillar", F.array_join("provenance_ids", ",").alias("provenance_ids"), *[
        r4(c).alias(c) for c in ("raw_value", "normalized_value", "reference_value", "distance_component", "score_points")])


def strong_weak_factors(spark, folder):
    wide, refs, frozen = setup(spark, folder)
    scored = scoring.score(wide, refs, SPECS, fx.bounds_of(frozen, SPECS))
    return scored.where(F.size("factors") > 0).select(
        "entity_id", *[F.element_at(side, i).alias(f"{side}_{i}") for side in ("strongest", "weakest") for i in (1, 2)])


def exclusion_reasons(spark, folder):
    wide, refs, frozen = setup(spark, folder)
    scored = scoring.score(wide, refs, SPECS, fx.bounds_of(frozen, SPECS))
    return scored.select("entity_id", F.array_join("exclusion_reasons", "; ").alias("reasons"))


def coverage(spark, folder):
    wide = market_wide(spark, folder)
    return wide.select("entity_id", r4(fx.coverage(SPECS)).alias("coverage"),
                       F.array_join(fx.missing_keys(SPECS), ",").alias("missing"))


def _market_names(spark, folder):
    return table(spark, folder, "nation").select(
        F.concat(F.lit("cbsa:"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0")).alias("entity_id"), F.col("n_name").alias("display_name"))


def explanations(spark, folder):
    """Every text of every explanation, with the ids it rests on and the ranking it belongs to."""
    wide, refs, frozen = setup(spark, folder)
    request = scoring.RankingRequest()
    ranked = stage(evidence.with_factor_evidence(
        scoring.rank_entities(wide, refs, SPECS, fx.bounds_of(frozen, SPECS), request), _cited(spark, folder)), "cited")
    rows = scoring.explain_rows(ranked, _market_names(spark, folder), SPECS)
    cited = refs.withColumn("provenance_ids", F.array(F.concat(F.lit("doc-"), "id"), F.lit("fed-0")))
    ranking = evidence.ranking_id(scoring.select_references(refs, request), request.shares(), F.lit("tables"))
    return evidence.explained(rows, ranked, cited, ranking).select(
        "entity_id", "summary", *[F.array_join(c, " | ").alias(c) for c in ("tradeoffs", "advantages")],
        F.array_join("evidence_ids", ",").alias("evidence_ids"), "mode", "ranking_id")


def entity_lookup(spark, folder):
    """One market with all its measurements and the provenance records they cite."""
    cited = _cited(spark, folder)
    records = cited.select("entity_id", F.explode("provenance_ids").alias("id")).distinct().withColumn(
        "url", F.concat(F.lit("https://data.example/"), "id"))
    out = evidence.lookup("cbsa:00003", _market_names(spark, folder), cited, records)
    text = lambda c, f: F.array_join(F.transform(c, f), "; ")
    return out.select("entity_id", "display_name", text("features", lambda x: F.concat(
        x["key"], F.lit("="), F.coalesce(F.format_string("%.3f", x["value"]), F.lit("missing")), F.lit(" "), F.array_join(x["provenance_ids"], ","))).alias("features"),
        text("evidence", lambda x: F.concat(x["id"], F.lit(" "), x["url"])).alias("evidence"))


def freeze_bounds(spark, folder):
    _, _, frozen = setup(spark, folder)
    return frozen.select("key", r4("lower").alias("lower"), r4("upper").alias("upper"))


def normalize_clip(spark, folder):
    wide, refs, frozen = setup(spark, folder)
    cohort = release.cohort_of(wide, wide.select("entity_id"), refs, SPECS)
    long = fx.to_long(wide, [s.key for s in SPECS])
    rows = audit.audit_rows(long, SPECS, frozen, cohort, registry_table(spark, SPECS))
    return rows.select("entity_id", "key", r4("value").alias("value"), r4("transformed_value").alias("transformed_value"),
                       r4("normalized_value").alias("normalized_value"), "eligible", "validation_status")


def feature_audit(spark, folder):
    wide, refs, frozen = setup(spark, folder)
    cohort = wide.join(release.cohort_of(wide, wide.select("entity_id"), refs, SPECS), "entity_id", "left_semi")
    out = fx.feature_audit(wide, cohort, SPECS, frozen)
    return out.select("key", *[r4(c).alias(c) for c in (
        "raw_minimum", "raw_maximum", "transformed_minimum", "transformed_maximum")],
        *[big(c).alias(c) for c in ("observed", "missing", "cohort_observations")], "constant")


def missing_report(spark, folder):
    return fx.missing_report(market_wide(spark, folder), SPECS)


def part_wide(spark, folder) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.format_string("part-%09d", F.col("l_partkey")).alias("entity_id")).agg(
        F.avg("l_quantity").alias("mean_quantity"), F.avg("l_discount").alias("mean_discount"),
        F.avg("l_extendedprice").alias("mean_price"), F.count(F.lit(1)).cast("double").alias("lines"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("returned_share"))


def rank_parts(spark, folder):
    """The same ranking with every second part as a reference: more than the plan holds, so matching goes by blocks."""
    wide = stage(part_wide(spark, folder), "parts")
    refs = wide.where(F.substring("entity_id", 6, 9).cast("long") % 2 == 0).select(
        F.concat(F.lit("ref-"), "entity_id").alias("id"), "entity_id", F.lit("commercial").alias("category"),
        F.lit(True).alias("enabled"))
    bounds = fx.bounds_of(fx.freeze_bounds(wide, PART_SPECS), PART_SPECS)
    return _scores(scoring.rank_entities(wide, refs, PART_SPECS, bounds))


QUERIES = {f.__name__: f for f in (
    rank_markets, reference_matches, rank_reference_markets, weight_sensitivity, top_markets, factor_table, entity_lookup,
    strong_weak_factors, exclusion_reasons, coverage, explanations, freeze_bounds, normalize_clip,
    feature_audit, missing_report, rank_parts,
)}

# ---- the same questions in SQL -----------------------------------------------------

_VALUES = """
people AS (SELECT c_nationkey k, count(*) n, count(*) FILTER (c_acctbal < 0) negative,
    count(*) FILTER (c_mktsegment = 'BUILDING') building, avg(c_acctbal) FILTER (c_acctbal >= 0) rain,
    avg(c_custkey % 90) snow, avg(c_custkey % 366) hot FROM customer GROUP BY 1),
trips AS (SELECT c_nationkey k, sum(o_totalprice) total, count(*) orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
site AS (SELECT s_nationkey k, list_element(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], s_suppkey % 5 + 1) county,
    s_suppkey % 7 ports FROM supplier WHERE s_suppkey % 7 > 0),
port AS (SELECT k, sum(ports) ports FROM site GROUP BY 1),
county AS (SELECT c_nationkey k, c_mktsegment county, count(*) pop FROM customer GROUP BY 1, 2),
share AS (SELECT k, CAST(coalesce(sum(pop) FILTER (EXISTS (SELECT 1 FROM site s WHERE s.k = county.k AND s.county = county.county)), 0) AS DOUBLE) / sum(pop) s
    FROM county GROUP BY 1),
wide AS (SELECT 'cbsa:' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') entity_id, n_nationkey, n_name, n_regionkey,
    rain annual_precipitation_mm, CASE WHEN n_nationkey % 12 <> 7 THEN snow END annual_snowfall_mm, hot hot_days_32c,
    total / orders / 1000 mean_commute_minutes,
    CASE WHEN n IS NOT NULL THEN coalesce(ports, 0) / CAST(n AS DOUBLE) * 100000 END public_dc_ports_per_100k,
    s population_share_in_counties_with_dc, CAST(n AS DOUBLE) population, n / CAST(10 * (1 + n_nationkey % 7) AS DOUBLE) population_density_per_km2,
    negative / CAST(n AS DOUBLE) zero_vehicle_household_share, building / CAST(n AS DOUBLE) transit_commute_share
  FROM nation LEFT JOIN people ON people.k = n_nationkey LEFT JOIN trips ON trips.k = n_nationkey
  LEFT JOIN port ON port.k = n_nationkey LEFT JOIN share ON share.k = n_nationkey)"""


def _registry_sql(specs) -> str:
    rows = ", ".join(f"({i}, '{s.key}', '{s.pillar}', '{s.transform}', {s.weight!r}::DOUBLE, '{s.label}', '{s.unit}')"
                     for i, s in enumerate(specs))
    return f"registry(pos, key, pillar, transform, w, label, unit) AS (VALUES {rows})"


def _ranking_sql(values: str, specs, refs: str, all_refs: str) -> str:
    """CTEs up to ``scored`` for a ``wide`` table: refs and all_refs are SELECTs over complete."""
    keys = ", ".join(s.key for s in specs)
    return f"""WITH {values}, {_registry_sql(specs)},
feat AS (SELECT entity_id, key, value FROM (SELECT entity_id, {keys} FROM wide) UNPIVOT INCLUDE NULLS (value FOR key IN ({keys}))),
complete AS (SELECT entity_id FROM feat GROUP BY 1 HAVING count(value) = {len(specs)}),
tr AS (SELECT f.entity_id, r.*, value, CASE WHEN transform = 'log1p' THEN ln(1 + value) ELSE value END t FROM feat f JOIN registry r USING (key)),
bounds AS (SELECT key, min(t) lo, max(t) hi FROM tr WHERE entity_id IN (SELECT entity_id FROM complete) GROUP BY 1),
active AS (SELECT registry.*, w / sum(w) OVER (PARTITION BY pillar) ww FROM registry JOIN bounds USING (key) WHERE hi > lo),
norm AS (SELECT tr.entity_id, tr.key, a.pillar, a.ww, value, least(1.0, greatest(0.0, (t - lo) / (hi - lo))) n
    FROM tr JOIN active a USING (key) JOIN bounds USING (key)),
all_refs AS ({all_refs}), refs AS ({refs}),
pairs AS (SELECT c.entity_id, r.reference_id, r.entity_id ref_entity, sqrt(sum(c.ww * (c.n - x.n) * (c.n - x.n))) d
    FROM refs r JOIN norm x ON x.entity_id = r.entity_id AND x.pillar = 'familiarity'
    JOIN norm c ON c.key = x.key AND c.entity_id <> r.entity_id GROUP BY 1, 2, 3),
matched AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d, reference_id) pos FROM pairs),
nearest AS (SELECT entity_id, reference_id, ref_entity, 100 * (1 - least(1, d)) familiarity FROM matched WHERE pos = 1),
reasons AS (SELECT e.entity_id,
    concat_ws('; ', (SELECT string_agg('Missing feature: ' || key, '; ' ORDER BY pos) FROM feat f JOIN registry USING (key) WHERE f.entity_id = e.entity_id AND value IS NULL),
      CASE WHEN e.entity_id IN (SELECT entity_id FROM all_refs) THEN 'Reference metro excluded from expansion shortlist' END) reasons
    FROM wide e),
pillar AS (SELECT entity_id, sum(100 * ww * n) FILTER (pillar = 'readiness') readiness, sum(100 * ww * n) FILTER (pillar = 'opportunity') opportunity FROM norm GROUP BY 1),
parts AS (SELECT reasons.entity_id, nearest.reference_id, ref_entity, familiarity, readiness, opportunity
    FROM reasons JOIN nearest USING (entity_id) JOIN pillar USING (entity_id) WHERE reasons = ''),
scored AS (SELECT *, 0.4 * familiarity + 0.2 * readiness + 0.4 * opportunity score FROM parts),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, entity_id) rk FROM scored)
"""


_REF_COLUMNS = "'ref-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') reference_id, entity_id"
_MARKETS = _ranking_sql(
    _VALUES, SPECS,
    f"SELECT {_REF_COLUMNS} FROM wide WHERE n_regionkey = 0 AND n_nationkey <> 20 AND entity_id IN (SELECT entity_id FROM complete)",
    "SELECT entity_id FROM wide WHERE n_regionkey = 0 OR n_nationkey = 7",
)
_PARTS = _ranking_sql(
    """wide AS (SELECT printf('part-%09d', l_partkey) entity_id, avg(l_quantity) mean_quantity, avg(l_discount) mean_discount,
    avg(l_extendedprice) mean_price, CAST(count(*) AS DOUBLE) lines, sum(l_extendedprice * (1 - l_discount)) revenue,
    count(*) FILTER (l_returnflag = 'R') / CAST(count(*) AS DOUBLE) returned_share FROM lineitem GROUP BY 1)""", PART_SPECS,
    "SELECT 'ref-' || entity_id reference_id, entity_id FROM wide WHERE CAST(substring(entity_id, 6, 9) AS BIGINT) % 2 = 0",
    "SELECT entity_id FROM wide WHERE CAST(substring(entity_id, 6, 9) AS BIGINT) % 2 = 0",
)
_SCORES = """SELECT w.entity_id, rk AS rank, round(score, 4) + 0.0 AS expansion_score, round(familiarity, 4) + 0.0 AS familiarity,
    round(readiness, 4) + 0.0 AS readiness, round(opportunity, 4) + 0.0 AS opportunity, reference_id AS nearest_reference
    FROM wide w LEFT JOIN ranked USING (entity_id)"""
_REFERENCE_RANKING = _MARKETS.replace("WHERE reasons = ''", "WHERE reasons.entity_id IN (SELECT entity_id FROM all_refs WHERE entity_id IN (SELECT entity_id FROM complete))")
_FACTORS = """, factors AS (SELECT s.entity_id, n.key, n.pillar, n.value raw_value, n.n,
    CASE WHEN n.pillar = 'familiarity' THEN x.value END reference_value,
    CASE WHEN n.pillar = 'familiarity' THEN n.ww * (n.n - x.n) * (n.n - x.n) END component,
    CASE WHEN n.pillar <> 'familiarity' THEN 100 * n.ww * n.n END points
    FROM scored s JOIN norm n USING (entity_id) JOIN norm x ON x.entity_id = s.ref_entity AND x.key = n.key),
ordered AS (SELECT *, CASE WHEN pillar = 'familiarity' THEN 1 - sqrt(component) ELSE n END p FROM factors),
weak AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY p, key) i, row_number() OVER (PARTITION BY entity_id ORDER BY p DESC, key DESC) j FROM ordered)
"""

ORACLES = {
    "rank_markets": f"{_MARKETS} {_SCORES}",
    "rank_parts": f"{_PARTS} {_SCORES}",
    "rank_reference_markets": f"{_REFERENCE_RANKING} {_SCORES} WHERE w.entity_id IN (SELECT entity_id FROM all_refs WHERE entity_id IN (SELECT entity_id FROM complete))",
    "reference_matches": f"""{_MARKETS} SELECT m.entity_id, pos AS position, m.reference_id, round(d, 4) + 0.0 AS distance,
        round(100 * (1 - least(1, d)), 4) + 0.0 AS similarity FROM matched m JOIN scored USING (entity_id) WHERE pos <= 3""",
    "weight_sensitivity": f"""{_MARKETS}, sets(weights, f, r, o) AS (VALUES ('default', 0.4::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE), ('readiness first', 0.2, 0.5, 0.3), ('even', 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE)),
        again AS (SELECT weights, entity_id, f * familiarity + r * readiness + o * opportunity s2 FROM ranked, sets),
        placed AS (SELECT *, row_number() OVER (PARTITION BY weights ORDER BY s2 DESC, entity_id) rk2 FROM again)
        SELECT weights, entity_id, rk2 AS rank, rk AS baseline_rank, rk - rk2 AS rank_change, round(s2, 4) + 0.0 AS expansion_score,
        round(s2 - score, 4) + 0.0 AS score_change FROM placed JOIN ranked USING (entity_id) WHERE weights <> 'default'""",
    "top_markets": f"{_MARKETS} SELECT entity_id, rk AS rank, round(score, 4) + 0.0 AS expansion_score FROM ranked WHERE rk <= 3",
    "factor_table": f"""{_MARKETS} {_FACTORS} SELECT entity_id, key, pillar, 'src-' || key || ',fed-' || CAST(substring(entity_id, 6, 5) AS INT) % 3 AS provenance_ids, round(raw_value, 4) + 0.0 AS raw_value, round(n, 4) + 0.0 AS normalized_value,
        round(reference_value, 4) + 0.0 AS reference_value, round(component, 4) + 0.0 AS distance_component, round(points, 4) + 0.0 AS score_points FROM factors""",
    "strong_weak_factors": f"""{_MARKETS} {_FACTORS} SELECT entity_id, max(key) FILTER (j = 1) AS strongest_1, max(key) FILTER (j = 2) AS strongest_2,
        max(key) FILTER (i = 1) AS weakest_1, max(key) FILTER (i = 2) AS weakest_2 FROM weak GROUP BY 1""",
    "exclusion_reasons": f"{_MARKETS} SELECT entity_id, reasons FROM reasons",
    "coverage": f"""{_MARKETS} SELECT entity_id, round(count(value) / 10.0, 4) + 0.0 AS coverage,
        coalesce(string_agg(key, ',' ORDER BY pos) FILTER (value IS NULL), '') AS missing FROM feat JOIN registry USING (key) GROUP BY 1""",
    "explanations": f"""{_MARKETS} {_FACTORS}, low AS (SELECT entity_id, string_agg(lower(label), ', ' ORDER BY i) labels FROM weak JOIN registry USING (key) WHERE i <= 2 GROUP BY 1),
        high AS (SELECT entity_id, string_agg(CASE WHEN k.pillar = 'familiarity' THEN label || ': ' || format('{{:,.2f}}', raw_value) || ' ' || unit || '; comparison reference ' || format('{{:,.2f}}', reference_value) || '.'
            ELSE label || ' contributes ' || printf('%.1f', points) || ' points to ' || k.pillar || '.' END, ' | ' ORDER BY j) told FROM weak k JOIN registry USING (key) WHERE j <= 2 GROUP BY 1),
        ids AS (SELECT f.entity_id, list_sort(list_distinct(list_concat(list('src-' || key), ['fed-' || CAST(substring(f.entity_id, 6, 5) AS INT) % 3, 'fed-0', 'doc-' || any_value(reference_id)]))) ids FROM factors f JOIN ranked USING (entity_id) GROUP BY 1),
        rid AS (SELECT sha256('tables|familiarity=0.400000,opportunity=0.400000,readiness=0.200000|' || count(*) || '|' || sum(('0x' || substr(sha256(reference_id), 1, 15))::BIGINT::HUGEINT)) id FROM refs)
        SELECT w.entity_id, CASE WHEN rk IS NULL THEN w.n_name || ' is unranked.' ELSE w.n_name || ' ranks #' || rk || ' with a screening score of '
        || printf('%.1f', score) || '. ' || x.n_name || ' is the nearest selected reference across climate and commuting proxies. Applied weights: familiarity 40%, readiness 20%, opportunity 40%.' END AS summary,
        CASE WHEN rk IS NULL THEN replace(reasons, '; ', ' | ') ELSE 'Lower relative factors: ' || labels || '. | {scoring.CAVEAT}' END AS tradeoffs,
        coalesce(told, '') AS advantages, CASE WHEN rk IS NULL THEN '' ELSE array_to_string(ids, ',') END AS evidence_ids, 'template' AS mode, (SELECT id FROM rid) AS ranking_id
        FROM wide w JOIN reasons USING (entity_id) LEFT JOIN ranked r USING (entity_id) LEFT JOIN low USING (entity_id) LEFT JOIN high USING (entity_id) LEFT JOIN ids USING (entity_id)
        LEFT JOIN wide x ON x.entity_id = r.ref_entity""",
    "entity_lookup": f"""{_MARKETS}, f AS (SELECT * FROM feat WHERE entity_id = 'cbsa:00003') SELECT 'cbsa:00003' AS entity_id, (SELECT n_name FROM nation WHERE n_nationkey = 3) AS display_name,
        (SELECT string_agg(key || '=' || coalesce(printf('%.3f', value), 'missing') || ' src-' || key || ',fed-0', '; ' ORDER BY key) FROM f) AS features,
        (SELECT string_agg(i || ' https://data.example/' || i, '; ' ORDER BY i) FROM (SELECT 'src-' || key i FROM f UNION SELECT 'fed-0')) AS evidence""",
    "freeze_bounds": f"{_MARKETS} SELECT key, round(lo, 4) + 0.0 AS lower, round(hi, 4) + 0.0 AS upper FROM bounds",
    "normalize_clip": f"""{_MARKETS} SELECT entity_id, key, round(value, 4) + 0.0 AS value, round(t, 4) + 0.0 AS transformed_value,
        CASE WHEN value IS NOT NULL THEN round(least(1.0, greatest(0.0, (t - lo) / (hi - lo))), 4) + 0.0 END AS normalized_value,
        entity_id IN (SELECT entity_id FROM complete) AS eligible,
        CASE WHEN value IS NULL THEN 'missing_or_invalid' ELSE 'available' END AS validation_status FROM tr JOIN bounds USING (key)""",
    "feature_audit": f"""{_MARKETS} SELECT key, round(min(value) FILTER (c), 4) + 0.0 AS raw_minimum, round(max(value) FILTER (c), 4) + 0.0 AS raw_maximum,
        round(min(t) FILTER (c), 4) + 0.0 AS transformed_minimum, round(max(t) FILTER (c), 4) + 0.0 AS transformed_maximum,
        count(value) AS observed, count(*) - count(value) AS missing, count(*) FILTER (c) AS cohort_observations,
        min(t) FILTER (c) = max(t) FILTER (c) AS constant
        FROM (SELECT *, entity_id IN (SELECT entity_id FROM complete) c FROM tr) GROUP BY 1""",
    "missing_report": f"{_MARKETS} SELECT entity_id, key FROM feat WHERE value IS NULL",
}
