"""Reconciliation and validation. Each check returns its violating rows or a report row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrosift.functions.registry import ROAD_SHARES, UNSCORED_UNITS, FeatureSpec, normalized, transformed_by
from metrosift.functions.text import query_parameter
from metrosift.operators import features as fx
from metrosift.operators.checks import same_rows
from metrosift.operators.joins import join_lookup

SHA256_PATTERN = r"^[a-f0-9]{64}$"


def unresolved_provenance(features: DataFrame, provenance: DataFrame) -> DataFrame:
    """(entity_id, id): cited ids that the entity has no provenance record for."""
    cited = features.select("entity_id", F.explode("provenance_ids").alias("id")).distinct()
    return cited.join(provenance.select("entity_id", "id").distinct(), ["entity_id", "id"], "left_anti")


def reconcile(source: DataFrame, release: DataFrame, keys: Sequence[str], value: str,
              tolerance: float = 0.0) -> DataFrame:
    """Compare two tables with unique keys: one row per key with its status."""
    a = source.select(*keys, F.col(value).alias("source_value"), F.lit(True).alias("_a"))
    b = release.select(*keys, F.col(value).alias("release_value"), F.lit(True).alias("_b"))
    joined = a.join(b, list(keys), "full")
    same = F.col("source_value").eqNullSafe(F.col("release_value"))
    if tolerance:
        same = same | F.coalesce(F.abs(F.col("source_value") - F.col("release_value")) <= tolerance, F.lit(False))
    status = (
        F.when(F.col("_a").isNull(), "release_only").when(F.col("_b").isNull(), "source_only")
        .when(same, "equal").otherwise("different")
    )
    return joined.withColumn("status", status).drop("_a", "_b")


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Retained manifest rows whose file is absent or differs in size or hash."""
    joined = manifest.where("retained").join(
        files.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha")), "path", "left"
    )
    problem = (
        F.when(F.col("_sha").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "size")
        .when(F.col("_sha") != F.col("sha256"), "hash")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").drop("_bytes", "_sha")


def provenance_counts(provenance: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """One row: provenance records, distinct hashes, and hashes the manifest lacks.

    Distinct hashes are counted by grouping first, so no task holds a set of them.
    """
    by_hash = provenance.groupBy("raw_sha256").agg(F.count(F.lit(1)).alias("n"))
    known = known_hashes.select("raw_sha256").distinct().withColumn("_known", F.lit(True))
    return by_hash.join(known, "raw_sha256", "left").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("distinct_hashes"),
        F.count_if(F.col("_known").isNull()).alias("unknown_hashes"),
    )


def bounds_differences(cohort: DataFrame, specs: Sequence[FeatureSpec], frozen: DataFrame) -> DataFrame:
    """Recomputed bounds that differ from the frozen ones."""
    again = fx.freeze_bounds(cohort, specs)
    mine, theirs = again.select("key", "lower", "upper"), frozen.select("key", "lower", "upper")
    return mine.exceptAll(theirs).unionByName(theirs.exceptAll(mine))


def climate_mismatches(
    measurements: DataFrame, provenance: DataFrame, stations: DataFrame, mean_keys: Sequence[str],
    factor: float = 25.4, tolerance: float = 1e-8,
) -> DataFrame:
    """Climate values that their cited stations do not explain.

    The station id is read from the cited URL; keys in ``mean_keys`` are the mean over
    their stations, the others one station's value times ``factor``. ``stations`` has
    station_id, key, value (already flag-checked).
    """
    cited = measurements.select("entity_id", "key", "value", F.explode("provenance_ids").alias("id"))
    located = cited.join(provenance.select("entity_id", "id", "source_url"), ["entity_id", "id"]).withColumn(
        "station_id", query_parameter(F.col("source_url"), "stations")
    )
    observed = join_lookup(
        located.where("station_id IS NOT NULL"),
        stations.select("station_id", "key", F.col("value").alias("_v")), ["station_id", "key"], "left",
    )
    found = observed.groupBy("entity_id", "key").agg(
        F.avg("_v").alias("_mean"), F.min(F.struct("id", "_v")).alias("_one"),
        F.count(F.lit(1)).alias("_cited"), F.count("_v").alias("_seen"),
    )
    expected = F.when(F.col("key").isin(list(mean_keys)), F.col("_mean")).otherwise(F.col("_one._v") * factor)
    joined = measurements.select("entity_id", "key", "value").join(found, ["entity_id", "key"], "left")
    return joined.withColumn("expected", expected).where(
        F.col("_cited").isNull() | (F.col("_seen") < F.col("_cited"))
        | (F.abs(F.col("value") - F.col("expected")) > tolerance)
    ).select("entity_id", "key", "value", "expected")


def selection_mismatches(claimed: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(place_id, key) whose ordered station list differs from the recomputed one.

    Both sides: place_id, key, nearness, station_id. At most k rows per group.
    """
    def lists(df, name):
        return df.groupBy("place_id", "key").agg(
            F.array_sort(F.collect_list(F.struct("nearness", "station_id"))).alias(name)
        )

    return lists(claimed, "claimed").join(lists(recomputed, "recomputed"), ["place_id", "key"], "full").where(
        ~F.col("claimed").eqNullSafe(F.col("recomputed"))
    )


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table only, tagged with the side."""
    return (
        a.exceptAll(b.select(*a.columns)).withColumn("side", F.lit("first"))
        .unionByName(b.select(*a.columns).exceptAll(a).withColumn("side", F.lit("second")))
    )


def measurement_violations(features: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """(entity_id, key, rule) for every broken measurement rule, in one pass."""
    unit = F.create_map(*[F.lit(x) for s in specs for x in (s.key, s.unit)]
                        + [F.lit(x) for k, u in UNSCORED_UNITS.items() for x in (k, u)])
    caps = [x for s in specs if s.maximum is not None for x in (s.key, float(s.maximum))]
    top = F.create_map(*[F.lit(x) for x in caps]) if caps else F.lit(None)
    value, missing = F.col("value"), F.col("value").isNull()
    reason = F.coalesce(F.length("missing_reason"), F.lit(0)) > 0
    rules = {
        "missing without reason": missing & ((F.col("quality") != "missing") | ~reason),
        "value marked missing": ~missing & ((F.col("quality") == "missing") | reason),
        "value without provenance": ~missing & (F.coalesce(F.size("provenance_ids"), F.lit(0)) <= 0),
        "unknown quality": ~F.col("quality").isin("observed", "derived", "proxy", "missing"),
        "not finite": F.isnan(value) | (F.abs(value) == float("inf")),
        "negative": value < 0,
        "above maximum": value > top[F.col("key")],
        "wrong unit": F.col("unit") != unit[F.col("key")],
    }
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    return features.select("entity_id", "key", F.explode(broken).alias("rule"))


def share_sum_violations(features: DataFrame, keys: Sequence[str] = ROAD_SHARES,
                         tolerance: float = 1e-6) -> DataFrame:
    """Entities whose class shares are all present but do not sum to one."""
    sums = features.where(F.col("key").isin(list(keys))).groupBy("entity_id").agg(
        F.sum("value").alias("share_sum"), F.count("value").alias("_n")
    )
    return sums.where((F.col("_n") == len(keys)) & (F.abs(F.col("share_sum") - 1) > tolerance)).drop("_n")


def entity_violations(entities: DataFrame) -> DataFrame:
    """(entity_id, rule): id form, coordinate domain, mixed versions."""
    rules = {
        "id": ~F.col("entity_id").rlike(r"^cbsa:\d{5}$"),
        "latitude": ~F.col("latitude").between(-90, 90),
        "longitude": ~F.col("longitude").between(-180, 180),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in rules.items()]))
    return entities.select("entity_id", F.explode(broken).alias("rule"))


def provenance_violations(provenance: DataFrame, verified: bool) -> DataFrame:
    """(entity_id, id, rule): repeated ids, bad hashes, synthetic or non-HTTPS evidence."""
    rules = {"hash": ~F.coalesce(F.col("raw_sha256").rlike(SHA256_PATTERN), F.lit(False))}
    if verified:
        rules["synthetic"] = F.contains(F.lower(F.concat("source_name", "dataset_id")), F.lit("synthetic"))
        rules["https"] = ~F.col("source_url").startswith("https://")
    broken = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    single = provenance.select("entity_id", "id", F.explode(broken).alias("rule"))
    repeated = provenance.groupBy("entity_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "entity_id", "id", F.lit("repeated id").alias("rule")
    )
    return single.unionByName(repeated)


def legal_violations(evidence: DataFrame) -> DataFrame:
    """Documented legal claims that cite no evidence, or carry an unknown category."""
    known = F.col("category").isin("documented_pathway", "documented_restriction", "unresolved")
    return evidence.where(~known | ((F.col("category") != "unresolved") & (F.size("provenance_ids") <= 0)))


def audit_rows(features: DataFrame, specs: Sequence[FeatureSpec], bounds: DataFrame,
               cohort: DataFrame, registry: DataFrame) -> DataFrame:
    """Raw, transformed and normalized value of every registered measurement."""
    keyed = features.join(F.broadcast(registry.select("key", "position", "pillar", "transform")), "key")
    bounded = keyed.join(F.broadcast(bounds), "key")
    t = transformed_by(F.col("value"), F.col("transform"))
    marked = join_lookup(bounded, cohort.select("entity_id").distinct().withColumn("_in", F.lit(True)),
                         ["entity_id"], "left")
    return marked.select(
        "entity_id", "key", "position", "pillar", "value", "transform", t.alias("transformed_value"),
        "lower", "upper", normalized(t, F.col("lower"), F.col("upper")).alias("normalized_value"),
        F.coalesce("_in", F.lit(False)).alias("eligible"),
        F.when(F.col("value").isNull(), "missing_or_invalid").otherwise("available").alias("validation_status"),
    )


def is_deterministic(build) -> bool:
    """Run a table-building function twice and compare the results."""
    return same_rows(build(), build())


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per named check with its number of violating rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
             for name, df in checks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("passed", F.col("violations") == 0)
