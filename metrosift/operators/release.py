"""Building, correcting, publishing and digesting releases of market features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrosift.functions.parsing import canonical_id
from metrosift.functions.registry import FeatureSpec
from metrosift.operators import features as fx
from metrosift.operators.checks import CheckFailed, require_none, require_unique
from metrosift.operators.joins import join_lookup


@dataclass(frozen=True)
class Release:
    """A release as a set of tables."""

    features: DataFrame      # entity_id, key, value, unit, quality, missing_reason, provenance_ids
    references: DataFrame    # id, entity_id, category, enabled
    candidates: DataFrame    # entity_id
    cohort: DataFrame        # entity_id
    bounds: DataFrame        # key, lower, upper
    exclusions: DataFrame    # subject, reason
    provenance: DataFrame    # entity_id, id, ...

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)


def apply_measurement_policy(features: DataFrame, allow_invalid: bool) -> tuple[DataFrame, DataFrame]:
    """(features, exclusions): invalid measurements stop the job, or become missing."""
    bad = fx.invalid_measurements(features)
    notes = bad.select(
        F.concat_ws(" ", "entity_id", "key").alias("subject"),
        F.lit("numeric value fails source completeness validation").alias("reason"),
    )
    if not allow_invalid:
        require_none(notes, "Refusing to rewrite invalid source measurements")
        return features, notes
    is_bad = F.col("value").isNotNull() & (
        (F.col("quality") == "missing") | (F.coalesce(F.length("missing_reason"), F.lit(0)) > 0)
        | (F.coalesce(F.size("provenance_ids"), F.lit(0)) <= 0)
    )
    is_bad = F.coalesce(is_bad, F.lit(False))
    fixed = features.select(
        "entity_id", "key", F.when(~is_bad, F.col("value")).alias("value"), "unit",
        F.when(is_bad, "missing").otherwise(F.col("quality")).alias("quality"),
        F.when(is_bad, F.coalesce(F.nullif(F.col("missing_reason"), F.lit("")), F.lit(
            "Source record failed measurement completeness validation.")))
        .otherwise(F.col("missing_reason")).alias("missing_reason"),
        F.when(is_bad, F.array().cast("array<string>")).otherwise(F.col("provenance_ids"))
        .alias("provenance_ids"),
    )
    return fixed, notes


def disable_incomplete(references: DataFrame, wide: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    state = wide.select("entity_id", fx.is_complete(specs).alias("_complete"))
    return join_lookup(references, state, ["entity_id"], "left").withColumn(
        "enabled", F.col("enabled") & F.coalesce("_complete", F.lit(False))
    ).drop("_complete")


def cohort_of(wide: DataFrame, candidates: DataFrame, references: DataFrame, specs) -> DataFrame:
    """Complete candidates together with enabled references."""
    complete = wide.where(fx.is_complete(specs)).select("entity_id")
    return (
        candidates.select("entity_id").join(complete, "entity_id", "left_semi")
        .union(references.where("enabled").select("entity_id")).distinct()
    )


def exclusions_of(candidates, references, bounds, invalid) -> DataFrame:
    """Every reason something is left out: incomplete, disabled, invalid, constant.

    ``candidates`` has entity_id and complete.
    """
    parts = [
        candidates.where("NOT complete").select(
            F.col("entity_id").alias("subject"), F.lit("incomplete measurements").alias("reason")),
        references.where("NOT enabled").select(
            F.col("id").alias("subject"),
            F.concat(F.lit("disabled because "), "entity_id", F.lit(" has incomplete measurements")).alias("reason")),
        bounds.where("lower = upper").select(
            F.col("key").alias("subject"),
            F.lit("constant in the complete cohort; removed globally from scoring").alias("reason")),
    ]
    if invalid is not None:
        parts.append(invalid.select("subject", "reason"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build_release(
    features: DataFrame, references: DataFrame, candidates: DataFrame, provenance: DataFrame,
    specs: Sequence[FeatureSpec], optional_units: Mapping[str, str],
    reference_provenance: DataFrame | None = None, allow_invalid: bool = False,
) -> Release:
    """Canonical ids, measurement policy, explicit missing rows, cohort and frozen bounds."""
    named = features.withColumn("entity_id", canonical_id(F.col("entity_id")))
    refs = references.withColumn("entity_id", canonical_id(F.col("entity_id")))
    cand = candidates.select(canonical_id(F.col("entity_id")).alias("entity_id"))
    prov = provenance.withColumn("entity_id", canonical_id(F.col("entity_id")))
    require_unique(named, ["entity_id", "key"], "features")
    require_unique(refs, ["id"], "references")
    require_unique(cand, ["entity_id"], "candidates")
    require_none(cand.intersect(refs.select("entity_id")), "Candidates and references overlap")
    known = named.select("entity_id").distinct()
    for label, ids in (("candidates", cand), ("references", refs.select("entity_id"))):
        require_none(ids.join(known, "entity_id", "left_anti"), f"Unknown {label}")

    universe = cand.union(refs.select("entity_id")).distinct()
    kept = named.join(universe, "entity_id", "left_semi")
    kept, invalid = apply_measurement_policy(kept, allow_invalid)
    kept = fx.fill_absent(kept, dict(optional_units),
                          "This optional informational road measurement is unavailable.")
    wide = fx.to_wide(kept, specs)
    refs = disable_incomplete(refs, wide, specs)
    cohort = cohort_of(wide, cand, refs, specs)
    bounds = fx.freeze_bounds(wide.join(cohort, "entity_id", "left_semi"), specs)
    state = cand.join(wide.select("entity_id", fx.is_complete(specs).alias("complete")), "entity_id")
    exclusions = exclusions_of(state, refs, bounds, invalid)
    if reference_provenance is not None:
        prov = attach_provenance(prov, refs.select("entity_id").distinct(), reference_provenance)
    return Release(kept, refs, cand, cohort, bounds, exclusions, prov)


def attach_provenance(provenance: DataFrame, entities: DataFrame, record: DataFrame) -> DataFrame:
    """Add a provenance record (one row, no entity_id) to the given entities that lack it."""
    row = record.first()
    have = provenance.where(F.col("id") == row["id"]).select("entity_id")
    extra = entities.select("entity_id").join(have, "entity_id", "left_anti")
    for name in record.columns:
        extra = extra.withColumn(name, F.lit(row[name]).cast(record.schema[name].dataType))
    return provenance.unionByName(extra, allowMissingColumns=True)


def replace_feature(features: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """Swap all rows of one key; the new rows must cover exactly the same entities."""
    old = features.where(F.col("key") == key).select("entity_id")
    require_unique(rows, ["entity_id"], f"new {key}")
    require_none(old.join(rows, "entity_id", "left_anti"), f"New {key} lacks entities")
    require_none(rows.select("entity_id").join(old, "entity_id", "left_anti"), f"New {key} has extra entities")
    return features.where(F.col("key") != key).unionByName(
        rows.withColumn("key", F.lit(key)).select(*features.columns)
    )


def correct_release(parent: Release, key: str, rows: DataFrame, specs) -> Release:
    """Replace one feature and refreeze the bounds over the parent's own cohort."""
    features = replace_feature(parent.features, key, rows)
    cohort = fx.to_wide(features, specs).join(parent.cohort, "entity_id", "left_semi")
    return Release(features, parent.references, parent.candidates, parent.cohort,
                   fx.freeze_bounds(cohort, specs), parent.exclusions, parent.provenance)


def changed_cells(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows added, removed or changed between two tables: (keys, before, after, change)."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    joined = a.join(b, list(keys), "full")
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    )
    return joined.withColumn("change", change).where("change IS NOT NULL").drop("_a", "_b")


def require_only_key_changed(parent: DataFrame, child: DataFrame, key: str) -> None:
    diff = changed_cells(parent, child, ["entity_id", "key"], "value")
    require_none(diff.where(F.col("key") != key), f"A correction may change {key} only")


def content_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): order-free content hash by map-side sums.

    Each row's SHA-256 is added up as three numbers of 60 bits, so equal tables in any
    order agree and no change can cancel another out.
    """
    columns = sorted(df.columns)
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in columns]), 256)
    parts = [F.conv(F.substring("_row", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(3)]
    return df.select(row.alias("_row")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")).alias(f"_sum{i}") for i, p in enumerate(parts)],
    ).select("rows", F.substring(F.sha2(F.concat_ws(
        "|", F.lit(",".join(columns)), F.col("rows"), "_sum0", "_sum1", "_sum2"), 256), 1, 20).alias("digest"))


def digest_of(df: DataFrame) -> str:
    return content_digest(df).first()["digest"]


def publish(df: DataFrame, path: str) -> str:
    """Write once. The same content again is a no-op, different content an error."""
    spark = df.sparkSession
    mine = digest_of(df)
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as error:  # noqa: BLE001 - Spark raises one class for every analysis error
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        if digest_of(spark.read.parquet(path)) != mine:
            raise CheckFailed(f"A release is already stored at {path} and stays as it is") from None
    return mine


def publication_gate(parent: DataFrame, recorded_digest: str, ranked: DataFrame,
                     recorded_ranking: str, sources: DataFrame, known_hashes: DataFrame) -> None:
    """A correction may go out only from the audited parent, with its recorded ranking,
    and with every source hash known."""
    if digest_of(parent) != recorded_digest:
        raise CheckFailed("The audit was made for another parent release")
    if digest_of(ranked) != recorded_ranking:
        raise CheckFailed("The audit was made for another ranking of the parent")
    unknown = sources.select("raw_sha256").join(known_hashes.select("raw_sha256"), "raw_sha256", "left_anti")
    require_none(unknown, "Source hashes without a recorded file")
