"""The long and the wide form of feature tables, bounds, coverage and audits.

Long: one row per (entity_id, key) with value, unit, quality, missing_reason and
provenance_ids. Wide: one row per entity with one double column per registered key.
The registry is configuration (tens of keys), so wide columns are plain expressions
and the only shuffle is the one that brings an entity's keys together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrosift.functions.registry import FeatureSpec, normalized, transform_sql, transformed
from metrosift.operators.checks import CheckFailed, require_none


def measurement(
    value: Column, unit: str, provenance_ids: Column | None, quality: str = "derived",
    reason: str | Column | None = None,
) -> Column:
    """A measurement struct: null means missing with a reason, else value with provenance."""
    why = reason if isinstance(reason, Column) else F.lit(reason or "Source value unavailable.")
    ids = provenance_ids if provenance_ids is not None else F.array().cast("array<string>")
    present = value.isNotNull()
    return F.struct(
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        F.when(present, quality).otherwise("missing").alias("quality"),
        F.when(~present, why).alias("missing_reason"),
        F.when(present, ids).otherwise(F.array().cast("array<string>")).alias("provenance_ids"),
    )


def to_long(wide: DataFrame, keys: Sequence[str], entity: str = "entity_id") -> DataFrame:
    """Unpivot value columns to (entity_id, key, value) rows."""
    values = [F.col(k).cast("double").alias(k) for k in keys]
    return wide.select(F.col(entity).alias("entity_id"), *values).unpivot(
        "entity_id", list(keys), "key", "value"
    )


def to_wide(features: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """One row per entity; a repeated (entity, key) pair stops the job.

    Conditional max and count combine on the map side, so even a dirty entity with
    very many repeated rows sends one partial row per task.
    """
    keyed = F.col("key")
    values = [F.max(F.when(keyed == s.key, F.col("value"))).alias(s.key) for s in specs]
    counts = [F.count_if(keyed == s.key) for s in specs]
    most = F.greatest(*counts, F.lit(0)) if counts else F.lit(0)
    grouped = features.groupBy("entity_id").agg(*values, most.alias("_most"))
    unique = F.when(
        F.col("_most") > 1, F.raise_error(F.lit("Repeated feature of one entity")).cast("boolean")
    ).otherwise(F.lit(True))
    return grouped.where(unique).drop("_most")


def missing_keys(specs: Sequence[FeatureSpec]) -> Column:
    """Names of the null features in registry order."""
    return F.array_compact(F.array(*[F.when(F.col(s.key).isNull(), s.key) for s in specs]))


def is_complete(specs: Sequence[FeatureSpec]) -> Column:
    out = F.lit(True)
    for s in specs:
        out = out & F.col(s.key).isNotNull()
    return out


def coverage(specs: Sequence[FeatureSpec]) -> Column:
    return (F.lit(len(specs)) - F.size(missing_keys(specs))) / F.lit(len(specs))


def freeze_bounds(cohort: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """(key, lower, upper) in transformed space over a complete cohort of wide rows.

    One scan with map-side min/max; the result has one row per registered key.
    """
    aggregates = [F.expr("count(1)").alias("_n")]
    for i, s in enumerate(specs):
        t = transform_sql(s)
        aggregates += [F.expr(e) for e in (f"min({t}) AS _lo{i}", f"max({t}) AS _hi{i}", f"count(`{s.key}`) AS _n{i}")]
    rows = ", ".join(
        f"named_struct('key', '{s.key}', 'lower', CASE WHEN _n = 0 THEN raise_error('Empty normalization cohort') "
        f"WHEN _n{i} < _n THEN raise_error('Incomplete normalization cohort: {s.key}') ELSE _lo{i} END, 'upper', _hi{i})"
        for i, s in enumerate(specs)
    )
    return cohort.agg(*aggregates).select(F.expr(f"inline(array({rows}))"))


def bounds_of(bounds: DataFrame, specs: Sequence[FeatureSpec]) -> dict[str, tuple[float, float]]:
    """The bounds table as parameters; refuses one that does not match the registry."""
    rows = bounds.select("key", "lower", "upper").limit(len(specs) + 1).collect()
    found = {r["key"]: (r["lower"], r["upper"]) for r in rows}
    if len(rows) != len(specs) or found.keys() != {s.key for s in specs}:
        raise CheckFailed("Registry and bounds must match")
    if any(lo > hi for lo, hi in found.values()):
        raise CheckFailed("A lower bound is above its upper bound")
    return found


def normal_column(spec: FeatureSpec, bounds: dict[str, tuple[float, float]]) -> Column:
    return normalized(transformed(F.col(spec.key), spec.transform), *bounds[spec.key])


def feature_audit(
    universe: DataFrame, cohort: DataFrame, specs: Sequence[FeatureSpec], bounds: DataFrame
) -> DataFrame:
    """Per feature: raw and transformed range, frozen bounds, observed, missing and
    cohort counts, constant flag. Two map-side aggregates, one row each."""

    def spread(df: DataFrame, expressions: dict[str, callable]) -> DataFrame:
        one = df.agg(
            F.count(F.lit(1)).alias("_n"),
            *[f(s).alias(f"{s.key}.{name}") for s in specs for name, f in expressions.items()],
        )
        return one.select(F.inline(F.array(*[
            F.struct(
                F.lit(s.key).alias("key"), F.col("_n").alias("_n"),
                *[F.col(f"`{s.key}.{name}`").alias(name) for name in expressions],
            )
            for s in specs
        ])))

    def t(s):
        return transformed(F.col(s.key), s.transform)

    seen = spread(universe, {"observed": lambda s: F.count(s.key)}).withColumn(
        "missing", F.col("_n") - F.col("observed")
    ).drop("_n")
    ranges = spread(cohort, {
        "raw_minimum": lambda s: F.min(s.key), "raw_maximum": lambda s: F.max(s.key),
        "transformed_minimum": lambda s: F.min(t(s)), "transformed_maximum": lambda s: F.max(t(s)),
    }).withColumnRenamed("_n", "cohort_observations")
    # Three tables with one row per registered key each.
    return (
        seen.join(F.broadcast(ranges), "key").join(F.broadcast(bounds), "key")
        .withColumn("constant", F.col("lower") == F.col("upper"))
    )


def missing_report(wide: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """(entity_id, key) of every missing registered feature."""
    return wide.select("entity_id", F.explode(missing_keys(specs)).alias("key"))


def invalid_measurements(features: DataFrame) -> DataFrame:
    """Rows with a value that also claim to be missing or cite no provenance."""
    return features.where(
        F.col("value").isNotNull()
        & (
            (F.col("quality") == "missing")
            | (F.coalesce(F.length("missing_reason"), F.lit(0)) > 0)
            | (F.coalesce(F.size("provenance_ids"), F.lit(0)) <= 0)
        )
    )


def fill_absent(features: DataFrame, units: dict[str, str], reason: str) -> DataFrame:
    """Add an explicit missing row for each key an entity has no row for.

    The absent keys are found inside the entity's own aggregate: no cross join.
    """
    registered = F.array(*[F.lit(k) for k in units])
    unit_of = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    # collect_set is bounded by the number of registered keys because of the filter.
    absent = (
        features.groupBy("entity_id")
        .agg(F.collect_set(F.when(F.col("key").isin(list(units)), F.col("key"))).alias("_have"))
        .select("entity_id", F.explode(F.array_except(registered, "_have")).alias("key"))
        .select(
            "entity_id", "key", F.lit(None).cast("double").alias("value"),
            unit_of[F.col("key")].alias("unit"), F.lit("missing").alias("quality"),
            F.lit(reason).alias("missing_reason"),
            F.array().cast("array<string>").alias("provenance_ids"),
        )
    )
    return features.unionByName(absent)


def fill_from(features: DataFrame, key: str, second: DataFrame, provenance_id: str,
              quality: str = "observed") -> DataFrame:
    """Fill missing values of one key from (entity_id, value); everything else stays.

    Unusable values in ``second`` (null or negative) fill nothing.
    """
    from metrosift.operators.joins import join_lookup

    other = second.select("entity_id", F.col("value").alias("_new")).where(F.col("_new") >= 0)
    take = (F.col("key") == key) & F.col("value").isNull() & F.col("_new").isNotNull()
    joined = join_lookup(features.where(F.col("key") == key), other, ["entity_id"], "left")
    filled = joined.select(
        "entity_id", "key",
        F.when(take, F.col("_new")).otherwise(F.col("value")).alias("value"), "unit",
        F.when(take, quality).otherwise(F.col("quality")).alias("quality"),
        F.when(~take, F.col("missing_reason")).alias("missing_reason"),
        F.when(take, F.array(F.lit(provenance_id))).otherwise(F.col("provenance_ids"))
        .alias("provenance_ids"),
    )
    return features.where(F.col("key") != key).unionByName(filled)


def require_complete(wide: DataFrame, specs: Sequence[FeatureSpec], label: str) -> DataFrame:
    require_none(wide.where(~is_complete(specs)).select("entity_id"), f"Incomplete {label}")
    return wide
