"""Sinks of feature tables and intermediates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_intermediate(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, optionally partitioned so one metro can be read without the rest."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def wide_values(features: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("value", "quality")) -> DataFrame:
    """One row per entity with ``{key}_value`` and ``{key}_quality`` columns.

    Keys are configuration, so this is one conditional aggregate instead of a pivot
    that first has to look the keys up.
    """
    return features.groupBy("entity_id").agg(*[
        F.max(F.when(F.col("key") == k, F.col(f))).alias(f"{k}_{f}") for k in keys for f in fields
    ])


def entity_documents(features: DataFrame) -> DataFrame:
    """(entity_id, document): each entity's measurements as one JSON text, keys sorted."""
    entry = F.struct("key", F.struct(
        *[c for c in ("value", "unit", "quality", "missing_reason", "provenance_ids") if c in features.columns]
    ).alias("m"))
    # Bounded by the registered keys of one entity.
    packed = features.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("features"))
    return packed.select("entity_id", F.to_json(F.struct("entity_id", "features")).alias("document"))


def write_entities(features: DataFrame, path: str) -> None:
    """One folder per entity with its JSON document."""
    entity_documents(features).withColumnRenamed("document", "value").write.mode("overwrite").partitionBy(
        "entity_id").text(path)


def detail_rows(features: DataFrame) -> DataFrame:
    return features.select(
        "entity_id", "key", "value", "unit", "quality", "missing_reason",
        F.concat_ws("; ", "provenance_ids").alias("provenance_ids"),
    )


def provenance_rows(entities: DataFrame) -> DataFrame:
    """Explode ``provenance`` (array of structs) to one row per record."""
    rows = entities.select("entity_id", F.explode("provenance").alias("p")).select("entity_id", "p.*")
    if "assumptions" in rows.columns:
        rows = rows.withColumn("assumptions", F.concat_ws("; ", "assumptions"))
    return rows


def export_tables(features: DataFrame, entities: DataFrame, keys: Sequence[str], path: str, fmt: str = "parquet") -> None:
    """Wide values, long details and provenance as three tables."""
    options = {"header": "true"} if fmt == "csv" else {}
    for name, table in {
        "values": wide_values(features, keys, ("value",)), "details": detail_rows(features),
        "provenance": provenance_rows(entities),
    }.items():
        table.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/{name}")
