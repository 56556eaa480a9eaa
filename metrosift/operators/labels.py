"""Resolve place labels against official area names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrosift.functions.text import normalized_name
from metrosift.operators.checks import require_none
from metrosift.operators.joins import salted_join


def match_labels(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(label_id, matches, area_id): areas whose name holds the label's city and state.

    ``labels``: label_id, city, state. ``areas``: area_id, name. "Holds" is a substring
    test, so a plain condition would compare every label with every area. Instead each
    distinct name lists its substrings of the lengths the labels have, which turns the
    test into an equi-join; area_id is the lowest match.
    """
    wanted = labels.select("label_id", normalized_name(F.col("city")).alias("_part"), F.upper("state").alias("_state"))
    lengths = sorted(r[0] for r in wanted.select(F.length("_part")).distinct().collect() if r[0])
    names = areas.groupBy("name").agg(F.min("area_id").alias("area_id"), F.count(F.lit(1)).alias("n")).withColumn(
        "_norm", normalized_name(F.col("name")))
    parts = names.withColumn("_length", F.explode(F.lit(lengths or [0]))).where(
        F.length("_norm") >= F.col("_length")
    ).withColumn("_part", F.explode(F.expr(
        "array_distinct(transform(sequence(1, length(_norm) - _length + 1), i -> substr(_norm, i, _length)))")))
    hits = salted_join(parts, wanted, ["_part"], F.col("name")).where(F.contains(F.upper("name"), F.col("_state")))
    found = hits.groupBy("label_id").agg(F.sum("n").alias("matches"), F.min("area_id").alias("area_id"))
    return labels.select("label_id").join(found, "label_id", "left").select(
        "label_id", F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.col("matches") == 1, F.col("area_id")).alias("area_id"))


def resolve_labels(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Every label must match exactly one area."""
    matched = match_labels(labels, areas)
    require_none(matched.where("matches <> 1"), "Cannot uniquely resolve labels")
    return matched.select("label_id", "area_id")
