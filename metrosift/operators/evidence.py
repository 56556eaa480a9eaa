"""Evidence ids carried from measurements to factors, scores and explanations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrosift.operators.checks import require_none
from metrosift.operators.joins import join_lookup

def _none() -> Column:
    return F.array().cast("array<string>")


def union_of_ids(rows: DataFrame, by: Sequence[str], ids: str = "provenance_ids", name: str = "evidence_ids") -> DataFrame:
    """Per group of ``by`` the sorted distinct ids of its rows; groups without any have none, not null.

    Repeated ids are dropped on the map side and again per (group, id), so a group with
    many rows is not one task's work; what is gathered is a group's distinct ids.
    """
    spread = rows.select(*by, F.explode_outer(ids).alias("_id")).distinct()
    return spread.groupBy(*by).agg(F.sort_array(F.collect_set("_id")).alias(name))


def merged_ids(*arrays: Column) -> Column:
    """Sorted distinct union of id arrays of one row; a null array counts as empty."""
    parts = F.flatten(F.array(*[F.coalesce(a, _none()) for a in arrays]))
    return F.sort_array(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())))


def evidence_by_key(features: DataFrame) -> DataFrame:
    """(entity_id, ids_by_key): every entity's measurements with the ids they cite, in the order they cite them.

    ``features``: entity_id, key, provenance_ids, one row per measurement.
    """
    entry = F.struct("key", F.coalesce("provenance_ids", _none()).alias("ids"))
    return features.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(entry)).alias("ids_by_key"))


def with_factor_evidence(scored: DataFrame, features: DataFrame) -> DataFrame:
    """``scored`` with ``provenance_ids`` in each of its ``factors``, and their union as ``evidence_ids``."""
    cited = join_lookup(scored, evidence_by_key(features), ["entity_id"], "left")
    factors = F.transform("factors", lambda f: f.withField(
        "provenance_ids", F.coalesce(F.try_element_at("ids_by_key", f["key"]), _none())))
    return cited.withColumn("factors", factors).withColumn(
        "evidence_ids", merged_ids(F.flatten(F.transform("factors", lambda f: f["provenance_ids"])))).drop("ids_by_key")


def explained(rows: DataFrame, scored: DataFrame, references: DataFrame, ranking: DataFrame, mode: str = "template") -> DataFrame:
    """Explanation rows with evidence_ids, mode and ranking_id.

    ``scored`` comes from ``with_factor_evidence``. ``references``: id, provenance_ids. ``ranking``
    is one row with ranking_id. A ranked entity cites what its factors and its nearest reference cite,
    an unranked one nothing.
    """
    near = scored.select("entity_id", F.col("evidence_ids").alias("_own"), F.get(F.col("matches"), F.lit(0))["reference_id"].alias("_near"))
    cited = references.select(F.col("id").alias("_near"), F.col("provenance_ids").alias("_ref"))
    # Many entities share one nearest reference, so this key runs hot by nature.
    both = join_lookup(near, cited, ["_near"], "left")
    out = rows.join(both, "entity_id", "left").withColumn("_one", F.lit(1)).join(
        F.broadcast(ranking.select("ranking_id").withColumn("_one", F.lit(1))), "_one")
    is_ranked = F.col("rank").isNotNull()
    return out.withColumns({
        "evidence_ids": F.when(is_ranked, merged_ids(F.col("_own"), F.col("_ref"))).otherwise(_none()), "mode": F.lit(mode),
    }).drop("_own", "_ref", "_near", "_one")


def ranking_id(references: DataFrame, shares: Mapping[str, float], version: Column) -> DataFrame:
    """One row (ranking_id): the same for the same data version, weights and set of references.

    References are told by a sum of their hashes, so their number does not matter.
    """
    part = F.conv(F.substring(F.sha2("id", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    weights = ",".join(f"{p}={s:.6f}" for p, s in sorted(shares.items()))
    return references.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).alias("h")).select(
        F.sha2(F.concat_ws("|", version, F.lit(weights), F.col("n").cast("string"), F.col("h").cast("string")), 256).alias("ranking_id"))


def lookup(entity: str, entities: DataFrame, features: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row: the entity with its measurements and the provenance records they cite, sorted by key and id.

    The filter on the id reaches all three scans; an unknown or repeated id stops the job.
    """
    own = entities.where(F.col("entity_id") == entity)
    n = own.limit(2).count()
    if n != 1:
        raise LookupError(f"{n} entities have the id {entity}")
    values = features.where(F.col("entity_id") == entity)
    records = provenance.where(F.col("entity_id") == entity)
    cited = values.select(F.explode("provenance_ids").alias("id")).distinct()
    require_none(cited.join(records, "id", "left_anti"), "Cited ids without a record")
    kept = records.join(F.broadcast(cited), "id", "left_semi").drop("entity_id")
    cell = F.struct("key", *[c for c in values.columns if c not in ("entity_id", "key")])
    record = F.struct("id", *[c for c in kept.columns if c != "id"])
    one = lambda df, column, name: df.agg(F.array_sort(F.collect_list(column)).alias(name)).withColumn("_one", F.lit(1))
    return own.withColumn("_one", F.lit(1)).join(one(values, cell, "features"), "_one").join(one(kept, record, "evidence"), "_one").drop("_one")
