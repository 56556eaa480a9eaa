"""Join helpers: size-checked broadcasts and hot-key splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrosift.session import stage

# Rows and bytes a side may have to be broadcast; both are measured.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A file read as it is needs no measuring up to this size.
SMALL_BYTES = 8 * 1024 * 1024
# Rows of one key that one task takes: keys with more are hot and are cut accordingly.
ROWS_PER_TASK = 500_000
# Parts that blocks of a bounded side are spread over.
SALTS = 16


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, from file sizes: high for filters and joins."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _as_stored(df: DataFrame) -> bool:
    """Whether ``df`` is a stored table, perhaps filtered or with fewer columns, so that its estimate holds."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        kind = plan.getClass().getSimpleName()
        if kind in ("LogicalRelation", "LocalRelation"):
            return True
        if kind == "Project":
            made = plan.projectList()
            if any(made.apply(i).getClass().getSimpleName() != "AttributeReference" for i in range(made.size())):
                return False
        elif kind != "Filter":
            return False
        plan = plan.children().apply(0)


def measured(df: DataFrame, limit: int) -> tuple[int, int]:
    """Rows and bytes of ``df``, read up to ``limit`` + 1 rows; only row sizes leave the tasks."""
    sizes = df.select(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("b")).limit(limit + 1)
    row = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def fits(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is small enough to broadcast, in rows and in bytes.

    A small stored table is settled by its file size. Anything derived is measured, as
    an estimate knows nothing of exploded rows or of what arrays hold.
    """
    if limit >= BROADCAST_ROWS and _as_stored(df) and estimated_bytes(df) <= SMALL_BYTES:
        return True
    rows, size = measured(df, limit)
    return rows <= limit and size <= most_bytes


def join_lookup(
    big: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large table to a lookup with unique keys.

    Broadcast when the lookup is measured to be small. Otherwise rows with a hot key
    meet a broadcast of just those keys, and all other rows take an ordinary shuffle
    join, so no task gets a whole hot key. A lookup in which hot keys repeat is refused.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join_lookup does not support {how}")
    if fits(lookup, limit):
        return big.join(F.broadcast(lookup), on, how)
    hot = stage(hot_keys(big, on), "hot-keys")
    hot_lookup = lookup.join(F.broadcast(hot.select(*on)), on, "left_semi")
    if how in ("inner", "left") and not hot_lookup.groupBy(*on).count().where("count > 1").isEmpty():
        raise ValueError("The lookup's keys are not unique")
    marked = big.join(F.broadcast(hot), on, "left")
    is_hot = F.col("_hot").isNotNull()
    a = marked.where(is_hot).drop("_hot").join(F.broadcast(hot_lookup), on, how)
    b = marked.where(~is_hot).drop("_hot").join(lookup, on, how)
    return a.unionByName(b)


def hot_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys with more rows than a task takes, and the number of tasks (``_hot``) each needs.

    There are at most rows / ROWS_PER_TASK of them.
    """
    return (
        df.groupBy(*on).agg(F.count(F.lit(1)).alias("_c"))
        .where(F.col("_c") > ROWS_PER_TASK)
        .select(*on, F.ceil(F.col("_c") / ROWS_PER_TASK).cast("int").alias("_hot"))
    )


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: Column, how: str = "inner", hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of two large sides in which a hot key of ``left`` meets as many reducers as its size needs.

    Hot keys are counted first, by a map-side aggregate. Their ``left`` rows are spread
    over the tasks counted for them and only their ``right`` rows are repeated as often;
    everything else is shuffled once, as in a plain join. ``hot``: the stored ``hot_keys`` of ``left``, if known.
    """
    hot = F.broadcast(stage(hot_keys(left, on), "hot-keys") if hot is None else hot)
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread_by), F.col("_hot")).cast("int")).otherwise(0)
    copies = F.sequence(F.lit(0), F.coalesce("_hot", F.lit(1)) - 1)
    l = left.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    r = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return l.join(r, [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small table as many partitions as there are cores.

    For steps that do much work per row: a small file is one split and would be one
    task. A large table already has many splits and is left as it is.
    """
    if estimated_bytes(df) > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
