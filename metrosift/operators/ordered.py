"""Order-dependent operators that never put one key, or all rows, into one task.

``Window.partitionBy(key)`` sends a hot key to a single task and an unpartitioned
window sends everything there. The operators below range-partition the rows by the
full order (key first, unique id last), so a hot key is cut into as many slices as
its size needs. Each slice is worked on alone and one small row per slice (never
more rows than there are shuffle partitions) carries state to the next slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrosift.session import stage

SLOT = "_slot"
SLICE = "_slice"
# Fixed by Spark: monotonically_increasing_id keeps the row index in the low 33 bits.
_ROW_BITS = 33


def lay_out(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sort globally and store the rows with their slice and position numbers.

    ``order`` has to end in a unique key: rows that tie on all of it cannot be split.
    The table is written once because slice numbers must not change between uses.
    """
    placed = df.orderBy(*order).withColumn(SLOT, F.monotonically_increasing_id())
    return stage(placed.withColumn(SLICE, F.shiftright(SLOT, _ROW_BITS)), "ordered")


def _within() -> Window:
    return Window.partitionBy(SLICE).orderBy(SLOT)


def _across() -> Window:
    # One row per slice, at most spark.sql.shuffle.partitions rows.
    return Window.orderBy(SLICE)


def _before(column: str) -> Column:
    return F.coalesce(
        F.sum(column).over(_across().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )


def add_position(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Global 1-based row number under ``order``: one range shuffle, no second one."""
    laid = lay_out(df, order)
    sizes = laid.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(SLICE, _before("_n").alias("_start"))
    row = F.col(SLOT) - F.shiftleft(F.col(SLICE), _ROW_BITS)
    return (
        laid.join(F.broadcast(starts), SLICE)
        .withColumn(name, (F.col("_start") + row + 1).cast("long"))
        .drop(SLICE, SLOT, "_start")
    )


def add_running_total(
    df: DataFrame, order: list[Column], value: str, name: str = "running"
) -> DataFrame:
    """Running sum of ``value`` over the whole order."""
    laid = lay_out(df, order)
    sums = laid.groupBy(SLICE).agg(F.sum(value).alias("_sum"))
    starts = sums.select(SLICE, _before("_sum").alias("_start"))
    inside = F.sum(value).over(_within().rowsBetween(Window.unboundedPreceding, 0))
    return (
        laid.withColumn("_inside", inside)
        .join(F.broadcast(starts), SLICE)
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop(SLICE, SLOT, "_start", "_inside")
    )


def add_neighbor(
    df: DataFrame, order: list[Column], fields: list[str], name: str, step: int = 1
) -> DataFrame:
    """Struct of ``fields`` from the next (step=1) or previous (step=-1) row.

    The neighbor is global: callers compare its key with their own row's key.
    """
    if step not in (1, -1):
        raise ValueError("step must be 1 or -1")
    laid = lay_out(df, order)
    cell = F.struct(*fields)
    edge = F.min_by(cell, SLOT) if step == 1 else F.max_by(cell, SLOT)
    edges = laid.groupBy(SLICE).agg(edge.alias("_edge"))
    shift = F.lead if step == 1 else F.lag
    edges = edges.select(SLICE, shift("_edge").over(_across()).alias("_edge"))
    return (
        laid.withColumn("_near", shift(cell).over(_within()))
        .join(F.broadcast(edges), SLICE)
        .withColumn(name, F.coalesce("_near", "_edge"))
        .drop(SLICE, SLOT, "_near", "_edge")
    )


def carry_last(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Last non-null ``value`` at or before each row in the global order."""
    laid = lay_out(df, order)
    tails = laid.groupBy(SLICE).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(SLOT))).alias("_tail")
    )
    past = _across().rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(SLICE, F.last("_tail", ignorenulls=True).over(past).alias("_tail"))
    seen = F.last(value, ignorenulls=True).over(
        _within().rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        laid.withColumn("_seen", seen)
        .join(F.broadcast(tails), SLICE)
        .withColumn(name, F.coalesce("_seen", "_tail"))
        .drop(SLICE, SLOT, "_seen", "_tail")
    )


def exact_percentiles(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, as one row ``p0, p1, ...``.

    Spark's ``percentile`` keeps every distinct value of a group in one aggregation
    buffer. Here equal values are counted first (a hot value becomes one row), the
    distinct values are range-partitioned and only the running counts are compared.
    """
    counts = (
        df.select(F.col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy("_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    running = add_running_total(counts, [F.col("_v")], "_n", "_upto")
    total = F.max("_upto")
    at = []
    # The target position depends on the total, so both are taken in one pass each.
    n = running.agg(total.alias("n")).first()["n"]
    for i, q in enumerate(quantiles):
        if n is None:
            at.append(F.lit(None).cast("double").alias(f"p{i}"))
            continue
        spot = (n - 1) * q
        low, high = int(spot), min(int(spot) + 1, n - 1)
        a = F.min(F.when(F.col("_upto") > low, F.col("_v")))
        b = F.min(F.when(F.col("_upto") > high, F.col("_v")))
        at.append((a + (b - a) * F.lit(spot - low)).alias(f"p{i}"))
    return running.agg(*at)
