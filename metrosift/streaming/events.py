"""Structured Streaming forms of the fleet-log accounting rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrosift.operators.checks import CheckFailed
from metrosift.session import scratch_path


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str, time: str = "ts") -> DataFrame:
    """A file stream of event tables; zone-less times are read as UTC."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn(time, F.col(time).cast("timestamp"))


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a Parquet table and read that back."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{path}-checkpoint").option("path", path).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def newest(updates: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run a stream of updates over everything available and give each key's rows of the last batch that has it.

    So keys the watermark has not closed are there too, as they stand, and state need not
    hold closed ones. A batch is a partition that is overwritten on a retry.
    """
    spark = updates.sparkSession
    path = scratch_path(spark, label)
    spark.createDataFrame([], updates.schema).write.parquet(f"{path}/_n=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_n={number}")

    updates.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True).option(
        "checkpointLocation", f"{path}-checkpoint").start().awaitTermination()
    told = spark.read.schema(updates.schema.add("_n", "long")).parquet(path)
    last = told.withColumn("_last", F.max("_n").over(Window.partitionBy(*keys)))
    return last.where("_n = _last").drop("_n", "_last")


def hourly(events: DataFrame, time: str, by: list[str], delay: str, cutoff: str | None = None) -> DataFrame:
    """Hourly counts and value sums on event time, rows at or after the cut-off dropped.

    Late rows beyond the watermark are dropped by Spark; state holds open hours only.
    """
    kept = events.where(F.col(time) < F.lit(cutoff).cast("timestamp")) if cutoff else events
    return (
        kept.withWatermark(time, delay).groupBy(F.window(time, "1 hour"), *by)
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("hour"), *by, "events", "value")
    )


def checked_batches(stream: DataFrame, check, path: str, label: str = "checked"):
    """Write each micro-batch after ``check`` passed on it; a failing batch stops the query.

    The batch number is a partition that is overwritten on a retry, so a batch that runs
    twice is stored once.
    """
    def write(batch: DataFrame, number: int) -> None:
        check(batch)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).trigger(availableNow=True).option(
        "checkpointLocation", f"{path}-{label}-checkpoint").start()


def require_conserved_batch(batch: DataFrame) -> None:
    """Every request has exactly one of the known outcomes."""
    row = batch.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("outcome").isin("completed", "rejected", "unfinished")).alias("known"),
    ).first()
    if row["n"] != row["known"]:
        raise CheckFailed("Requests do not reconcile in a batch")
