"""Registered queries that run as streams over the event table until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrosift.plans.common import big, r4, table
from metrosift.plans.fleet import CAPPED
from metrosift.session import scratch_path
from metrosift.streaming import events as stream, keyed

CUTOFF = "2024-01-20 00:00:00"


def _source(spark, folder):
    # The schema of the file is its footer; no rows are read for it.
    schema = table(spark, folder, "events").schema
    return stream.read_events(spark, folder, schema, "events.parquet")


def _hours(out):
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour_start"), "event_type", big("events").alias("events"), r4("value", 2).alias("value"))


def stream_hourly(spark, folder):
    """Hourly sums per event type, the last open hours too, as they stand at the end; state holds open hours only."""
    agg = stream.hourly(_source(spark, folder), "ts", ["event_type"], "10 minutes")
    return _hours(stream.newest(agg, "stream-hourly", ["hour", "event_type"]))


def stream_cutoff(spark, folder):
    """The same in append mode with a cut-off: only hours the watermark has closed."""
    return _hours(stream.drain(stream.hourly(_source(spark, folder), "ts", ["event_type"], "10 minutes", CUTOFF), "stream-cutoff"))


def stream_outcomes(spark, folder):
    """Rides per hour of request by what had become of them at the cut-off; events are rides as in the fleet queries."""
    kind = F.col("event_type")
    requests = _source(spark, folder).select(F.col("event_id").alias("ride_id"), F.col("ts").alias("request_ts"), (kind == "error").alias("rejected"))
    dropoffs = _source(spark, folder).where(~kind.isin("error", "view")).select(
        F.col("event_id").alias("ride_id"), F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value")) * 600_000_000).alias("dropoff_ts"))
    out = stream.drain(keyed.ride_outcomes(requests, dropoffs, CUTOFF, "1 day"), "stream-outcomes")
    counts = {o: F.count_if(F.col("outcome") == o).alias(o) for o in ("completed", "rejected", "unfinished")}
    return out.groupBy(F.date_trunc("hour", "request_ts").cast("timestamp_ntz").alias("hour_start")).agg(
        F.count(F.lit(1)).alias("requests"), *counts.values(), F.max("dropoff_ts").cast("timestamp_ntz").alias("last_dropoff"))


def stream_segments(spark, folder):
    """Every event that another of its user follows, however late, with the time between."""
    out = stream.newest(keyed.segments_so_far(_source(spark, folder)), "stream-segments", ["user_id", "event_id", "start"])
    return out.select("user_id", "event_id", F.col("event_type").alias("state"), F.col("start").cast("timestamp_ntz").alias("start_ts"),
                      F.col("end").cast("timestamp_ntz").alias("end_ts"))


def stream_conserved(spark, folder):
    """Outcomes checked batch by batch before they are stored."""
    kind = F.col("event_type")
    rides = _source(spark, folder).select("event_id", F.when(kind == "error", "rejected").when(kind == "view", "unfinished").otherwise("completed").alias("outcome"))
    path = scratch_path(spark, "stream-conserved")
    stream.checked_batches(rides, stream.require_conserved_batch, path).awaitTermination()
    return spark.read.parquet(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("rides"))


def stream_attempts(spark, folder):
    """At most three accepted events of a user in six hours, judged in event time."""
    return stream.drain(keyed.capped_attempts(_source(spark, folder), 21600, 3), "stream-attempts")


QUERIES = {f.__name__: f for f in (stream_hourly, stream_cutoff, stream_outcomes, stream_segments, stream_conserved, stream_attempts)}

_HOURLY = "SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS events, round(sum(value), 2) + 0.0 AS value FROM events"
# The watermark, in milliseconds, trails the newest event by ten minutes; what it has passed is closed.
_WATERMARK = "SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events"
_CLOSED = f"time_bucket(INTERVAL 10 MINUTE, {{}}) + INTERVAL 10 MINUTE <= ({_WATERMARK})"
ORACLES = {
    "stream_hourly": f"{_HOURLY} GROUP BY 1, 2",
    "stream_cutoff": f"""{_HOURLY} WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR
        <= ({_WATERMARK} WHERE ts < TIMESTAMP '{CUTOFF}')""",
    "stream_outcomes": f"""WITH r AS (SELECT ts, event_type, ts + INTERVAL 10 MINUTE * CAST(floor(value) AS INTEGER) AS d FROM events WHERE ts < TIMESTAMP '{CUTOFF}'),
        o AS (SELECT *, event_type NOT IN ('error', 'view') AND d < TIMESTAMP '{CUTOFF}' AND d <= ts + INTERVAL 1 DAY AS done FROM r)
        SELECT date_trunc('hour', ts) AS hour_start, count(*) AS requests, count(*) FILTER (done) AS completed, count(*) FILTER (event_type = 'error') AS rejected,
        count(*) FILTER (event_type <> 'error' AND NOT done) AS unfinished, max(d) FILTER (done) AS last_dropoff FROM o GROUP BY 1""",
    "stream_segments": """SELECT user_id, event_id, event_type AS state, ts AS start_ts, nxt AS end_ts FROM
        (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) nxt FROM events) WHERE nxt IS NOT NULL""",
    "stream_attempts": f"SELECT user_id, event_id, accepted FROM ({CAPPED}) WHERE {_CLOSED.format('ts')}",
    "stream_conserved": """SELECT CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'unfinished' ELSE 'completed' END AS outcome, count(*) AS rides FROM events GROUP BY 1""",
}
