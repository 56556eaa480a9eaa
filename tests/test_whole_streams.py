"""Stream queries keep what the watermark has not closed when the input ends."""

from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from metrosift.streaming import events as stream, keyed

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def write(spark, path, data, mode="overwrite"):
    found = [(i, None if s is None else START + timedelta(seconds=s), u, e, 1.0) for i, s, u, e in data]
    spark.createDataFrame(found, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def folder_of(spark, tmp_path, data):
    write(spark, str(tmp_path / "part"), data)
    (found,) = (tmp_path / "part").glob("*.parquet")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").write_bytes(found.read_bytes())
    return str(tmp_path / "in")


DAY = 86_400
ROWS = [(1, 0, 1, "a"), (2, 50, 1, "b"), (3, 40 * DAY, 1, "c"), (4, 40 * DAY + 5, 2, "a"), (5, 40 * DAY + 5, 2, "b"), (None, 40 * DAY + 9, 2, "c"),
        (7, None, 1, "a"), (2**60 + 1, 40 * DAY + 8, 2, None)]


def test_segments_of_long_gaps_and_of_the_last_minutes(spark, tmp_path):
    out = entry_point.queries()["stream_segments"](spark, folder_of(spark, tmp_path, ROWS))
    found = sorted((r["user_id"], r["event_id"], r["state"], (r["start_ts"] - START).total_seconds(), (r["end_ts"] - START).total_seconds()) for r in out.collect())
    assert found == [(1, 1, "a", 0, 50), (1, 2, "b", 50, 40 * DAY), (2, 4, "a", 40 * DAY + 5, 40 * DAY + 5),
                     (2, 5, "b", 40 * DAY + 5, 40 * DAY + 8), (2, 2**60 + 1, None, 40 * DAY + 8, 40 * DAY + 9)]


def test_open_hours_are_told(spark, tmp_path):
    out = entry_point.queries()["stream_hourly"](spark, folder_of(spark, tmp_path, ROWS))
    assert rows(out.where("event_type IS NOT NULL").select(((F.unix_timestamp(F.col("hour_start").cast("timestamp")) - 1704067200) / 3600).cast("long"), "event_type", "events")) == [
        (0, "a", 1), (0, "b", 1), (960, "a", 1), (960, "b", 1), (960, "c", 2)]


def test_a_later_batch_corrects_what_was_told(spark, tmp_path):
    """An event between two known ones, in a batch of its own, cuts their segment in two; equal rows are all kept."""
    path = str(tmp_path / "in")
    for batch in ([(1, 0, 1, "a"), (2, 100, 1, "b"), (2, 100, 1, "b")], [(3, 60, 1, "c")], [(4, 5000, 1, "d")], [(5, 5001, 2, "a")], [(6, 9000, 2, "b")]):
        write(spark, path, batch, "append")
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.newest(keyed.segments_so_far(raw), "far", ["user_id", "event_id", "start"])
    at = lambda ts: int((ts - START).total_seconds())
    assert sorted((u, n, at(a), at(b)) for u, n, a, b in rows(out, "user_id", "event_id", "start", "end")) == [
        (1, 1, 0, 60), (1, 2, 100, 100), (1, 2, 100, 5000), (1, 3, 60, 100), (2, 5, 5001, 9000)]


def test_a_vehicle_is_decided_in_one_call():
    """A batch of many slices costs a vehicle one reading and one writing of its state, not some for each slice."""
    calls = []

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            calls.append("timer")

    class Now:
        def getCurrentWatermarkInMs(self):
            return 10**9

    import pandas as pd

    own = keyed._Capped(600, 60, 3)
    own.init(Handle())
    n = 500
    batch = pd.DataFrame({"at": [i * 700_000_000 for i in range(n)], "id": range(n), "named": True, "kind": "a"})
    assert list(own.handleInputRows((1,), iter([batch]), None)) == []
    (out,) = own.handleExpiredTimer((1,), Now(), None)
    assert len(out) == n and len(calls) < 8
