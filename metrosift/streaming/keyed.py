"""Per-vehicle rules on event time, on Spark's own keyed state.

Events of a vehicle may come late and out of order. They wait in state; when the watermark
has passed the end of an event's short slice of event time, no event before it can come any
more and a timer decides all such events in order. So results do not depend on how events
were dealt into batches. Beside the waiting events a vehicle keeps only what later
decisions need, all in one value that is read and written once a call, and a vehicle that
has been idle long enough is forgotten.

Memory is one vehicle's waiting events; state is what the watermark's delay and a batch
hold, on disk under the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLICE_SECONDS = 600
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Keeps events waiting and hands those of closed slices, sorted, to ``decide``.

    An eager processor tells of all waiting events with every batch instead, as they stand
    so far; its timers only thin the state.
    """

    #: (schema of what is carried from decision to decision, its value at the start)
    carried, start, eager = "", (), False

    def __init__(self, slice_seconds: int, forget_seconds: int | None) -> None:
        self.slice = slice_seconds * 1000
        self.forget = None if forget_seconds is None else forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # when the next timer goes off, the newest event decided, the waiting events, and what the rule carries
        self.kept = handle.getValueState(
            "kept", "armed long, last long, at array<long>, id array<long>, kind array<string>, " + self.carried)

    def _kept(self) -> tuple:
        return tuple(self.kept.get()) if self.kept.exists() else (None, None, [], [], [], *self.start)

    def _frame(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series(c, dtype=k) for (n, k), c in zip(self.columns.items(), zip(*found))})

    def _closes(self, at: int) -> int:
        return at // 1000 // self.slice * self.slice + self.slice

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        armed, last, at, number, kind, *state = self._kept()
        waiting = [list(at), list(number), list(kind)]
        known = len(waiting[0])
        for part in rows:
            named = part["named"].tolist()
            waiting[0] += part["at"].tolist()
            waiting[1] += [n if ok else None for n, ok in zip(part["id"].tolist(), named)]
            waiting[2] += part["kind"].tolist()
        first = self._closes(min(waiting[0][known:]))
        if armed is None or first < armed:
            self.handle.registerTimer(first)
            armed = first
        self.kept.update((armed, last, *waiting, *state))
        if self.eager:
            found, _ = self.decide(key[0], sorted(zip(*waiting), key=_in_time), state)
            if found:
                yield self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        armed, last, at, number, kind, *state = self._kept()
        if armed is None:
            if last is not None and self.forget is not None and last + self.forget < now:
                self.kept.clear()
            return
        closed, waiting = [], []
        for event in zip(at, number, kind):
            (closed if self._closes(event[0]) <= now else waiting).append(event)
        if not closed:
            return
        closed.sort(key=_in_time)
        found, state = self.decide(key[0], closed, state)
        last = closed[-1][0] // 1000
        armed = self._closes(min(e[0] for e in waiting)) if waiting else None
        if armed is not None or self.forget is not None:
            self.handle.registerTimer(last + self.forget + 1 if armed is None else armed)
        self.kept.update((armed, last, *([e[i] for e in waiting] for i in range(3)), *state))
        if found and not self.eager:
            yield self._frame(found)

    def close(self) -> None:
        pass


def _in_time(event: tuple) -> tuple:
    """By time and id, events without an id last."""
    return event[0], event[1] is None, event[1] or 0


class _Segments(_InOrder):
    carried, start = "last_at long, last_id long, last_kind string", (None, None, None)
    columns = {"user_id": "Int64", "event_id": "Int64", "event_type": "object", "start": "int64", "end": "int64"}

    def decide(self, key, events, state):
        found, (at, number, kind) = [], state
        for event in events:
            if at is not None and (self.forget is None or event[0] - at <= self.forget * 1000):
                found.append((key, number, kind, at, event[0]))
            at, number, kind = event
        return found, [at, number, kind]


class _SegmentsSoFar(_Segments):
    eager = True


class _Capped(_InOrder):
    carried, start = "recent array<long>", ([],)
    columns = {"user_id": "Int64", "event_id": "Int64", "accepted": "bool"}

    def __init__(self, slice_seconds: int, seconds: int, cap: int) -> None:
        super().__init__(slice_seconds, seconds)
        self.window, self.cap = seconds * 1_000_000, cap

    def decide(self, key, events, state):
        found, recent = [], list(state[0])
        for at, number, _ in events:
            recent = [x for x in recent if x > at - self.window]
            ok = len(recent) < self.cap
            if ok:
                recent.append(at)
            found.append((key, number, ok))
        return found, [recent]


def _run(events: DataFrame, delay: str, processor: StatefulProcessor, schema: str, mode: str = "Append") -> DataFrame:
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)  # keyed state with timers needs it
    # An id that is null would make doubles of its neighbours on the way to Python.
    rows = events.where("ts IS NOT NULL").withWatermark("ts", delay).select(
        "user_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("id"),
        F.col("event_id").isNotNull().alias("named"), F.col("event_type").alias("kind"))
    return rows.groupBy("user_id").transformWithStateInPandas(processor, schema, mode, "EventTime")


def _segments(events: DataFrame, delay: str, processor: StatefulProcessor, mode: str) -> DataFrame:
    found = _run(events, delay, processor, "user_id long, event_id long, event_type string, start long, end long", mode)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("start", "end")})


def closed_segments(events: DataFrame, delay: str = "10 minutes", idle_seconds: int = 30 * 86_400,
                    slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Segments (user_id, event_id, event_type, start, end) closed by the vehicle's next event, as a stream.

    ``events``: user_id, ts, event_id, event_type. A segment comes out once the watermark
    has passed its end's slice, exactly once. Events later than the watermark are dropped
    by Spark; a vehicle idle for more than ``idle_seconds`` starts anew, so longer segments
    do not exist.
    """
    return _segments(events, delay, _Segments(slice_seconds, idle_seconds), "Append")


def segments_so_far(events: DataFrame, delay: str = "10 minutes", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """All segments of the events that have come, as a stream of updates; drain with ``events.newest``.

    A segment the watermark has not passed may get an earlier end with a later batch, which
    then tells of it again; what ``newest`` keeps is the segments of all events, the last
    ones too, however long. Every vehicle keeps its last event. Events without a time, and
    those later than the watermark, have no segments.
    """
    return _segments(events, delay, _SegmentsSoFar(slice_seconds, None), "Update")


def capped_attempts(events: DataFrame, seconds: int = 60, cap: int = 10, delay: str = "10 minutes",
                    slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(user_id, event_id, accepted) as a stream: fewer than ``cap`` accepted in the trailing window.

    Attempts are judged in event time, whatever order they come in, so the cap is never
    passed. State: attempts the watermark has not passed and at most ``cap`` times, which
    are forgotten with the window.
    """
    return _run(events, delay, _Capped(slice_seconds, seconds, cap), "user_id long, event_id long, accepted boolean")


def ride_outcomes(requests: DataFrame, dropoffs: DataFrame, cutoff: str, longest: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """(ride_id, request_ts, dropoff_ts, outcome) as a stream, for requests before the cut-off.

    ``requests``: ride_id, request_ts, rejected. ``dropoffs``: ride_id, dropoff_ts. A ride is
    completed if its dropoff comes before the cut-off and within ``longest``; a request
    that is still open when both watermarks have passed that time is unfinished. Events after
    the cut-off count for nothing but the watermarks, which they move on.
    """
    end = F.lit(cutoff).cast("timestamp")
    asked = requests.withWatermark("request_ts", delay).where(F.col("request_ts") < end)
    done = dropoffs.withWatermark("dropoff_ts", delay).where(F.col("dropoff_ts") < end).withColumnRenamed("ride_id", "_done")
    met = (F.col("ride_id") == F.col("_done")) & (F.col("dropoff_ts") >= F.col("request_ts")) & (
        F.col("dropoff_ts") <= F.col("request_ts") + F.expr(f"INTERVAL {longest}"))
    joined = asked.join(done, met & ~F.col("rejected"), "leftOuter")
    return joined.select("ride_id", "request_ts", "dropoff_ts", F.when(F.col("rejected"), "rejected").when(
        F.col("_done").isNotNull(), "completed").otherwise("unfinished").alias("outcome"))
