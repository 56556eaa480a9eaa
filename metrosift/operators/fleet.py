"""Fleet-log accounting: segments, totals, hourly roll-ups, playback and matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrosift.operators.checks import require_none
from metrosift.operators.ordered import add_neighbor, add_running_total, carry_last, exact_percentiles
from metrosift.operators.spatial import box_join, in_cells, is_large, least_in_cells

# The default operating assumptions.
AVERAGE_SPEED_MPH = 20.0
ROAD_DISTANCE_MULTIPLIER = 1.3
MAX_PICKUP_WAIT_MINUTES = 15.0
BATTERY_RANGE_MILES = 250.0
RESERVE_FRACTION = 0.1
CHARGE_TRIGGER_FRACTION = 0.2
CHARGE_TARGET_FRACTION = 0.8
VEHICLE_STATES = (
    "IDLE", "PICKUP_TRAVEL", "PICKUP_DWELL", "PASSENGER_TRAVEL", "DROPOFF_DWELL",
    "DEPOT_TRAVEL", "CHARGING_QUEUE", "CHARGING",
)
OCCUPIED_STATES = ("PASSENGER_TRAVEL", "DROPOFF_DWELL")


def fare_cents(miles: Column, minutes: Column, base: str, per_mile: str, per_minute: str) -> Column:
    """Fare in whole cents, rounded half up, in decimal arithmetic throughout."""
    money = "decimal(12,6)"
    quantity = "decimal(18,8)"
    fare = (
        F.lit(base).cast(money)
        + F.lit(per_mile).cast(money) * miles.cast(quantity)
        + F.lit(per_minute).cast(money) * minutes.cast(quantity)
    )
    return F.round(fare * 100, 0).cast("long")


def network_miles(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1) * ROAD_DISTANCE_MULTIPLIER


def travel_minutes(miles: Column) -> Column:
    return miles / AVERAGE_SPEED_MPH * 60


def clip_segments(segments: DataFrame, horizon: float) -> DataFrame:
    """Cut segments at the horizon; the end point moves back in proportion."""
    stop = F.least(F.col("end_minute"), F.lit(float(horizon)))
    kept = segments.where(stop > F.col("start_minute")).withColumn("_stop", stop)
    part = F.least(F.lit(1.0), (F.col("_stop") - F.col("start_minute"))
                   / (F.col("end_minute") - F.col("start_minute")))
    return (
        kept.withColumn("_part", part)
        .withColumns({f"to_{a}": F.expr(f"from_{a} + (to_{a} - from_{a}) * _part") for a in ("x", "y")})
        .withColumn("end_minute", F.col("_stop")).drop("_stop", "_part")
    )


def position_on_segment(minute: Column) -> Column:
    """Struct(x, y, angle) at a minute, for rows with the segment columns."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (minute - F.col("start_minute"))
                      / (F.col("end_minute") - F.col("start_minute"))))
    dx, dy = F.col("to_x") - F.col("from_x"), F.col("to_y") - F.col("from_y")
    return F.struct(
        (F.col("from_x") + part * dx).alias("x"), (F.col("from_y") + part * dy).alias("y"),
        F.atan2(dy, dx).alias("angle"),
    )


def segments_from_events(
    events: DataFrame, key: str, time: str, tie: str, state: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Each event starts a segment that the key's next event ends; a key's last one is open.

    The next event comes from range-partitioned neighbors, so a key of any size is
    spread over tasks.
    """
    order = [F.col(key), F.col(time), F.col(tie)]
    near = add_neighbor(events.select(key, time, tie, state, *keep), order, [key, time], "_next")
    return near.select(
        key, state, *keep, F.col(time).alias("start"), F.col(tie),
        F.when(F.col(f"_next.{key}") == F.col(key), F.col(f"_next.{time}")).alias("end"),
    )


def continuity_breaks(segments: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Per key: number of segments, of gaps or overlaps between neighbors, first and last."""
    order = [F.col(key), F.col(start), F.col(tie)]
    near = add_neighbor(segments.select(key, start, end, tie), order, [key, end], "_before", step=-1)
    broken = (F.col(f"_before.{key}") == F.col(key)) & (F.col(f"_before.{end}") != F.col(start))
    return near.groupBy(key).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(broken).alias("breaks"),
        F.min(start).alias("first_start"), F.max(end).alias("last_end"),
    )


def split_by_hour(segments: DataFrame, start: str, end: str, by: Sequence[str], name: str) -> DataFrame:
    """Minutes of the segments in each hour bucket of a minute axis.

    A segment spans few hours, so it explodes into few rows, which are summed on the
    map side.
    """
    last = F.greatest(F.ceil(F.col(end) / 60) - 1, F.floor(F.col(start) / 60)).cast("long")
    hours = segments.where(F.col(end) > F.col(start)).withColumn(
        "hour", F.explode(F.sequence(F.floor(F.col(start) / 60).cast("long"), last))
    )
    overlap = F.least(F.col(end), (F.col("hour") + 1) * 60) - F.greatest(F.col(start), F.col("hour") * 60)
    return hours.groupBy(*by, "hour").agg(F.sum(overlap).alias(name))


def hour_spine(spark, hours: int) -> DataFrame:
    return spark.range(hours).select(F.col("id").alias("hour"))


def hourly_metrics(rides: DataFrame, hours: int) -> DataFrame:
    """One row per hour on two clocks: requests by request time, the rest by dropoff time.

    ``rides``: request_minute, dropoff_minute (null unless completed), rejected, wait,
    cents. Both roll-ups are one aggregate over exploded clock entries.
    """
    horizon = hours * 60
    done = F.col("dropoff_minute").isNotNull() & (F.col("dropoff_minute") < horizon)
    entry = F.array_compact(F.array(
        F.when(F.col("request_minute") < horizon, F.struct(
            F.floor(F.col("request_minute") / 60).cast("long").alias("hour"), F.lit(1).alias("req"),
            F.col("rejected").cast("int").alias("rej"), F.lit(0).alias("fin"))),
        F.when(done, F.struct(
            F.floor(F.col("dropoff_minute") / 60).cast("long").alias("hour"), F.lit(0).alias("req"),
            F.lit(0).alias("rej"), F.lit(1).alias("fin"))),
    ))
    clock = rides.select(F.explode(entry).alias("e"), "cents", "wait").select("e.*", "cents", "wait")
    sums = clock.groupBy("hour").agg(
        F.sum("req").alias("requests"), F.sum("fin").alias("completed_rides"),
        F.sum("rej").alias("rejected_requests"),
        F.sum(F.when(F.col("fin") == 1, F.col("cents")).otherwise(0)).alias("cents"),
        F.avg(F.when(F.col("fin") == 1, F.col("wait"))).alias("average_wait_minutes"),
    )
    spine = hour_spine(rides.sparkSession, hours)
    zero = ["requests", "completed_rides", "rejected_requests", "cents"]
    # Both sides have one row per hour of the horizon.
    return spine.join(sums, "hour", "left").fillna(0, zero)


def fleet_totals(rides: DataFrame, fleet_size: Column | int, horizon: float) -> DataFrame:
    """One row of totals. ``rides``: outcome, wait, cents, paid_miles, empty_miles,
    service_minutes, passenger_minutes, charge_minutes, queue_minutes.

    Without the last two columns the hours of charging and of waiting for a charger are
    missing, not zero.
    """
    unknown = [c for c in ("charge_minutes", "queue_minutes") if c not in rides.columns]
    rides = rides.withColumns({c: F.lit(None).cast("double") for c in unknown})
    size = fleet_size if isinstance(fleet_size, Column) else F.lit(fleet_size)
    done = F.col("outcome") == "completed"
    sums = rides.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(done).alias("rides_completed"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected_requests"),
        F.avg(F.when(done, F.col("wait"))).alias("average_wait_minutes"),
        F.sum(F.when(done, F.col("cents")).otherwise(0)).alias("revenue_cents"),
        *[F.sum(c).alias(c) for c in (
            "paid_miles", "empty_miles", "service_minutes", "passenger_minutes", "charge_minutes", "queue_minutes")],
        size.alias("_fleet"),
    )
    miles = F.col("paid_miles") + F.col("empty_miles")
    capacity = F.col("_fleet") * float(horizon)
    return sums.select(
        "total_requests", "rides_completed", "rejected_requests",
        (F.col("total_requests") - F.col("rides_completed") - F.col("rejected_requests"))
        .alias("unfinished_requests"),
        "average_wait_minutes",
        F.least(F.lit(100.0), F.col("service_minutes") / capacity * 100).alias("utilization_pct"),
        F.least(F.lit(100.0), F.col("passenger_minutes") / capacity * 100).alias("passenger_utilization_pct"),
        "paid_miles", "empty_miles",
        (F.col("empty_miles") / F.nullif(miles, F.lit(0.0)) * 100).alias("empty_mile_pct"),
        (F.col("charge_minutes") / 60).alias("charging_vehicle_hours"),
        (F.col("queue_minutes") / 60).alias("charging_queue_vehicle_hours"),
        "revenue_cents",
        (F.col("revenue_cents") / 100 / F.col("_fleet")).alias("revenue_per_vehicle_usd"),
        (F.col("rides_completed") / F.col("_fleet")).alias("rides_per_vehicle"),
    )


def wait_percentile(rides: DataFrame, wait: str = "wait", q: float = 0.95) -> DataFrame:
    return exact_percentiles(rides, wait, [q]).withColumnRenamed("p0", "p95_wait_minutes")


def cumulative_by_hour(hourly: DataFrame, value: str, name: str) -> DataFrame:
    """Running total over hours; input has one row per hour."""
    return add_running_total(hourly, [F.col("hour")], value, name)


def concurrency_peak(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Largest number of intervals open at once; an end frees its place before a start
    at the same instant. Changes are summed per instant before the sorted sweep."""
    marks = intervals.select(F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("change")),
        F.struct(F.col(end).alias("at"), F.lit(-1).alias("change")),
    )).alias("m")).where("m.at IS NOT NULL").select("m.*")
    steps = marks.groupBy("at").agg(F.sum("change").cast("long").alias("change"))
    swept = add_running_total(steps, [F.col("at")], "change", "open")
    top = swept.agg(F.max(F.struct("open", -F.unix_micros(F.col("at").cast("timestamp")))).alias("m")) \
        if dict(intervals.dtypes)[start].startswith("timestamp") else \
        swept.agg(F.max(F.struct("open", -F.col("at"))).alias("m"))
    return top.select(F.coalesce(F.col("m.open"), F.lit(0)).alias("peak"))


def as_of(lookups: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """State of each key at each lookup minute: the last segment with start <= minute
    that is still open (minute <= end), or null.

    ``lookups``: key, lookup_id, minute. ``segments``: key, segment_id, start_minute,
    end_minute, more columns. Both are merged in one sorted pass, with no range join.
    """
    cols = [c for c in segments.columns if c not in (key,)]
    row = F.struct(key, *cols)
    a = segments.select(key, F.col("start_minute").alias("_at"), F.lit(0).alias("_kind"),
                        F.col("segment_id").cast("long").alias("_id"), row.alias("_seg"))
    b = lookups.select(key, F.col("minute").alias("_at"), F.lit(1).alias("_kind"),
                       F.col("lookup_id").cast("long").alias("_id"))
    merged = carry_last(a.unionByName(b, allowMissingColumns=True),
                        [F.col(key), F.col("_at"), F.col("_kind"), F.col("_id")], "_seg", "_last")
    hit = (F.col(f"_last.{key}") == F.col(key)) & (F.col("_at") <= F.col("_last.end_minute"))
    return merged.where("_kind = 1").select(
        key, F.col("_id").alias("lookup_id"), F.col("_at").alias("minute"),
        *[F.when(hit, F.col(f"_last.{c}")).alias(c) for c in cols],
    )


def _feasible(reach: float):
    def measure(request, vehicle):
        d = np.hypot(vehicle["x"] - request["ox"], vehicle["y"] - request["oy"])
        trip = np.hypot(request["ox"] - request["dx"], request["oy"] - request["dy"]) + np.hypot(request["dx"], request["dy"])
        spare = vehicle["range_miles"] - ROAD_DISTANCE_MULTIPLIER * (d + trip) - RESERVE_FRACTION * BATTERY_RANGE_MILES
        slack = 1e-8 * (1 + np.abs(vehicle["range_miles"]) + d + trip)
        return d, (d <= reach - slack) & (spare >= slack), (d <= reach + slack) & (spare >= -slack)

    return measure


def nearest_feasible(
    requests: DataFrame, vehicles: DataFrame, max_wait: float = MAX_PICKUP_WAIT_MINUTES
) -> DataFrame:
    """Best idle vehicle of each request in a snapshot: in reach within ``max_wait``,
    with range for pickup, trip, way to the depot and reserve; nearest, then lowest id.

    ``requests``: request_id, ox, oy, dx, dy. ``vehicles``: vehicle_id, x, y, state,
    range_miles. Depot at the origin.
    """
    reach = max_wait / 60 * AVERAGE_SPEED_MPH / ROAD_DISTANCE_MULTIPLIER
    boxes = requests.select(
        "*", *[F.expr(f"o{a} {s} {reach!r}D").alias(f"{a}{i}") for a in ("x", "y") for i, s in ((0, "-"), (1, "+"))],
    )
    idle = vehicles.where("state = 'IDLE'")
    pickup = network_miles(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))
    trip = network_miles(F.col("ox"), F.col("oy"), F.col("dx"), F.col("dy"))
    back = network_miles(F.col("dx"), F.col("dy"), F.lit(0.0), F.lit(0.0))
    if is_large(requests):
        # of vehicles alike at one spot only the lowest id can be chosen
        spots = idle.where("x IS NOT NULL AND y IS NOT NULL AND range_miles IS NOT NULL").groupBy("x", "y", "range_miles").agg(
            F.min_by("vehicle_id", F.struct("vehicle_id")).alias("vehicle_id"))
        asked = requests.select("request_id", "ox", "oy", "dx", "dy").where("ox IS NOT NULL AND oy IS NOT NULL AND dx IS NOT NULL AND dy IS NOT NULL")
        pairs = least_in_cells(in_cells(asked, "ox", "oy", reach * 1.001), in_cells(spots, "x", "y", reach * 1.001, around=True), _feasible(reach))
    else:
        pairs = box_join(idle, boxes, "vehicle_id")
    pairs = pairs.withColumn("pickup_miles", pickup).where(
        (travel_minutes(F.col("pickup_miles")) <= max_wait)
        & (F.col("range_miles") + 1e-9
           >= F.col("pickup_miles") + trip + back + RESERVE_FRACTION * BATTERY_RANGE_MILES)
    )
    best = pairs.groupBy("request_id").agg(F.min(F.struct("pickup_miles", "vehicle_id")).alias("m"))
    return requests.select("request_id").join(best, "request_id", "left").select(
        "request_id", "m.vehicle_id", "m.pickup_miles"
    )


def attempts_in_window(attempts: DataFrame, key: str, time: str, tie: str, seconds: int) -> DataFrame:
    """Attempts of the same key in (t - seconds, t], this one included.

    Every attempt adds one at its time and takes one away ``seconds`` later; the running
    sum in (key, time) order is the count, and each key's changes cancel before the next
    key starts. A departure at the instant of an arrival comes first.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))
    marks = attempts.select(key, tie, t.alias("_t")).select(
        key, tie,
        F.explode(F.array(
            F.struct(F.col("_t").alias("at"), F.lit(1).alias("change")),
            F.struct((F.col("_t") + seconds * 1_000_000).alias("at"), F.lit(-1).alias("change")),
        )).alias("m"),
    ).select(key, tie, "m.*")
    swept = add_running_total(marks, [F.col(key), F.col("at"), F.col("change"), F.col(tie)],
                              "change", "in_window")
    return swept.where("change = 1").select(
        key, tie, F.timestamp_micros("at").alias(time), F.col("in_window").cast("long").alias("in_window")
    )


def require_conserved(totals: DataFrame) -> DataFrame:
    """Requests must equal completed + rejected + unfinished."""
    off = totals.where(
        "total_requests <> rides_completed + rejected_requests + unfinished_requests "
        "OR unfinished_requests < 0"
    )
    require_none(off, "Requests do not reconcile")
    return totals


def compare_scenarios(runs: DataFrame, sequence: str, metrics: Sequence[str]) -> DataFrame:
    """Each scenario beside the one before it: previous value and change per metric."""
    near = add_neighbor(runs, [F.col(sequence)], list(metrics), "_before", step=-1)
    return near.select(
        *runs.columns,
        *[F.col(f"_before.{m}").alias(f"previous_{m}") for m in metrics],
        *[(F.col(m) - F.col(f"_before.{m}")).alias(f"change_{m}") for m in metrics],
    )


def playback_order(segments: DataFrame) -> DataFrame:
    """Segments grouped by vehicle in time order, ready to be read back in that order.

    Ranges of (vehicle, start) keep a busy vehicle from filling one partition.
    """
    order = ["vehicle_id", "start_minute", "end_minute"]
    return segments.repartitionByRange(*order).sortWithinPartitions(*order)
