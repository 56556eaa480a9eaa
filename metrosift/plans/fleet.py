"""Registered queries of the fleet-log accounting.

Stand-ins: a vehicle is a user and its state an event type; rides are events or orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from metrosift.operators import fleet
from metrosift.operators.attempts import accept_capped
from metrosift.operators.spatial import hash_uniform
from metrosift.plans.common import big, point_x, point_y, r4, sql_x, sql_y, table

def _events(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _days(events):
    """(start of the first day in seconds, number of days) of the events: two extremes from the files' statistics."""
    ends = events.agg(*[F.unix_timestamp(F.date_trunc("day", f("ts"))).alias(n) for n, f in (("a", F.min), ("b", F.max))]).first()
    return (0, 0) if ends["a"] is None else (ends["a"], (ends["b"] - ends["a"]) // 86_400 + 1)


def _minute(ts, first):
    """Whole seconds since the start of the first day, as minutes."""
    return (F.unix_timestamp(ts) - first) / 60.0


def state_segments(spark, folder):
    out = fleet.segments_from_events(_events(spark, folder), "user_id", "ts", "event_id", "event_type")
    return out.select("user_id", "event_id", F.col("event_type").alias("state"),
                      F.col("start").cast("timestamp_ntz").alias("start_ts"), F.col("end").cast("timestamp_ntz").alias("end_ts"))


def _minute_segments(spark, folder):
    """Closed segments on a minute axis, with positions of their two events."""
    events = _events(spark, folder)
    first, _ = _days(events)
    segments = fleet.segments_from_events(events, "user_id", "ts", "event_id", "event_type").where("end IS NOT NULL")
    k = F.col("event_id")
    return segments.select(
        "user_id", k.alias("segment_id"), F.col("event_type").alias("state"), _minute(F.col("start"), first).alias("start_minute"),
        _minute(F.col("end"), first).alias("end_minute"), point_x(k).alias("from_x"), point_y(k).alias("from_y"),
        point_x(k + 1).alias("to_x"), point_y(k + 1).alias("to_y"))


def state_time_by_hour(spark, folder):
    out = fleet.split_by_hour(_minute_segments(spark, folder), "start_minute", "end_minute", ["state"], "minutes")
    return out.select("state", "hour", r4("minutes").alias("minutes"))


def segment_clip(spark, folder):
    out = fleet.clip_segments(_minute_segments(spark, folder), 28800.0)
    return out.select("user_id", "segment_id", *[r4(c).alias(c) for c in ("start_minute", "end_minute", "from_x", "from_y", "to_x", "to_y")])


def segment_continuity(spark, folder):
    """Every 97th segment is cut short first, so there are breaks to count."""
    s = _minute_segments(spark, folder).withColumn(
        "end_minute", F.when(F.col("segment_id") % 97 == 0, F.col("end_minute") - 0.5).otherwise(F.col("end_minute")))
    out = fleet.continuity_breaks(s, "user_id", "start_minute", "end_minute", "segment_id")
    return out.select("user_id", "segments", "breaks", r4("first_start").alias("first_start"), r4("last_end").alias("last_end"))


def peak_concurrency(spark, folder):
    """Events hold a charger for as many minutes as their value."""
    e = _events(spark, folder)
    start = F.unix_micros("ts")
    rows = e.select(start.alias("s"), (start + F.round(F.col("value") * 100).cast("long") * 600_000).alias("e"))
    return fleet.concurrency_peak(rows, "s", "e").select(big("peak").alias("peak"))


def _rides(spark, folder):
    """Events as rides: errors are rejected, views are unfinished, others completed."""
    e = _events(spark, folder)
    kind, asked = F.col("event_type"), _minute(F.col("ts"), _days(e)[0])
    done = ~kind.isin("error", "view")
    return e.select(
        "event_id", asked.alias("request_minute"), F.when(done, asked + F.floor("value")).alias("dropoff_minute"),
        (kind == "error").alias("rejected"), F.floor(F.col("value") % 17).cast("double").alias("wait"),
        F.round(F.col("value") * 100).cast("long").alias("cents"))


def hourly_metrics(spark, folder):
    out = fleet.hourly_metrics(_rides(spark, folder), _days(_events(spark, folder))[1] * 24)
    return out.select("hour", *[big(c).alias(c) for c in ("requests", "completed_rides", "rejected_requests", "cents")],
                      r4("average_wait_minutes").alias("average_wait_minutes"))


def cumulative_revenue(spark, folder):
    hourly = fleet.hourly_metrics(_rides(spark, folder), _days(_events(spark, folder))[1] * 24).select("hour", "cents")
    return fleet.cumulative_by_hour(hourly, "cents", "total").select("hour", big("total").alias("cumulative_cents"))


def _order_rides(spark, folder):
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, folder, "orders").select(
        k.alias("request_id"), F.element_at(F.create_map(*[F.lit(x) for x in ("F", "completed", "O", "rejected", "P", "unfinished")]), F.col("o_orderstatus")).alias("outcome"),
        ((cents % 1500) / 100.0).alias("wait"), cents.alias("cents"), (cents % 997 / 10.0).alias("paid_miles"),
        (cents % 331 / 10.0).alias("empty_miles"), (cents % 23).cast("double").alias("charge_minutes"), (cents % 7).cast("double").alias("queue_minutes"), (cents % 61).cast("double").alias("service_minutes"), (cents % 41).cast("double").alias("passenger_minutes"))


def fleet_totals(spark, folder):
    fleet_size = table(spark, folder, "customer").count()
    _, days = _days(table(spark, folder, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts")))
    out = fleet.require_conserved(fleet.fleet_totals(_order_rides(spark, folder), fleet_size, days * 1440.0))
    whole = ["total_requests", "rides_completed", "rejected_requests", "unfinished_requests", "revenue_cents"]
    return out.select(*[big(c).alias(c) for c in whole], *[r4(c).alias(c) for c in out.columns if c not in whole])


def wait_p95(spark, folder):
    done = _order_rides(spark, folder).where("outcome = 'completed'")
    return fleet.wait_percentile(done).select(r4("p95_wait_minutes").alias("p95_wait_minutes"))


def fare_cents(spark, folder):
    miles, minutes = F.col("l_quantity"), F.col("l_discount") * 100 + F.col("l_tax") * 100
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        fleet.fare_cents(miles, minutes, "2.50", "1.255", "0.305").alias("cents"))


def _lookups(spark, folder):
    """Every vehicle at noon of every day."""
    users = table(spark, folder, "events").select("user_id").distinct()
    _, days = _days(_events(spark, folder))
    return users.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(max(days, 1) - 1)))).select(
        "user_id", (F.col("user_id") * 100_000 + F.col("day")).alias("lookup_id"), (F.col("day") * 1440.0 + 720).alias("minute"))


def _as_of(spark, folder):
    return fleet.as_of(_lookups(spark, folder), _minute_segments(spark, folder), "user_id")


def vehicle_as_of(spark, folder):
    out = _as_of(spark, folder).withColumn("p", fleet.position_on_segment(F.col("minute")))
    return out.select("user_id", "lookup_id", r4("minute").alias("minute"), "segment_id", "state",
                      r4("p.x").alias("x"), r4("p.y").alias("y"), r4("p.angle").alias("angle"))


def state_histogram(spark, folder):
    out = _as_of(spark, folder).groupBy("minute", "state").agg(F.count(F.lit(1)).alias("vehicles"))
    return out.select(r4("minute").alias("minute"), F.coalesce("state", F.lit("none")).alias("state"), "vehicles")


def nearest_feasible(spark, folder):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    requests = table(spark, folder, "orders").select(
        k.alias("request_id"), point_x(k).alias("ox"), point_y(k).alias("oy"), point_x(k + 3).alias("dx"), point_y(k + 3).alias("dy"))
    vehicles = table(spark, folder, "supplier").select(
        s.alias("vehicle_id"), point_x(s).alias("x"), point_y(s).alias("y"),
        F.when(s % 5 == 0, "CHARGING").otherwise("IDLE").alias("state"), (120.0 + F.pmod(s * 37, F.lit(200))).alias("range_miles"))
    return fleet.nearest_feasible(requests, vehicles).select("request_id", "vehicle_id", r4("pickup_miles").alias("pickup_miles"))


def attempt_cap(spark, folder):
    out = fleet.attempts_in_window(_events(spark, folder), "user_id", "ts", "event_id", 21600)
    return out.select("user_id", "event_id", big("in_window").alias("in_window"))


def attempt_cap_exact(spark, folder):
    """At most three accepted events per user in any trailing six hours."""
    rows = _events(spark, folder).select("user_id", "ts", "event_id")
    return accept_capped(rows, "user_id", "ts", "event_id", 21600, 3).select("user_id", "event_id", "accepted")


def scenario_compare(spark, folder):
    """Each day as a scenario beside the day before."""
    runs = _events(spark, folder).groupBy(F.dayofyear("ts").cast("long").alias("scenario")).agg(
        F.count(F.lit(1)).alias("rides"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return fleet.compare_scenarios(runs, "scenario", ["rides", "cents"])


def ride_matching_draws(spark, folder):
    """Uniform draws per order; the same on every engine because they come from a hash."""
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(k.alias("request_id"), r4(hash_uniform(F.lit("draw"), k), 6).alias("u"))


QUERIES = {f.__name__: f for f in (
    state_segments, state_time_by_hour, segment_clip, segment_continuity, peak_concurrency, hourly_metrics, cumulative_revenue,
    fleet_totals, wait_p95, fare_cents, vehicle_as_of, state_histogram, nearest_feasible, attempt_cap, attempt_cap_exact,
    scenario_compare, ride_matching_draws,
)}

_SEC = "CAST(floor(epoch({})) AS BIGINT) - (SELECT CAST(epoch(date_trunc('day', min(ts))) AS BIGINT) FROM events)"
_DAYS = "(SELECT date_diff('day', date_trunc('day', min(ts)), date_trunc('day', max(ts))) + 1 FROM events)"
_ORDER_DAYS = "(SELECT date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 FROM orders)"
#: Attempts in order, each with the accepted times before it: three at most in any six hours.
CAPPED = """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events),
    r AS (SELECT user_id, event_id, ts, n, true AS accepted, [ts] AS held FROM o WHERE n = 1
    UNION ALL SELECT user_id, event_id, ts, n, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, ts) ELSE live END
    FROM (SELECT o.*, list_filter(r.held, lambda h: h > o.ts - INTERVAL 6 HOUR) AS live FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))
    SELECT user_id, event_id, ts, accepted FROM r"""
_SEGMENTS = f"""WITH lagged AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) nxt FROM events),
    seg AS (SELECT user_id, event_id segment_id, event_type state, ({_SEC.format('ts')}) / 60.0::DOUBLE s, ({_SEC.format('nxt')}) / 60.0::DOUBLE e,
    CAST({sql_x('event_id')} AS DOUBLE) fx, CAST({sql_y('event_id')} AS DOUBLE) fy, CAST({sql_x('event_id + 1')} AS DOUBLE) tx, CAST({sql_y('event_id + 1')} AS DOUBLE) ty
    FROM lagged WHERE nxt IS NOT NULL)"""
_RIDES = f"""WITH rides AS (SELECT ({_SEC.format('ts')}) / 60.0::DOUBLE asked, CASE WHEN event_type NOT IN ('error', 'view') THEN ({_SEC.format('ts')}) / 60.0::DOUBLE + floor(value) END done,
    event_type = 'error' rejected, floor(value % 17) wait, CAST(round(value * 100) AS BIGINT) cents FROM events),
    a AS (SELECT CAST(floor(asked / 60) AS BIGINT) h, count(*) requests, count(*) FILTER (rejected) rejected FROM rides GROUP BY 1),
    b AS (SELECT CAST(floor(done / 60) AS BIGINT) h, count(*) completed, sum(cents) cents, avg(wait) wait FROM rides WHERE done < {_DAYS} * 1440 GROUP BY 1),
    hourly AS (SELECT r.h AS hour, coalesce(requests, 0) requests, coalesce(completed, 0) completed, coalesce(rejected, 0) rejected, CAST(coalesce(cents, 0) AS BIGINT) cents, wait
    FROM (SELECT unnest(range({_DAYS} * 24)) h) r LEFT JOIN a USING (h) LEFT JOIN b USING (h))"""
_LOOKUPS = f""", looks AS (SELECT user_id, user_id * 100000 + d lookup_id, d * 1440.0::DOUBLE + 720 AS "minute" FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT unnest(range({_DAYS})) d) r),
    hit AS (SELECT l.*, g.* EXCLUDE (user_id) FROM looks l LEFT JOIN seg g ON g.user_id = l.user_id AND g.s <= l."minute"
    QUALIFY row_number() OVER (PARTITION BY lookup_id ORDER BY s DESC NULLS LAST, segment_id DESC) = 1),
    seen AS (SELECT user_id, lookup_id, "minute", s, e, fx, fy, tx, ty, CASE WHEN "minute" <= e THEN segment_id END segment_id, CASE WHEN "minute" <= e THEN state END state FROM hit)"""
_ORDERS = """WITH c AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) cents FROM orders)"""

ORACLES = {
    "state_segments": "SELECT user_id, event_id, event_type AS state, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts FROM events",
    "state_time_by_hour": f"""{_SEGMENTS}, parts AS (SELECT state, s, e, unnest(range(CAST(floor(s / 60) AS BIGINT), CAST(greatest(ceil(e / 60), floor(s / 60) + 1) AS BIGINT))) h FROM seg WHERE e > s)
        SELECT state, h AS hour, round(sum(least(e, (h + 1) * 60) - greatest(s, h * 60)), 4) + 0.0 AS minutes FROM parts GROUP BY 1, 2""",
    "segment_clip": f"""{_SEGMENTS}, cut AS (SELECT *, least(e, 28800) stop, least(1, (least(e, 28800) - s) / (e - s)) f FROM seg WHERE least(e, 28800) > s)
        SELECT user_id, segment_id, round(s, 4) + 0.0 AS start_minute, round(stop, 4) + 0.0 AS end_minute, round(fx, 4) + 0.0 AS from_x, round(fy, 4) + 0.0 AS from_y,
        round(fx + (tx - fx) * f, 4) + 0.0 AS to_x, round(fy + (ty - fy) * f, 4) + 0.0 AS to_y FROM cut""",
    "segment_continuity": f"""{_SEGMENTS}, cut AS (SELECT *, CASE WHEN segment_id % 97 = 0 THEN e - 0.5 ELSE e END e2 FROM seg),
        l AS (SELECT *, lag(e2) OVER (PARTITION BY user_id ORDER BY s, segment_id) p FROM cut)
        SELECT user_id, count(*) AS segments, count(*) FILTER (p <> s) AS breaks, round(min(s), 4) + 0.0 AS first_start, round(max(e2), 4) + 0.0 AS last_end FROM l GROUP BY 1""",
    "peak_concurrency": """WITH m AS (SELECT epoch_us(ts) t, 1 c FROM events UNION ALL SELECT epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000, -1 FROM events),
        s AS (SELECT t, sum(c) c FROM m GROUP BY 1) SELECT CAST(max(o) AS BIGINT) AS peak FROM (SELECT sum(c) OVER (ORDER BY t) o FROM s)""",
    "hourly_metrics": f"""{_RIDES} SELECT hour, requests, completed AS completed_rides, rejected AS rejected_requests, cents, round(wait, 4) + 0.0 AS average_wait_minutes FROM hourly""",
    "cumulative_revenue": f"{_RIDES} SELECT hour, CAST(sum(cents) OVER (ORDER BY hour) AS BIGINT) AS cumulative_cents FROM hourly",
    "fleet_totals": f"""{_ORDERS}, t AS (SELECT count(*) n, count(*) FILTER (o_orderstatus = 'F') f, count(*) FILTER (o_orderstatus = 'O') o,
        avg(cents % 1500 / 100.0::DOUBLE) FILTER (o_orderstatus = 'F') w, sum(cents) FILTER (o_orderstatus = 'F') c, sum(cents % 997 / 10.0::DOUBLE) p, sum(cents % 331 / 10.0::DOUBLE) e,
        sum(cents % 61) s, sum(cents % 41) pm, sum(cents % 23) ch, sum(cents % 7) qu, (SELECT count(*) FROM customer) k FROM c)
        SELECT n AS total_requests, f AS rides_completed, o AS rejected_requests, n - f - o AS unfinished_requests, CAST(c AS BIGINT) AS revenue_cents, round(w, 4) + 0.0 AS average_wait_minutes,
        round(least(100, s / CAST(k * {_ORDER_DAYS} * 1440 AS DOUBLE) * 100), 4) + 0.0 AS utilization_pct, round(least(100, pm / CAST(k * {_ORDER_DAYS} * 1440 AS DOUBLE) * 100), 4) + 0.0 AS passenger_utilization_pct,
        round(p, 4) + 0.0 AS paid_miles, round(e, 4) + 0.0 AS empty_miles, round(e / (p + e) * 100, 4) + 0.0 AS empty_mile_pct,
        round(CAST(ch AS DOUBLE) / 60, 4) + 0.0 AS charging_vehicle_hours, round(CAST(qu AS DOUBLE) / 60, 4) + 0.0 AS charging_queue_vehicle_hours,
        round(CAST(c AS DOUBLE) / 100 / k, 4) + 0.0 AS revenue_per_vehicle_usd, round(CAST(f AS DOUBLE) / k, 4) + 0.0 AS rides_per_vehicle FROM t""",
    "wait_p95": f"{_ORDERS} SELECT round(quantile_cont(CAST(cents % 1500 / 100.0 AS DOUBLE), 0.95), 4) + 0.0 AS p95_wait_minutes FROM c WHERE o_orderstatus = 'F'",
    "fare_cents": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round((2.50::DECIMAL(12,6) + 1.255::DECIMAL(12,6) * CAST(l_quantity AS DECIMAL(18,8))
        + 0.305::DECIMAL(12,6) * CAST(l_discount * 100 + l_tax * 100 AS DECIMAL(18,8))) * 100, 0) AS BIGINT) AS cents FROM lineitem""",
    "vehicle_as_of": f"""{_SEGMENTS} {_LOOKUPS}, placed AS (SELECT *, CASE WHEN segment_id IS NOT NULL THEN greatest(0, least(1, ("minute" - s) / (e - s))) END f FROM seen)
        SELECT user_id, lookup_id, round("minute", 4) + 0.0 AS "minute", segment_id, state, round(fx + f * (tx - fx), 4) + 0.0 AS x, round(fy + f * (ty - fy), 4) + 0.0 AS y,
        CASE WHEN f IS NOT NULL THEN round(atan2(ty - fy, tx - fx), 4) + 0.0 END AS angle FROM placed""",
    "state_histogram": f"""{_SEGMENTS} {_LOOKUPS} SELECT round("minute", 4) + 0.0 AS "minute", coalesce(state, 'none') AS state, count(*) AS vehicles FROM seen GROUP BY 1, 2""",
    "nearest_feasible": f"""WITH r AS (SELECT o_orderkey request_id, CAST({sql_x('o_orderkey')} AS DOUBLE) ox, CAST({sql_y('o_orderkey')} AS DOUBLE) oy, CAST({sql_x('o_orderkey + 3')} AS DOUBLE) dx, CAST({sql_y('o_orderkey + 3')} AS DOUBLE) dy FROM orders),
        v AS (SELECT s_suppkey vehicle_id, CAST({sql_x('s_suppkey')} AS DOUBLE) x, CAST({sql_y('s_suppkey')} AS DOUBLE) y, 120.0::DOUBLE + (s_suppkey * 37) % 200 rng FROM supplier WHERE s_suppkey % 5 <> 0),
        p AS (SELECT *, 1.3 * sqrt(pow(x - ox, 2) + pow(y - oy, 2)) pick FROM r JOIN v ON abs(x - ox) < 4 AND abs(y - oy) < 4),
        b AS (SELECT * FROM p WHERE pick / 20 * 60 <= 15 AND rng + 1e-9 >= pick + 1.3 * sqrt(pow(dx - ox, 2) + pow(dy - oy, 2)) + 1.3 * sqrt(dx * dx + dy * dy) + 25
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY pick, vehicle_id) = 1)
        SELECT r.request_id, vehicle_id, round(pick, 4) + 0.0 AS pickup_miles FROM r LEFT JOIN b USING (request_id)""",
    "attempt_cap": """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""",
    "attempt_cap_exact": f"SELECT user_id, event_id, accepted FROM ({CAPPED})",
    "scenario_compare": """WITH d AS (SELECT CAST(dayofyear(ts) AS BIGINT) scenario, count(*) rides, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) cents FROM events GROUP BY 1)
        SELECT scenario, rides, cents, lag(rides) OVER w AS previous_rides, lag(cents) OVER w AS previous_cents, rides - lag(rides) OVER w AS change_rides,
        cents - lag(cents) OVER w AS change_cents FROM d WINDOW w AS (ORDER BY scenario)""",
    "ride_matching_draws": """SELECT o_orderkey AS request_id, round(CAST(('0x' || substring(md5('draw:' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE, 6) + 0.0 AS u FROM orders""",
}
