"""Order-dependent operators on several slices, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrosift.operators import fleet
from metrosift.operators.attempts import accept_capped
from metrosift.operators.ordered import add_neighbor, add_position, add_running_total, carry_last, exact_percentiles, lay_out


@pytest.fixture
def skewed(many_slices):
    rng = random.Random(5)
    data = [(0 if rng.random() < 0.7 else rng.randrange(1, 40), rng.randrange(5000), i, rng.randrange(1, 9)) for i in range(3000)]
    return many_slices.createDataFrame(data, "k long, t long, id long, v long").cache(), sorted(data)


def order():
    return [F.col("k"), F.col("t"), F.col("id")]


def test_layout_uses_several_slices(skewed):
    df, _ = skewed
    laid = lay_out(df, order())
    assert laid.select("_slice").distinct().count() > 3
    # The hot key is spread out.
    assert laid.where("k = 0").select("_slice").distinct().count() > 2


def test_position_and_running_total(skewed):
    df, data = skewed
    got = {r["id"]: r["rank"] for r in add_position(df, order()).collect()}
    assert got == {row[2]: i for i, row in enumerate(data, 1)}
    sums = {r["id"]: r["running"] for r in add_running_total(df, order(), "v").collect()}
    assert sums == {row[2]: int(s) for row, s in zip(data, np.cumsum([r[3] for r in data]))}


@pytest.mark.parametrize("step", [1, -1])
def test_neighbor(skewed, step):
    df, data = skewed
    got = {r["id"]: r["n"] for r in add_neighbor(df, order(), ["k", "id"], "n", step).collect()}
    for i, row in enumerate(data):
        j = i + step
        want = (data[j][0], data[j][2]) if 0 <= j < len(data) else None
        assert (tuple(got[row[2]]) if got[row[2]] else None) == want


def test_carry_last(skewed):
    df, data = skewed
    df = df.withColumn("x", F.when(F.col("v") == 8, F.col("id")))
    got = {r["id"]: r["last"] for r in carry_last(df, order(), "x", "last").collect()}
    last = None
    for row in data:
        last = row[2] if row[3] == 8 else last
        assert got[row[2]] == last


def test_percentiles_match_numpy(many_slices):
    rng = random.Random(1)
    values = [7.5] * 900 + [round(rng.uniform(0, 50), 3) for _ in range(1500)]
    df = many_slices.createDataFrame([(v,) for v in values], "w double")
    row = exact_percentiles(df, "w", [0.0, 0.5, 0.95, 1.0]).first()
    assert list(row) == pytest.approx(list(np.quantile(values, [0, 0.5, 0.95, 1])), abs=1e-12)
    small = many_slices.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "w double")
    assert exact_percentiles(small, "w", [0.95]).first()[0] == pytest.approx(8.95)
    assert exact_percentiles(small.limit(0), "w", [0.95]).first()[0] is None


def brute_cap(data, seconds, cap):
    out, recent = {}, {}
    for k, t, i in sorted(data):
        live = [x for x in recent.get(k, []) if x > t - seconds]
        out[i] = len(live) < cap
        recent[k] = live + [t] if out[i] else live
    return out


@pytest.mark.parametrize("gap", [3, 40])
def test_exact_cap_equals_brute_force(many_slices, gap):
    rng = random.Random(gap)
    data, t = [], 0
    for i in range(1500):
        t += rng.randrange(gap)
        data.append((0 if i % 3 else i % 7, t, i))
    df = many_slices.createDataFrame(data, "k long, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["accepted"] for r in accept_capped(df, "k", "ts", "id", 60, 10).collect()}
    assert got == brute_cap(data, 60, 10)


def test_window_count_equals_brute_force(many_slices):
    rng = random.Random(9)
    data = [(0 if rng.random() < 0.6 else rng.randrange(5), t, i) for i, t in enumerate(rng.sample(range(9000), 900))]
    df = many_slices.createDataFrame(data, "k long, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["in_window"] for r in fleet.attempts_in_window(df, "k", "ts", "id", 60).collect()}
    assert got == {i: sum(1 for a, b, _ in data if a == k and t - 60 < b <= t) for k, t, i in data}


def test_as_of_takes_last_open_segment(many_slices):
    segments = many_slices.createDataFrame(
        [(1, 10, 0.0, 5.0, "A"), (1, 11, 5.0, 9.0, "B"), (2, 12, 3.0, 4.0, "C")],
        "k long, segment_id long, start_minute double, end_minute double, state string")
    lookups = many_slices.createDataFrame([(1, 1, 5.0), (1, 2, 9.5), (2, 3, 2.0), (2, 4, 4.0), (3, 5, 1.0)], "k long, lookup_id long, minute double")
    got = {r["lookup_id"]: r["state"] for r in fleet.as_of(lookups, segments, "k").collect()}
    assert got == {1: "B", 2: None, 3: None, 4: "C", 5: None}


def test_peak_frees_before_it_takes(many_slices):
    df = many_slices.createDataFrame([(0, 10), (5, 8), (8, 12), (10, 11)], "s long, e long")
    assert fleet.concurrency_peak(df, "s", "e").first()[0] == 2
    assert fleet.concurrency_peak(df.limit(0), "s", "e").first()[0] == 0


def test_scratch_folder(spark, monkeypatch):
    """The named folder is used; without one only a local master gets a folder of its own."""
    from metrosift import session

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.scratch_root(spark) == named.rstrip("/")

    class Context:
        applicationId, master = "app-x", "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Bare:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Bare)
    Context.master = "local[2]"
    assert session.scratch_root(Bare) == session.scratch_root(Bare)
