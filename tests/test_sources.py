"""Readers, writers and streams on small files."""

import gzip
import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from metrosift.operators.checks import CheckFailed
from metrosift.sources import readers, writers
from metrosift.streaming import events as stream, keyed


def test_json_matrix(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["NAME", "POP", "code"], ["X", "1000", "12345"], ["Y", None, "5"]]))
    (tmp_path / "b.json").write_text(json.dumps([["code", "NAME"]]))
    got = readers.json_matrix(spark, str(tmp_path), ["code", "POP", "absent"])
    assert rows(got.fillna("-"), "code", "POP", "absent") == [("12345", "1000", "-"), ("5", "-", "-")]
    assert got.select("file_path").distinct().count() == 1
    for i, bad in enumerate(("[]", "{}", "oops")):
        path = tmp_path / f"bad{i}.txt"
        path.write_text(bad)
        with pytest.raises(Exception, match="Empty or invalid"):
            readers.json_matrix(spark, str(path), ["x"]).collect()


def test_delimited(spark, tmp_path):
    path = tmp_path / "t.dat"
    path.write_bytes(b"\xef\xbb\xbfGEO_ID|B1|B2\n 310M700US00001 |5|7\n")
    assert rows(readers.pipe_table(spark, str(path), ["B2"])) == [("310M700US00001", "7")]
    with pytest.raises(CheckFailed, match="lacks columns"):
        readers.pipe_table(spark, str(path), ["B9"])
    with gzip.open(tmp_path / "od.csv.gz", "wt") as f:
        f.write("w_geocode,h_geocode,S000,extra\n010010201001000,010010201001001,3,z\n")
    assert rows(readers.flows(spark, str(tmp_path / "od.csv.gz"))) == [("010010201001000", "010010201001001", 3)]
    (tmp_path / "crash.csv").write_text("id,LATITUDE,LONGITUD\n1,10.5,20.5\n2,999,20\n3,,5\n")
    assert rows(readers.located_rows(readers.crashes(spark, str(tmp_path / "crash.csv"))), "id", "lat", "lon") == [("1", 10.5, 20.5)]
    with pytest.raises(CheckFailed, match="latitude"):
        readers.located_rows(spark.range(1))


def test_transit_and_required_columns(spark, tmp_path):
    for name in ("stops", "routes"):
        (tmp_path / f"{name}.txt").write_text("id,x\n01,2\n")
    feed = readers.transit_feed(spark, str(tmp_path), ["stops", "routes"])
    assert rows(feed["stops"]) == [("01", "2")]
    union = readers.union_feeds({"a": feed["stops"], "b": feed["routes"].drop("x")})
    assert rows(union.fillna("-")) == [("01", "-", "b"), ("01", "2", "a")]
    with pytest.raises(CheckFailed, match="routes"):
        readers.transit_feed(spark, str(tmp_path), ["stops"])
    tracks = spark.createDataFrame([("s", 1)], "scenario_id string, track_id long")
    tracks.write.parquet(str(tmp_path / "tracks"))
    with pytest.raises(CheckFailed, match="motion tracks"):
        readers.motion_tracks(spark, str(tmp_path / "tracks"))


def test_station_documents(spark, tmp_path):
    doc = {"fuel_stations": [{"id": 1, "status_code": "E", "ev_dc_fast_num": [2, "x", 1]}, {"id": 2, "ev_dc_fast_num": 4}, {"id": 3}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    got = {r["id"]: r["ev_dc_fast_num"] for r in readers.charging_stations(spark, str(tmp_path / "s.json")).collect()}
    assert got == {1: ["2", "x", "1"], 2: ["4"], 3: None}
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="fuel_stations"):
        readers.charging_stations(spark, str(tmp_path / "bad.json")).collect()
    pages = tmp_path / "pages"
    pages.mkdir()
    for i, sid in enumerate(("USC001", "US1X", "USW002")):
        (pages / f"p{i}.json").write_text(json.dumps({"features": [{"attributes": {"STATION_ID": sid, "LATITUDE": "10", "LONGITUDE": "20"}}, {"attributes": {"STATION_ID": "USC9", "LATITUDE": "x", "LONGITUDE": "1"}}]}))
    inventory = readers.station_inventory(spark, str(pages))
    assert rows(inventory, "station_id", "lat") == [("USC001", 10.0), ("USW002", 10.0)]
    assert inventory.select("page").distinct().count() == 2


def test_geojson_zones(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [{"properties": {"TAZ": t, "Prod": p}, "geometry": {"type": "Polygon", "coordinates": square}} for t, p in (("10", 2.0), ("9", 3.0))]}
    (tmp_path / "z.json").write_text(json.dumps(doc))
    zones = readers.geojson(spark, str(tmp_path / "z.json"), "TAZ string, Prod double")
    assert [r["TAZ"] for r in readers.demand_zones(zones, "TAZ", ["Prod"], 2).collect()] == ["9", "10"]
    assert zones.select(F.size(F.col("shape")[0][0])).first()[0] == 4
    with pytest.raises(CheckFailed, match="Expected 3"):
        readers.demand_zones(zones, "TAZ", ["Prod"], 3)
    with pytest.raises(CheckFailed, match="Invalid"):
        readers.demand_zones(zones.withColumn("Prod", F.lit(0.0)), "TAZ", ["Prod"])
    (tmp_path / "n.json").write_text(json.dumps({"type": "Feature"}))
    with pytest.raises(Exception, match="FeatureCollection"):
        readers.geojson(spark, str(tmp_path / "n.json"), "TAZ string").collect()
    layer = zones.withColumn("feet", F.lit("10")).withColumn("status", F.when(F.col("TAZ") == "9", "Demolished"))
    assert rows(readers.clean_layer(layer, "feet", "status"), "TAZ", "height_m") == [("10", 3.05)]


def test_geojson_of_many_parts_and_holes(spark, tmp_path):
    """Every part and hole arrives; a null geometry stays null; other types stop the job."""
    def write(name, *geometries):
        features = [{"properties": {"k": i}, "geometry": g} for i, g in enumerate(geometries)]
        (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        return str(tmp_path / name)

    def square(a, b):
        return [[a, a], [b, a], [b, b], [a, b], [a, a]]

    one = {"type": "Polygon", "coordinates": [square(0, 9), square(1, 2), square(4, 5)]}
    many = {"type": "MultiPolygon", "coordinates": [[square(0, 9), square(1, 2)], [square(20, 21)]]}
    path = write("p.json", one, many, None, {"type": "MultiPolygon", "coordinates": []})
    found = {r["k"]: r["shape"] for r in readers.geojson(spark, path, "k int").collect()}
    assert [[len(ring) for ring in part] for part in found[0]] == [[4, 4, 4]]
    assert [[len(ring) for ring in part] for part in found[1]] == [[4, 4], [4]]
    assert found[1][1][0][2].asDict() == {"x": 21.0, "y": 21.0}
    assert found[2] is None and found[3] == []
    line = {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}
    lines = {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]]}
    found = readers.geojson(spark, write("l.json", line, lines), "k int", "line").orderBy("k").collect()
    assert [[len(part) for part in r["lines"]] for r in found] == [[2], [2, 3]]
    point = readers.geojson(spark, write("q.json", {"type": "Point", "coordinates": [3, 4]}), "k int", "point").first()
    assert point["coordinates"] == [3.0, 4.0]
    for kind, other in (("polygon", line), ("line", one), ("point", lines), ("polygon", {"type": "GeometryCollection", "geometries": []})):
        with pytest.raises(Exception, match=f"Not a {kind}"):
            readers.geojson(spark, write("x.json", one if kind == "polygon" else other, other), "k int", kind).collect()


def test_releases_and_reuse(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([("1", "d", "ranking.v2", "verified")], "schema_version string, data_version string, model_version string, data_mode string").write.parquet(f"{path}/versions")
    spark.createDataFrame([("a", "op", True)], "id string, operator string, enabled boolean").write.parquet(f"{path}/references")
    assert readers.reference_release(spark, path, "op").count() == 1
    with pytest.raises(CheckFailed, match="mock"):
        readers.release(spark, path, "mock")
    with pytest.raises(CheckFailed, match="enabled"):
        readers.reference_release(spark, path, "other")
    keys = spark.createDataFrame([("x",), ("y",)], "k string")
    stored = str(tmp_path / "i")
    assert readers.reuse_if_complete(spark, stored, "k", keys) is None
    writers.write_intermediate(keys.withColumn("part", F.lit(1)), stored, ["part"])
    assert readers.reuse_if_complete(spark, stored, "k", keys).count() == 2
    assert readers.reuse_if_complete(spark, stored, "k", keys.limit(1)) is None


def test_newest_complete_file(spark):
    data = [("old", 1, "x"), ("old", 1, "y"), ("mid", 2, "x"), ("mid", 2, "y"), ("mid", 2, "z"), ("new", 3, "x")]
    files = spark.createDataFrame(data, "file string, stamp long, k string")
    need = spark.createDataFrame([("x",), ("y",)], "k string")
    assert rows(readers.newest_complete_file(files, need, "k", "file", "stamp")) == [("mid", 2)]


def test_manifest_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.bin").write_bytes(b"hello")
    got = readers.file_manifest(spark, str(tmp_path)).first()
    assert (got["bytes"], got["sha256"]) == (5, hashlib.sha256(b"hello").hexdigest())
    (tmp_path / "p.html").write_text("<b>x</b>\n<i>y</i>")
    assert readers.html_pages(spark, str(tmp_path / "p.html")).first()["html"] == "<b>x</b>\n<i>y</i>"


def test_writers(spark, tmp_path):
    features = spark.createDataFrame([("e1", "a", 1.0, "u", "derived", None, ["p", "q"]), ("e1", "b", None, "u", "missing", "r", []), ("e2", "a", 3.0, "u", "proxy", None, ["p"])],
                                     "entity_id string, key string, value double, unit string, quality string, missing_reason string, provenance_ids array<string>")
    assert rows(writers.wide_values(features, ["a"]), "entity_id", "a_value", "a_quality") == [("e1", 1.0, "derived"), ("e2", 3.0, "proxy")]
    writers.write_entities(features, str(tmp_path / "docs"))
    back = {r["entity_id"]: json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "docs")).collect()}
    assert list(back["e1"]["features"]) == ["a", "b"] and back["e1"]["features"]["a"]["value"] == 1.0
    entities = spark.createDataFrame([("e1", [("p", ["x", "y"])])], "entity_id string, provenance array<struct<id: string, assumptions: array<string>>>")
    writers.export_tables(features, entities, ["a", "b"], str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out" / "provenance"), header=True).first()["assumptions"] == "x; y"


def write_batches(spark, path, batches):
    start = datetime(2024, 1, 1)
    for i, batch in enumerate(batches):
        data = [(i * 100 + j, start + timedelta(seconds=s), u, e, 1.0) for j, (s, u, e) in enumerate(batch)]
        spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
BATCHES = [[(0, 1, "a"), (9, 1, "b"), (5, 2, "c")], [(20, 1, "c"), (30, 2, "a"), (25, 1, "a")], [(70, 2, "b"), (71, 3, "a"), (90, 1, "b")]]


def one_file_at_a_time(spark, path):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def keyed_rows(spark, tmp_path, batches, job, *columns):
    """Rows of a keyed job over one file a batch. A last far event of another user moves the watermark past everything."""
    path = str(tmp_path / f"in{len(list(tmp_path.iterdir()))}")
    write_batches(spark, path, [*batches, [(90_000, 99, "end")]])
    return rows(stream.drain(job(one_file_at_a_time(spark, path)), "keyed"), *columns)


def seconds(ts):
    return int((ts - datetime(2024, 1, 1)).total_seconds())


def segments_of(spark, tmp_path, batches, **how):
    found = keyed_rows(spark, tmp_path, batches, lambda e: keyed.closed_segments(e, **how), "user_id", "event_type", "start", "end")
    return sorted(((u, e, seconds(a), seconds(b)) for u, e, a, b in found), key=lambda r: (r[0], r[2], r[3], r[1]))


def by_order(batches):
    events = sorted((u, s, i * 100 + j, e) for i, batch in enumerate(batches) for j, (s, u, e) in enumerate(batch))
    return sorted(((a[0], a[3], a[1], b[1]) for a, b in zip(events, events[1:]) if a[0] == b[0]), key=lambda r: (r[0], r[2], r[3], r[1]))


def test_segments_across_micro_batches(spark, tmp_path):
    assert segments_of(spark, tmp_path, BATCHES) == by_order(BATCHES)


def test_late_events_never_make_segments_overlap(spark, tmp_path):
    """Events in any order within the delay give the segments of the sorted log."""
    rng = random.Random(6)
    events = sorted((rng.randrange(0, 7200), rng.randrange(1, 5), rng.choice("abc")) for _ in range(160))
    late = sorted(events, key=lambda e: e[0] + rng.randrange(0, 500))
    batches = [late[i:i + 20] for i in range(0, len(late), 20)]
    found = segments_of(spark, tmp_path, batches, slice_seconds=60)
    assert [(u, a, b) for u, _, a, b in found] == [(u, a, b) for u, _, a, b in by_order(batches)]
    for (u, _, _, end), (v, _, start, _) in zip(found, found[1:]):
        assert u != v or end <= start
    one = segments_of(spark, tmp_path, [late], slice_seconds=600)
    assert [(u, a, b) for u, _, a, b in one] == [(u, a, b) for u, _, a, b in found]


def test_idle_vehicles_are_forgotten(spark, tmp_path):
    batches = [[(0, 1, "a"), (60, 1, "b")], [(7000, 2, "x")], [(14_000, 2, "y")], [(20_000, 1, "c"), (20_030, 1, "d")]]
    found = segments_of(spark, tmp_path, batches, idle_seconds=3600)
    assert found == [(1, "a", 0, 60), (1, "c", 20_000, 20_030)]


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    batches = [[(0, 1, "a")], [(9000, 1, "b")], [(9001, 2, "z")], [(100, 1, "late"), (9500, 1, "c")]]
    assert segments_of(spark, tmp_path, batches) == [(1, "a", 0, 9000), (1, "b", 9000, 9500)]


def capped(events, seconds, cap):
    held, out = {}, {}
    for u, s, number in sorted(events):
        recent = held[u] = [x for x in held.get(u, []) if x > s - seconds]
        out[number] = len(recent) < cap
        if out[number]:
            recent.append(s)
    return out


def test_cap_holds_whatever_order_attempts_come_in(spark, tmp_path):
    rng = random.Random(9)
    events = sorted((rng.randrange(0, 3000), rng.randrange(1, 4), "a") for _ in range(200))
    late = sorted(events, key=lambda e: e[0] + rng.randrange(0, 550))
    for batches in ([late[i:i + 25] for i in range(0, len(late), 25)], BATCHES):
        want = capped([(u, s, i * 100 + j) for i, b in enumerate(batches) for j, (s, u, _) in enumerate(b)], 60, 2)
        found = keyed_rows(spark, tmp_path, batches, lambda e: keyed.capped_attempts(e, 60, 2), "event_id", "accepted")
        assert dict(found) == want


def test_open_requests_end_unfinished(spark, tmp_path):
    """Dropoffs come in other batches than requests, one after the cut-off, one too late, one never."""
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    asked = [[(1, at(0), False), (2, at(10), True), (3, at(20), False)], [(4, at(3000), False), (5, at(3500), False)], [(6, at(90_000), False)], [(7, at(200_000), False)]]
    done = [[(9, at(5))], [(1, at(600))], [(3, at(4000)), (4, at(3800)), (2, at(700))], [(5, at(1200)), (7, at(200_100))]]
    for name, batches, schema in (("asked", asked, "ride_id long, request_ts timestamp, rejected boolean"), ("done", done, "ride_id long, dropoff_ts timestamp")):
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = stream.drain(keyed.ride_outcomes(read("asked", "ride_id long, request_ts timestamp, rejected boolean"), read("done", "ride_id long, dropoff_ts timestamp"),
                                           "2024-01-01 01:05:00", "50 minutes", "30 minutes"), "outcomes")
    assert dict(rows(out, "ride_id", "outcome")) == {1: "completed", 2: "rejected", 3: "unfinished", 4: "completed", 5: "unfinished"}


def test_failing_batch_stops_the_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    write_batches(spark, path, BATCHES)
    rides = one_file_at_a_time(spark, path).select(F.when(F.col("event_type") == "b", "lost").otherwise("completed").alias("outcome"))
    query = stream.checked_batches(rides, stream.require_conserved_batch, str(tmp_path / "out"))
    with pytest.raises(Exception, match="reconcile"):
        query.awaitTermination()


def test_late_rows_are_dropped(spark, tmp_path):
    """The watermark is past the first hour, one batch later it counts, then a row for that hour comes."""
    path = str(tmp_path / "in")
    write_batches(spark, path, [[(60, 1, "a"), (120, 1, "a")], [(9000, 1, "a")], [(9030, 1, "a")], [(180, 1, "a"), (9060, 1, "a")], [(30000, 1, "a")]])
    agg = stream.hourly(one_file_at_a_time(spark, path), "ts", ["event_type"], "10 minutes", "2024-01-01 08:00:00")
    got = [(h.hour, n) for h, n in rows(stream.drain(agg, "late"), "hour", "events")]
    assert got[0] == (0, 2)  # the late row is not counted
    assert all(h < 8 for h, _ in got)  # rows at or after the cut-off never count


@pytest.mark.parametrize("names", [("LATITUDE_1", "LONGITUDE_1"), ("lat", "long"), ("Latitude", "LONGITUD")])
def test_published_coordinate_names(spark, names):
    table = spark.createDataFrame([("1.5", "2.5")], list(names))
    assert [(r.lat, r.lon) for r in readers.located_rows(table).select(
        F.col("lat").cast("double").alias("lat"), "lon").collect()] == [(1.5, 2.5)]
