"""Hand-made rows for scalar functions and the census, road and fleet aggregates."""

import math
import random
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from metrosift.functions import geo, parsing, text
from metrosift.operators import census, fleet, graph, labels, spatial
from metrosift.operators.checks import CheckFailed


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_published_normal(spark):
    cases = [("0.0", " ", "S", 0.0), ("0", "", "P", 0.0), ("5", "M", "S", None), ("5", "X", " ", None), ("-9999", "", "S", None), ("7", "X", None, 7.0), ("x", "", "E", None)]
    df = spark.createDataFrame([c[:3] + (i,) for i, c in enumerate(cases)], "v string, m string, c string, i int")
    got = dict(rows(df.select("i", parsing.published_normal(F.col("v"), F.col("m"), F.col("c")))))
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_numbers_and_margins(spark):
    df = spark.createDataFrame([("12",), ("-5",), ("abc",), ("NaN",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in df.select(parsing.number_or_null(F.col("v"))).collect()] == [12.0, None, None, None, None, None]
    with pytest.raises(Exception, match="suppressed"):
        df.select(parsing.number_or_fail(F.col("v"), "x")).collect()
    table = spark.createDataFrame([("1", "10", "-555555555")], "code string, B01003_E001 string, B01003_M001 string")
    got = rows(census.inspect_margins(table, "code", ["B01003_E001", "B01003_M001"], ["B01003_M001"]), "column", "status", "value")
    assert got == [("B01003_E001", "reported", 10), ("B01003_M001", "controlled_total", None)]
    with pytest.raises(Exception, match="margin"):
        census.inspect_margins(table, "code", ["B01003_M001"]).collect()


def test_ids_and_prices(spark):
    r = one(spark, a=parsing.canonical_id(F.lit("12345")), b=parsing.canonical_id(F.lit("cbsa:12345")),
            c=parsing.area_code(F.lit("310M700US12060")), d=parsing.area_code(F.lit("0500000US12060")),
            e=parsing.county_code(F.lit("0500000US12060")), f=parsing.tract_code(F.lit("1400000US12060000100")),
            g=parsing.tract_key(F.lit("1"), F.lit("3"), F.lit("200")), h=parsing.at_most_two_decimals(F.lit(1.25)), i=parsing.at_most_two_decimals(F.lit(1.255)))
    assert list(r) == ["cbsa:12345", "cbsa:12345", "12060", None, "12060", "12060000100", "01003000200", True, False]
    for bad in ("1234", "cbsa:cbsa:12345", None):
        with pytest.raises(Exception, match="Invalid area code"):
            one(spark, a=parsing.canonical_id(F.lit(bad).cast("string")))


def test_distance_and_projection(spark):
    r = one(spark, km=geo.great_circle_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
            zone=geo.utm_code(F.lit(-71.4), F.lit(41.8)), south=geo.utm_code(F.lit(151.2), F.lit(-33.9)),
            p=geo.to_utm(F.lit(-71.0), F.lit(42.0), F.lit(19)), q=geo.to_utm(F.lit(-69.0), F.lit(0.0), F.lit(19)),
            edge=geo.utm_zone(F.lit(180.0)))
    assert r["km"] == pytest.approx(math.radians(1) * 6371.0088)
    assert (r["zone"], r["south"], r["edge"]) == (32619, 32756, 60)
    assert (r["q"]["x"], r["q"]["y"]) == pytest.approx((500000, 0), abs=1e-6)
    # Meridian arc and easting by direct numeric integration of the ellipsoid.
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    steps, total, top = 200000, 0.0, math.radians(42.0)
    for i in range(steps):
        u = (i + 0.5) * top / steps
        total += a * (1 - e2) / (1 - e2 * math.sin(u) ** 2) ** 1.5 * top / steps
    on_axis = one(spark, p=geo.to_utm(F.lit(-69.0), F.lit(42.0), F.lit(19)))["p"]
    assert (on_axis["x"], on_axis["y"]) == pytest.approx((500000, 0.9996 * total), abs=1e-3)
    assert r["p"]["x"] < 500000 and 300000 < r["p"]["x"]


def test_lines_and_rings(spark):
    line = ring((0, 0), (3, 4), (3, 10))
    shape = ring((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))
    points = spark.createDataFrame([(0.5, 1.5), (1.5, 1.5), (1.5, 0.5), (2.5, 0.5), (1.0, 1.5), (0.0, 0.0), (0.0, 1.0), (2.0, 0.5)], "x double, y double")
    got = [r[0] for r in points.select(geo.inside_ring(F.col("x"), F.col("y"), shape)).collect()]
    assert got == [True, False, True, False, False, False, False, False]
    r = one(spark, n=geo.polyline_length(line), a=geo.point_along(line, F.lit(0.5)), b=geo.point_along(line, F.lit(-1.0)),
            c=geo.point_along(line, F.lit(2.0)), d=geo.distance_to_ring(F.lit(0.5), F.lit(0.75), shape),
            e=geo.point_to_segment(*[F.lit(float(v)) for v in (1, 1, 0, 0, 4, 0)]))
    assert r["n"] == 11 and tuple(r["a"]) == pytest.approx((3, 4.5)) and tuple(r["b"]) == (0, 0) and tuple(r["c"]) == (3, 10)
    assert r["d"] == 0.5 and tuple(r["e"]) == (1.0, 0.25)


def test_text_functions(spark):
    page = "<h1>Serving</h1> <p>Austin, TX</p><h1>Next</h1><p>Miami,\n FL</p><h1>End</h1>Tampa, FL"
    plain = text.plain_text(F.lit(page))
    now, soon = text.section(plain, "Serving", "Next"), text.section(plain, "Next", "End")
    r = one(spark, a=text.listed_status(now, soon, F.lit("austin, tx")), b=text.listed_status(now, soon, F.lit("Miami, FL")),
            c=text.listed_status(now, soon, F.lit("Tampa, FL"), strict=False), d=text.section(plain, "Absent"))
    assert list(r) == ["commercial", "announced", None, None]
    with pytest.raises(Exception, match="ambiguous"):
        one(spark, a=text.listed_status(now, soon, F.lit("Tampa, FL")))
    fields = ["set", "2024", "abc", "metro", "county", "Mean é"]
    r = one(spark, u=text.provenance_id(*[F.lit(x) for x in fields]), q=text.query_parameter(F.lit("https://a.b/c?x=1&stations=USC1"), "stations"),
            h=text.replace_host(F.lit("https://old.x/a?b=https://old.x/"), "old.x", "new.y"), v=text.replace_suffix(F.lit("v1__FEED-1"), "__FEED-", F.lit("2")))
    assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "|".join(fields)))
    assert list(r)[1:] == ["USC1", "https://new.y/a?b=https://old.x/", "v1__FEED-2"]
    good = "A compact metro with a familiar climate."
    ids = [F.lit(x) for x in ("a", "b")]
    r = one(spark, ok=text.acceptable_wording(F.lit(good), F.array(ids[0]), F.array(*ids)), digit=text.acceptable_wording(F.lit(good + "7"), F.array(ids[0]), F.array(*ids)),
            word=text.acceptable_wording(F.lit(good + " It is SAFE."), F.array(ids[0]), F.array(*ids)), line=text.acceptable_wording(F.lit(good + "\nMore."), F.array(ids[0]), F.array(*ids)),
            cite=text.acceptable_wording(F.lit(good), F.array(F.lit("z")), F.array(*ids)), twice=text.acceptable_wording(F.lit(good), F.array(ids[0], ids[0]), F.array(*ids)))
    assert list(r) == [True, False, False, False, False, False]


def test_labels(spark):
    table = spark.createDataFrame([(1, "St. Louis, MO-IL"), (2, "Boston-Cambridge, MA-NH"), (3, "Portland, OR-WA"), (4, "Portland, ME")], "area_id long, name string")
    want = spark.createDataFrame([("a", "St Louis", "MO"), ("b", "boston", "MA"), ("c", "Portland", "ME")], "label_id string, city string, state string")
    assert rows(labels.resolve_labels(want, table)) == [("a", 1), ("b", 2), ("c", 4)]
    with pytest.raises(CheckFailed, match="uniquely"):
        labels.resolve_labels(spark.createDataFrame([("x", "Portland", "")], want.schema), table)


def test_sites_and_coverage(spark):
    base = [(1, "E", "Public", 1.0, 2.0, ["3"]), (1, "E", "public", 1.0, 2.0, ["1", "2", "x"]), (2, "E", "private", 1.0, 2.0, ["9"]), (3, "P", "public", 1.0, 2.0, ["9"]), (4, "E", "public", 1.0, 2.0, None)]
    schema = "id long, status_code string, access_code string, latitude double, longitude double, ev_dc_fast_num array<string>"
    assert rows(census.qualifying_sites(spark.createDataFrame(base, schema)), "id", "dc_fast_ports") == [(1, 3)]
    with pytest.raises(CheckFailed, match="Conflicting"):
        census.qualifying_sites(spark.createDataFrame(base + [(1, "E", "public", 1.5, 2.0, ["3"])], schema))
    areas = spark.createDataFrame([("m", "c1", 5), ("m", None, 2)], "metro string, county string, ports long")
    counties = spark.createDataFrame([("m", "c1", 60), ("m", "c2", 40), ("n", "c3", 10), ("o", "c4", None)], "metro string, county string, population long")
    people = spark.createDataFrame([("m", 100), ("n", 10), ("o", 5)], "metro string, population long")
    got = {r["metro"]: r for r in census.charging_coverage(areas, counties, people).collect()}
    assert (got["m"]["ports_per_100k"], got["m"]["population_share_with_ports"]) == pytest.approx((7000, 0.6))
    assert (got["n"]["ports"], got["n"]["population_share_with_ports"]) == (0, 0) and got["o"]["population_share_with_ports"] is None
    absent = {r["metro"]: r for r in census.charging_coverage(areas, counties, people, retrieved=False).collect()}
    assert all(r["ports"] is None and r["ports_per_100k"] is None and r["population_share_with_ports"] is None for r in absent.values())
    station = "id long, county string, fuel_type_code string, access_code string, status_code string, ev_dc_fast_num string"
    strict = spark.createDataFrame([(1, "c1", "ELEC", "public", "E", "5")], station)
    one_county = spark.createDataFrame([("m", "c1", 100000)], counties.schema)
    total = spark.createDataFrame([("m", 100000)], people.schema)
    r = census.charging_features(strict, one_county, total).first()
    assert (r["ports_per_100k"], r["population_share_with_ports"]) == pytest.approx((5, 1))
    with pytest.raises(CheckFailed, match="port count"):
        census.charging_features(strict.withColumn("ev_dc_fast_num", F.lit(None).cast("string")), one_county, total)
    with pytest.raises(CheckFailed, match="reconcile"):
        census.charging_features(strict, one_county, spark.createDataFrame([("m", 5)], people.schema))


@pytest.mark.parametrize("bad", [("12000", "", "400", "20"), ("12000", "-999999999", "400", "20"), ("12000", "400", "0", "20"), ("nan", "400", "400", "20")])
def test_strict_commute(spark, bad):
    def tables(a, b, c, d):
        return (spark.createDataFrame([(" 310M700US00001", a, b)], "GEO_ID string, B08013_E001 string, B08013_M001 string"),
                spark.createDataFrame([("310M700US00001", c, d)], "GEO_ID string, B08303_E001 string, B08303_M001 string"))

    codes = spark.createDataFrame([("00001",)], "code string")
    assert census.commute_ratio(*tables("12000", "400", "400", "20"), codes).first()["mean_commute_minutes"] == 30
    with pytest.raises(Exception, match="suppressed|positive"):
        census.commute_ratio(*tables(*bad), codes).collect()
    with pytest.raises(CheckFailed, match="Missing keys"):
        census.commute_ratio(*tables("1", "1", "1", "1"), codes.union(spark.createDataFrame([("00002",)], "code string")))


def test_binned_mean_must_reconcile(spark):
    df = spark.createDataFrame([("m", 10, 10, 20), ("m", 0, 20, 20)], "k string, a int, b int, n int")
    assert census.binned_mean(df, ["k"], {"a": 5.0, "b": 15.0}, "n", "mean").first()["mean"] == 12.5
    with pytest.raises(Exception, match="reconcile"):
        census.binned_mean(df, ["k"], {"a": 5.0}, "n", "mean").collect()


def test_junctions(spark):
    def nodes(*arms):
        edges = [(1, 1, 10 + i, 0.0, 0.0, x, y) for i, (x, y) in enumerate(arms)]
        return graph.node_degrees(spark.createDataFrame(edges, "county int, from_node long, to_node long, from_x double, from_y double, to_x double, to_y double"))

    square = spark.createDataFrame([([(-200.0, -200.0), (200.0, -200.0), (200.0, 200.0), (-200.0, 200.0)],)], "ring array<struct<x: double, y: double>>")
    four = graph.junctions(nodes((100.0, 0.0), (-100.0, 0.0), (0.0, 100.0), (0.0, -100.0)), 20.0, square)
    assert four.select("cluster").distinct().count() == 1
    on_border = spark.createDataFrame([([(0.0, -200.0), (200.0, -200.0), (200.0, 200.0), (0.0, 200.0)],)], square.schema)
    assert graph.junctions(nodes((100.0, 0.0), (100.0, 50.0), (100.0, -50.0)), 20.0, on_border).count() == 0
    loop = nodes((0.0, 0.0)).where("node = 1").first()
    assert loop["degree"] == 1
    self_loop = spark.createDataFrame([(1, 7, 7, 0.0, 0.0, 0.0, 0.0)], "county int, from_node long, to_node long, from_x double, from_y double, to_x double, to_y double")
    assert graph.node_degrees(self_loop).first()["degree"] == 2


def test_radius_band_is_inclusive(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0)], "place_id long, place_x double, place_y double")
    xs = [math.nextafter(1.0, 0), 1.0, 2.0, math.nextafter(2.0, 3)]
    points = spark.createDataFrame([(i, x, 0.0, 1.0) for i, x in enumerate(xs)], "point_id long, x double, y double, weight double")
    assert rows(spatial.radius_neighbors(places, points, 1.0, 2.0), "point_id", "share") == [(1, 0.5), (2, 0.5)]
    far = spatial.nearest_beyond(places, points.where("x > 2"), 1.0, 1.5).first()
    assert far["point_id"] == 3 and (far["end_x"], far["end_y"]) == pytest.approx((1.5, 0))
    assert spatial.nearest_beyond(places, points.limit(0), 1.0, 1.5).count() == 0


def test_weighted_choice_and_sampling(spark):
    zones = spark.createDataFrame([(1, 3), (2, 0), (3, 1)], "zone_id long, weight long")
    requests = spark.createDataFrame([(1, 0.0), (2, 0.74), (3, 0.75), (4, 0.999)], "request_id long, u double")
    assert rows(spatial.weighted_choice(requests, zones)) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    thin = spark.createDataFrame([(5, [(0.0, 0.0), (1.0, 0.98), (1.0, 1.0)])], "polygon_id long, ring array<struct<x: double, y: double>>")
    sample = spatial.sample_in_polygons(thin, 8, "s")
    assert sample.count() == 8 and sample.where(~geo.inside_ring(F.col("x"), F.col("y"), ring((0, 0), (1, 0.98), (1, 1)))).count() == 0
    flat = spark.createDataFrame([(6, [(0.0, 0.0), (1.0, 0.0), (0.5, 0.0)])], thin.schema)
    with pytest.raises(Exception, match="enough points"):
        spatial.sample_in_polygons(flat, 4, "s", attempts=300).collect()


def test_fleet_rules(spark):
    r = one(spark, a=fleet.fare_cents(F.lit(0.5), F.lit(0.0), "0", "0.01", "0"), b=fleet.fare_cents(F.lit(3.0), F.lit(9.0), "2.50", "1.25", "0.305"))
    assert list(r) == [1, 900]  # 2.50 + 3.75 + 2.745 = 8.995 dollars, half up
    segment = spark.createDataFrame([(1438.0, 1453.0, 0.0, 0.0, 5.0, 0.0), (1500.0, 1501.0, 0.0, 0.0, 1.0, 1.0)],
                                    "start_minute double, end_minute double, from_x double, from_y double, to_x double, to_y double")
    cut = fleet.clip_segments(segment, 1440.0).collect()
    assert len(cut) == 1 and (cut[0]["end_minute"], cut[0]["to_x"]) == pytest.approx((1440, 2 / 3))
    hours = dict(rows(fleet.split_by_hour(spark.createDataFrame([(30.0, 150.0), (60.0, 120.0)], "a double, b double"), "a", "b", [], "m")))
    assert hours == {0: 30.0, 1: 120.0, 2: 30.0}
    none = spark.createDataFrame([], "outcome string, wait double, cents long, paid_miles double, empty_miles double, service_minutes double, passenger_minutes double")
    totals = fleet.fleet_totals(none, 5, 1440.0).first()
    assert totals["total_requests"] == 0 and totals["average_wait_minutes"] is None and totals["empty_mile_pct"] is None
    rides = spark.createDataFrame([(5.0, 70.0, False, 4.0, 900), (65.0, None, True, None, 0), (119.0, 125.0, False, 2.0, 300)],
                                  "request_minute double, dropoff_minute double, rejected boolean, wait double, cents long")
    got = rows(fleet.hourly_metrics(rides, 2), "hour", "requests", "completed_rides", "rejected_requests", "cents", "average_wait_minutes")
    assert got == [(0, 1, 0, 0, 0, None), (1, 2, 1, 1, 900, 4.0)]


def test_segment_accounting_is_conserved(spark):
    """Hourly shares of clipped segments add up to the clipped total."""
    rng = random.Random(2)
    data = [(s := rng.uniform(0, 1400), s + rng.uniform(0.1, 300), 0.0, 0.0, 1.0, 1.0) for _ in range(200)]
    df = spark.createDataFrame(data, "start_minute double, end_minute double, from_x double, from_y double, to_x double, to_y double")
    cut = fleet.clip_segments(df, 1440.0)
    total = cut.agg(F.sum(F.col("end_minute") - F.col("start_minute"))).first()[0]
    hourly = fleet.split_by_hour(cut, "start_minute", "end_minute", [], "m")
    assert hourly.agg(F.sum("m")).first()[0] == pytest.approx(total) and hourly.agg(F.max("hour")).first()[0] < 24
