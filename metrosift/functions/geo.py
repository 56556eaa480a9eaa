"""Distance, projection and polyline arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0088
SPHERE_RADIUS_KM = 6371.0
INCH_IN_MM = 25.4
FOOT_IN_M = 0.3048
SQUARE_METRES_PER_KM2 = 1_000_000
MILES_PER_DEGREE_LATITUDE = 69.0
MILES_PER_DEGREE_LONGITUDE_AT_EQUATOR = 69.172
METRES_PER_DEGREE_LATITUDE = 111_132.0
METRES_PER_DEGREE_LONGITUDE_AT_EQUATOR = 111_320.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996


def great_circle_km(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_KM
) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * radius)


def inches_to_mm(inches: Column) -> Column:
    return inches * INCH_IN_MM


def square_metres_to_km2(area: Column) -> Column:
    return area / SQUARE_METRES_PER_KM2


def feet_to_metres(feet: Column, places: int = 2) -> Column:
    return F.round(feet * FOOT_IN_M, places)


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))


def utm_code(lon: Column, lat: Column) -> Column:
    """326xx north, 327xx south."""
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """Struct(x, y) in metres by the sixth-order transverse Mercator series in n."""
    n = WGS84_F / (2 - WGS84_F)
    a_bar = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    e = 2 * math.sqrt(n) / (1 + n)
    lam = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    false_north = F.when(lat < 0, F.lit(10_000_000.0)).otherwise(F.lit(0.0))
    return F.struct(
        (east * (UTM_K0 * a_bar) + 500_000.0).alias("x"),
        (north * (UTM_K0 * a_bar) + false_north).alias("y"),
    )


def to_local_miles(lon: Column, lat: Column, origin_lon: Column, origin_lat: Column) -> Column:
    per_lon = F.cos(F.radians(origin_lat)) * MILES_PER_DEGREE_LONGITUDE_AT_EQUATOR
    return F.struct(
        F.round((lon - origin_lon) * per_lon, 6).alias("x"),
        F.round((lat - origin_lat) * MILES_PER_DEGREE_LATITUDE, 6).alias("y"),
    )


def from_local_miles(
    x: Column, y: Column, origin_lon: Column, origin_lat: Column, per_lon: Column, per_lat: Column
) -> Column:
    return F.struct((origin_lon + x / per_lon).alias("lon"), (origin_lat + y / per_lat).alias("lat"))


def local_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column, at_lat: float) -> Column:
    per_lon = METRES_PER_DEGREE_LONGITUDE_AT_EQUATOR * math.cos(math.radians(at_lat))
    return F.hypot((lon1 - lon2) * per_lon, (lat1 - lat2) * METRES_PER_DEGREE_LATITUDE)


def first_point(points: Column) -> Column:
    return F.element_at(points, 1)


def last_point(points: Column) -> Column:
    return F.element_at(points, -1)


def leg_lengths(points: Column) -> Column:
    """Length of each leg of an array<struct<x,y>>."""
    return F.zip_with(
        F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))),
        lambda b, a: F.hypot(b["x"] - a["x"], b["y"] - a["y"]),
    )


def polyline_length(points: Column) -> Column:
    return F.aggregate(leg_lengths(points), F.lit(0.0), lambda total, leg: total + leg)


def point_along(points: Column, fraction: Column) -> Column:
    """Struct(x, y) at a fraction of the line's length; ends are clamped.

    The walk folds over the legs: it keeps how far is left and stops at the leg
    that reaches the target.
    """
    target = polyline_length(points) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction))
    legs = F.arrays_zip(
        F.slice(points, F.lit(1), F.size(points) - 1).alias("a"),
        F.slice(points, F.lit(2), F.size(points) - 1).alias("b"),
        leg_lengths(points).alias("d"),
    )
    start = F.struct(
        target.alias("left"),
        first_point(points)["x"].alias("x"), first_point(points)["y"].alias("y"),
    )

    def walk(state, leg):
        share = F.when(leg["d"] > 0, F.least(F.lit(1.0), state["left"] / leg["d"])).otherwise(F.lit(0.0))
        moves = state["left"] > 0
        return F.struct(
            F.greatest(F.lit(0.0), state["left"] - leg["d"]).alias("left"),
            F.when(moves, leg["a"]["x"] + (leg["b"]["x"] - leg["a"]["x"]) * share)
            .otherwise(state["x"]).alias("x"),
            F.when(moves, leg["a"]["y"] + (leg["b"]["y"] - leg["a"]["y"]) * share)
            .otherwise(state["y"]).alias("y"),
        )

    end = F.aggregate(legs, start, walk)
    return F.when(
        F.size(points) == 1,
        F.struct(first_point(points)["x"].alias("x"), first_point(points)["y"].alias("y")),
    ).otherwise(F.struct(end["x"].alias("x"), end["y"].alias("y")))


def _edges(ring: Column) -> Column:
    """Edges struct<a,b> of the closed ring, the last back to the first point."""
    n = F.size(ring)
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1)),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """On an edge of the closed ring array<struct<x,y>>."""
    def on_edge(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        return (
            (cross == 0)
            & x.between(F.least(ax, bx), F.greatest(ax, bx))
            & y.between(F.least(ay, by), F.greatest(ay, by))
        )

    return F.exists(_edges(ring), on_edge)


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside the closed ring array<struct<x,y>>; on the border is outside."""
    def crosses(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        spans = (ay > y) != (by > y)
        return spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax)

    odd = F.aggregate(_edges(ring), F.lit(False), lambda odd, e: odd != F.coalesce(crosses(e), F.lit(False)))
    return odd & ~on_ring(x, y, ring)


def distance_to_ring(x: Column, y: Column, ring: Column) -> Column:
    """Distance from a point to the nearest edge of the closed ring."""
    n = F.size(ring)
    edges = F.zip_with(
        ring, F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1)),
        lambda a, b: point_to_segment(x, y, a["x"], a["y"], b["x"], b["y"])["distance"],
    )
    return F.array_min(edges)


def point_to_segment(x, y, ax, ay, bx, by) -> Column:
    """Struct(distance, fraction): projection clamped to the segment."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    share = F.when(
        squared > 0,
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / squared)),
    ).otherwise(F.lit(0.0))
    return F.struct(
        F.hypot(x - (ax + dx * share), y - (ay + dy * share)).alias("distance"),
        share.alias("fraction"),
    )


def round_coordinates(points: Column, places: int = 6) -> Column:
    return F.transform(
        points, lambda p: F.struct(F.round(p["x"], places).alias("x"), F.round(p["y"], places).alias("y"))
    )
