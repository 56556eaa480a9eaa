"""Demand zones: their points, areas and a local coordinate system around the weighted origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrosift.functions import geo
from metrosift.session import stage


def weighted_origin(points: DataFrame, weight: str, places: int = 8) -> DataFrame:
    """One row (origin_lon, origin_lat, total_weight): the weighted mean of lon and lat.

    Rows without a point or with no weight take no part; nothing to weigh gives nulls.
    """
    w = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.col(weight).cast("double"))
    return points.agg(*[
        F.round(F.sum(F.col(c) * w) / F.nullif(F.sum(w), F.lit(0.0)), places).alias(f"origin_{c}") for c in ("lon", "lat")
    ], F.sum(w).alias("total_weight"))


def shape_edges(table: DataFrame, key: str, shape: str = "shape") -> DataFrame:
    """(key, part, ring, a, b, o): every edge from a to b, the last one back to the first point o. Ring 0 is the outline."""
    parts = table.select(key, F.posexplode(shape).alias("part", "_rings"))
    rings = parts.select(key, "part", F.posexplode("_rings").alias("ring", "_points"))
    points = F.col("_points")
    following = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, 1, 1))
    pairs = F.zip_with(points, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return rings.select(key, "part", "ring", F.element_at(points, 1).alias("o"), F.explode(pairs).alias("_e")).select(
        key, "part", "ring", "_e.a", "_e.b", "o")


def part_integrals(edges: DataFrame, key: str) -> DataFrame:
    """(key, part, area, mx, my): area and first moments of each part, outline less holes, whichever way they run.

    Edges are taken relative to their ring's first point, so far-away rings lose no digits,
    and summed on the map side.
    """
    a, b = ({c: F.col(f"{p}.{c}") - F.col(f"o.{c}") for c in ("x", "y")} for p in ("a", "b"))
    cross = a["x"] * b["y"] - b["x"] * a["y"]
    moment = {c: (F.col(f"o.{c}") + (a[c] + b[c]) / 3) * cross / 2 for c in ("x", "y")}
    rings = edges.groupBy(key, "part", "ring").agg(
        F.sum(cross / 2).alias("area"), F.sum(moment["x"]).alias("mx"), F.sum(moment["y"]).alias("my"))
    turned = (F.col("area") < 0) == (F.col("ring") == 0)
    return rings.groupBy(key, "part").agg(*[
        F.sum(F.when(turned, -F.col(c)).otherwise(F.col(c))).alias(c) for c in ("area", "mx", "my")])


def inner_points(edges: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, lon, lat): a point within each shape that has an area.

    The largest part is cut by a level line halfway between the two vertex heights next to
    the middle of its box; the point is the middle of the line's widest stretch inside.
    """
    order = F.struct("area", (-F.col("part")).alias("place"))
    largest = parts.where("area > 0").groupBy(key).agg(F.max_by("part", order).alias("part"))
    # a window holds the edges of one part, which came from one row
    own = Window.partitionBy(key)
    y = F.col("a.y")
    cut = edges.join(largest, [key, "part"]).withColumn("_middle", (F.min(y).over(own) + F.max(y).over(own)) / 2)
    cut = cut.withColumn("_level", (F.max(F.when(y <= F.col("_middle"), y)).over(own) + F.min(F.when(y > F.col("_middle"), y)).over(own)) / 2)
    level = F.col("_level")
    crossed = cut.where((y > level) != (F.col("b.y") > level)).withColumn("_x", F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (
        level - y) / (F.col("b.y") - y))
    along = own.orderBy("_x")
    stretches = crossed.select(key, "_level", "_x", F.lead("_x").over(along).alias("_to"), F.row_number().over(along).alias("_n"))
    widest = stretches.where((F.col("_n") % 2 == 1) & (F.col("_to") > F.col("_x"))).groupBy(key).agg(
        F.max(F.struct((F.col("_to") - F.col("_x")).alias("width"), ((F.col("_to") + F.col("_x")) / 2).alias("x"), level.alias("y"))).alias("m"))
    return widest.select(key, F.col("m.x").alias("lon"), F.col("m.y").alias("lat"))


def zone_points(zones: DataFrame, key: str = "zone_id", places: int = 8, shape: str = "shape") -> DataFrame:
    """Zones (unique ``key``) with a point within each (lon, lat), their area and centre of mass, in the units of the shape.

    The centre may lie outside the shape. Shapes without an area have neither; a null
    shape has no area, an empty one the area 0.
    """
    edges = shape_edges(zones, key, shape)
    parts = stage(part_integrals(edges, key), "part-integrals")
    whole = parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("area", "mx", "my")])
    area = F.nullif(F.greatest(F.col("area"), F.lit(0.0)), F.lit(0.0))
    found = whole.select(key, "area", (F.col("mx") / area).alias("centroid_lon"), (F.col("my") / area).alias("centroid_lat")).join(
        inner_points(edges, parts, key), key, "left")
    out = zones.join(found, key, "left")
    return out.select(*zones.columns, *[F.round(c, places).alias(c) for c in ("lon", "lat")],
                      F.when(F.col(shape).isNotNull(), F.coalesce("area", F.lit(0.0))).alias("area"), "centroid_lon", "centroid_lat")


def local_zones(zones: DataFrame, weight: str, key: str = "zone_id", shape: str = "shape") -> DataFrame:
    """Zones with their point and its place in miles east and north of the weighted origin.

    ``zones``: shape in degrees, ``weight`` (trips produced). Adds the columns of
    ``zone_points``, the origin, x_miles and y_miles. The origin is one row, so it is
    broadcast and zones are not shuffled.
    """
    placed = stage(zone_points(zones, key, shape=shape), "zone-points")
    origin = weighted_origin(placed, weight).drop("total_weight")
    # one row by construction: every zone meets it through a constant key
    joined = placed.withColumn("_one", F.lit(1)).join(F.broadcast(origin.withColumn("_one", F.lit(1))), "_one").drop("_one")
    local = geo.to_local_miles(F.col("lon"), F.col("lat"), F.col("origin_lon"), F.col("origin_lat"))
    return joined.withColumn("_l", local).select(
        *joined.columns, F.col("_l.x").alias("x_miles"), F.col("_l.y").alias("y_miles"))


def degrees_of(x_miles: Column, y_miles: Column, origin_lon: Column, origin_lat: Column) -> Column:
    """Struct(lon, lat) of a place given in miles from the origin."""
    per_lon = F.cos(F.radians(origin_lat)) * geo.MILES_PER_DEGREE_LONGITUDE_AT_EQUATOR
    return geo.from_local_miles(x_miles, y_miles, origin_lon, origin_lat, per_lon, F.lit(geo.MILES_PER_DEGREE_LATITUDE))
