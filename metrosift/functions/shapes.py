"""Polygons of several parts with holes, row by row in built-in expressions.

A shape is ``array<array<array<struct<x,y>>>>``: parts, their rings and the rings' points.
The first ring of a part is its outline and the others are holes; rings are open (no
closing point). Parts of one shape do not overlap and holes lie within their outline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrosift.functions import geo

RING = "array<struct<x: double, y: double>>"
SHAPE = f"array<array<{RING}>>"
#: Types a shape may be written as.
POLYGON_TYPES = ("Polygon", "MultiPolygon")


def open_ring(positions: Column) -> Column:
    """A ring of [x, y, ...] positions as points, without the closing one."""
    closed = F.element_at(positions, 1) == F.element_at(positions, -1)
    kept = F.when(closed & (F.size(positions) > 1), F.slice(positions, F.lit(1), F.size(positions) - 1)).otherwise(positions)
    return F.transform(kept, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def shape_of(kind: Column, coordinates: Column) -> Column:
    """Shape of a polygon written as text of nested positions; null geometry stays null, other types stop the job.

    Parts and rings without points are left out, so an empty geometry is an empty shape.
    """
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    parts = (
        F.when(kind.isNull() & coordinates.isNull(), F.lit(None).cast("array<array<array<array<double>>>>"))
        .when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
        .otherwise(F.raise_error(F.concat(F.lit("Not a polygon: "), F.coalesce(kind, F.lit("no type")))))
    )
    rings = F.transform(parts, lambda part: F.filter(F.transform(part, open_ring), lambda ring: F.size(ring) > 0))
    return F.filter(rings, lambda part: F.size(part) > 0)


def shape_of_ring(ring: Column) -> Column:
    return F.array(F.array(ring))


def rings(shape: Column) -> Column:
    return F.flatten(shape)


def part_bounds(part: Column) -> dict[str, Column]:
    """x0, x1, y0, y1 of a part's outline."""
    outline = F.element_at(part, 1)
    return {f"{a}{i}": f(F.transform(outline, lambda p: p[a])) for a in ("x", "y") for i, f in ((0, F.array_min), (1, F.array_max))}


def inside_part(x: Column, y: Column, part: Column) -> Column:
    """Strictly inside: within the outline, in no hole and on no border."""
    holes = F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0)))
    return geo.inside_ring(x, y, F.element_at(part, 1)) & ~F.exists(
        holes, lambda ring: geo.inside_ring(x, y, ring) | geo.on_ring(x, y, ring))


def covered_by_part(x: Column, y: Column, part: Column) -> Column:
    """Inside the part or on the border of its outline or of a hole."""
    return inside_part(x, y, part) | F.exists(part, lambda ring: geo.on_ring(x, y, ring))


def distance_to_border(x: Column, y: Column, shape: Column) -> Column:
    """Distance to the nearest edge of any ring; null without rings."""
    return F.array_min(F.transform(rings(shape), lambda ring: geo.distance_to_ring(x, y, ring)))
