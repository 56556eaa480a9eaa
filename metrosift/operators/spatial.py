"""Spatial joins as equi-joins on grid cells.

Boxes of very different sizes are handled by levels: a box is filed at the level
whose cell is at least as large as the box, so it touches at most four cells, and a
point looks once into each level in use (at most a few dozen). A huge box never
explodes into many cells and a small one never shares a cell with far-away points.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrosift.functions import geo, shapes
from metrosift.operators.joins import fits, join_lookup, salted_join, spread
from metrosift.operators.ordered import add_running_total, carry_last
from metrosift.session import stage

CELL = ["_level", "_cx", "_cy"]
# A nearest search over more rows than this starts from small radii.
ONE_PASS_ROWS = 20_000
# Rows one search cell may hold when the first radius is chosen: a place meets nine cells, so pairs stay few.
CELL_ROWS = 64
# With more rows than this to be found, planar searches compare matrices of cells instead of joined pairs.
MATRIX_ROWS = 20_000
# Cells of a side that a segment may reach over to be filed under its middle.
SEGMENT_CELLS = 8
# Rows of one cell that one task searches for.
MATRIX_LEFT = 20_000
# Points of a grid cell that segments are drawn on, segments that a task holds, and pairs it looks at together.
SNAP_POINTS, SNAP_SEGMENTS, SNAP_PAIRS = 2, 400_000, 1 << 15
# Pairs that one task compares where all that are near come out.
MATRIX_PAIRS = 4_000_000


def _boxed(boxes: DataFrame) -> DataFrame:
    """File boxes (x0, y0, x1, y1) under the up to four cells they touch."""
    side = "greatest(x1 - x0, y1 - y0, 1e-9)"
    leveled = boxes.withColumn("_level", F.expr(f"cast(ceil(log2({side})) as int)"))
    spans = []
    for a in ("x", "y"):
        low, high = (f"cast(floor({a}{i} / pow(2D, _level)) as bigint)" for i in (0, 1))
        spans.append((f"_c{a}", f"explode(sequence({low}, {high}))"))
    for name, expression in spans:
        leveled = leveled.withColumn(name, F.expr(expression))
    return leveled


def _pointed(points: DataFrame, levels: list[int]) -> DataFrame:
    leveled = points.withColumn("_level", F.explode(F.lit(levels)))
    return leveled.withColumn(
        "_cx", F.expr("cast(floor(x / pow(2D, _level)) as bigint)")
    ).withColumn("_cy", F.expr("cast(floor(y / pow(2D, _level)) as bigint)"))


def box_join(points: DataFrame, boxes: DataFrame, spread_by: str, how: str = "inner") -> DataFrame:
    """Pairs of a point (x, y) and a box (x0, y0, x1, y1, inclusive) that holds it.

    With ``how='left'`` a point keeps one row with null box columns per level without
    a match, so callers aggregate by point. Boxes are broadcast only when counted to
    be few; otherwise points of a crowded cell are spread over salts.
    """
    filed = _boxed(boxes)
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect()) or [0]
    cells = _pointed(points, levels)
    inside = "x >= x0 AND x <= x1 AND y >= y0 AND y <= y1"
    if how == "inner":
        if fits(filed):
            joined = cells.join(F.broadcast(filed), CELL)
        elif fits(cells):
            joined = F.broadcast(cells).join(filed, CELL)
        else:
            joined = salted_join(cells, filed, CELL, F.col(spread_by))
        return joined.where(inside).drop(*CELL)
    if fits(filed):
        joined = cells.join(F.broadcast(filed), CELL, "left")
    else:
        joined = salted_join(cells, filed, CELL, F.col(spread_by), how="left")
    keep = F.expr(inside)
    right = [c for c in boxes.columns]
    return joined.select(
        *points.columns, *[F.when(keep, F.col(c)).alias(c) for c in right]
    )


def with_shape(polygons: DataFrame) -> DataFrame:
    """Polygons with a ``shape`` column; a plain ``ring`` becomes a shape of one part without holes."""
    if "shape" in polygons.columns:
        return polygons
    return polygons.withColumn("shape", shapes.shape_of_ring(F.col("ring"))).drop("ring")


def part_boxes(polygons: DataFrame) -> DataFrame:
    """One row per part: ``part`` (its rings) and the box of its outline; other columns are kept.

    Parts far apart have boxes of their own, so a shape of many islands is looked up in
    small cells. Empty and null shapes have no rows. The table is stored, as a join reads
    it several times (levels, size, rows) and the boxes then are plain columns to it.
    """
    exploded = with_shape(polygons).withColumn("part", F.explode("shape"))
    return stage(exploded.select("*", *[c.alias(n) for n, c in shapes.part_bounds(F.col("part")).items()]), "parts")


def assign_points(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Left join: each point (point_id, x, y, ...) with the polygon it lies within.

    ``polygons``: polygon_id and shape (or ring). A point on the border of an outline or
    a hole, or within a hole, matches nothing; the lowest polygon_id wins, unmatched is
    null. Every row of ``points`` gives one row, also where ids or whole rows repeat: only
    distinct locations are joined to polygons, and other columns meet the result once.
    """
    spots = points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct()
    parts = part_boxes(polygons.select("polygon_id", "shape" if "shape" in polygons.columns else "ring")).drop("shape")
    inside = box_join(spots, parts, "x").where(shapes.inside_part(F.col("x"), F.col("y"), F.col("part")))
    found = inside.groupBy("x", "y").agg(F.min("polygon_id").alias("polygon_id"))
    return join_lookup(points, found, ["x", "y"], "left").select(*points.columns, "polygon_id")


def points_in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Inner many-to-many form: every (point_id, polygon_id) with the point within."""
    parts = part_boxes(polygons.select("polygon_id", "shape" if "shape" in polygons.columns else "ring")).drop("shape")
    pairs = box_join(points, parts, "point_id")
    return pairs.where(shapes.inside_part(F.col("x"), F.col("y"), F.col("part"))).select("point_id", "polygon_id")


def off_border(points: DataFrame, boundary: DataFrame, border: float, spread_by: str) -> DataFrame:
    """Points (x, y, ...) within a shape of ``boundary`` or on its edge, and farther than ``border`` from all its edges."""
    kept = part_boxes(boundary.select("shape" if "shape" in boundary.columns else "ring"))
    x, y = F.col("x"), F.col("y")
    near = box_join(points, kept, spread_by).where(shapes.covered_by_part(x, y, F.col("part")))
    return near.where(shapes.distance_to_border(x, y, F.col("shape")) > border).select(*points.columns)


# ---- nearest by matrices of cells ------------------------------------------------

def is_large(rows: DataFrame) -> bool:
    return not fits(rows, MATRIX_ROWS)


def in_cells(rows: DataFrame, x: str, y: str, side: float, around: bool = False) -> DataFrame:
    """Rows with the grid cell (_cx, _cy) of their place, or, ``around`` it, with each of the nine next cells."""
    for name, c in (("_cx", x), ("_cy", y)):
        cell = F.floor(F.col(c) / side).cast("long")
        rows = rows.withColumn(name, F.explode(F.sequence(cell - 1, cell + 1)) if around else cell)
    return rows


def least_in_cells(left: DataFrame, right: DataFrame, measure, every: bool = False) -> DataFrame:
    """Pairs (columns of both) of a left row and the rows of ``right`` in its cell that may be its nearest.
    With ``every``, all pairs that perhaps count come out.

    Both sides have _cx and _cy. ``measure`` takes two dictionaries of columns, as numpy
    arrays that broadcast to a matrix of left by right rows, and gives the distances, which
    pairs surely count and which perhaps do. What is no farther than the nearest sure one,
    but for rounding, comes out, so the caller's own expressions decide. No pair leaves a
    task but those; a crowded cell's left rows are spread over as many tasks as they need.
    """
    on = ["_cx", "_cy"]
    rows_of = F.count(F.lit(1))
    if every:  # a task gives out what it finds at once, so its pairs are bounded too
        counts = left.groupBy(*on).agg(rows_of.alias("_l")).join(right.groupBy(*on).agg(rows_of.alias("_r")), on)
        cells = counts.select(*on, F.ceil(F.greatest(F.col("_l") / MATRIX_LEFT, F.col("_l") * F.col("_r") / MATRIX_PAIRS)).cast("int").alias("_tasks"))
    else:
        cells = left.groupBy(*on).agg(F.ceil(rows_of / MATRIX_LEFT).cast("int").alias("_tasks"))
    cells = stage(cells, "cells")
    how = "inner" if fits(cells) else "left"  # rows of the right in cells that nobody searches stay where they are
    cells = F.broadcast(cells if how == "inner" else cells.where("_tasks > 1"))
    tasks = F.coalesce("_tasks", F.lit(1))
    a = left.join(cells, on, how).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), tasks).cast("int")).drop("_tasks")
    b = right.join(cells, on, how).withColumn("_salt", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
    own, other = ([f for f in side.schema if f.name not in ("_cx", "_cy")] for side in (left, right))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*own, *other))

    def match(rows: pa.Table, near: pa.Table) -> pa.Table:
        rows, near = rows.select([f.name for f in own]), near.select([f.name for f in other])
        at, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if rows.num_rows and near.num_rows:
            x, y = ({c: t[c].to_numpy() for c in t.column_names} for t in (rows, near))
            step = max(1, (1 << 20) // near.num_rows)
            for begin in range(0, rows.num_rows, step):
                d, sure, perhaps = measure({c: v[begin:begin + step, None] for c, v in x.items()}, {c: v[None, :] for c, v in y.items()})
                if not every:
                    best = np.where(sure, d, np.inf).min(axis=1)
                    perhaps = perhaps & (d <= best[:, None] * (1 + 1e-9) + 1e-12)
                i, j = np.nonzero(perhaps)
                at.append(begin + i)
                of.append(j)
        at, of = pa.array(np.concatenate(at)), pa.array(np.concatenate(of))
        rows, near = rows.take(at), near.take(of)
        return pa.table([*rows.columns, *near.columns], names=[*rows.column_names, *near.column_names])

    keys = ["_cx", "_cy", "_salt"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(match, kinds)


# ---- nearest on the sphere -------------------------------------------------------

def _bands(radius_km: float) -> float:
    """Height of a latitude band in degrees, a little over the radius."""
    return math.degrees(radius_km / geo.EARTH_RADIUS_KM) * 1.0001


def _far_cos(band: str, h: float) -> str:
    """Smallest cosine of latitude in a band, kept above zero."""
    return (
        f"greatest(1e-9, least(cos(radians(least(90D, greatest(-90D, {band} * {h}D - 90)))), "
        f"cos(radians(least(90D, greatest(-90D, ({band} + 1) * {h}D - 90))))))"
    )


def _lon_cells(band: str, h: float) -> str:
    return f"greatest(1, cast(floor(360 * {_far_cos(band, h)} / {h}D) as int))"


def _station_cells(stations: DataFrame, h: float) -> DataFrame:
    return (
        stations.withColumn("_band", F.expr(f"cast(floor((lat + 90) / {h}D) as int)"))
        .withColumn("_n", F.expr(_lon_cells("_band", h)))
        .withColumn("_cell", F.expr("pmod(cast(floor((lon + 180) / (360D / _n)) as int), _n)"))
        .drop("_n")
    )


def _search_cells(places: DataFrame, radius_km: float, h: float) -> DataFrame:
    """Every cell that may hold a point within the radius of the place."""
    half = math.sin(radius_km / geo.EARTH_RADIUS_KM / 2)
    return (
        places.withColumn("_b0", F.expr(f"cast(floor((lat + 90) / {h}D) as int)"))
        .withColumn("_band", F.explode(F.expr("sequence(_b0 - 1, _b0 + 1)")))
        .withColumn("_n", F.expr(_lon_cells("_band", h)))
        .withColumn("_reach", F.expr(
            f"degrees(2 * asin(least(1D, {half!r}D / sqrt(greatest(1e-9, cos(radians(lat))) * "
            f"{_far_cos('_band', h)})))) * 1.0001"))
        .withColumn("_cell", F.explode(F.expr(
            "CASE WHEN _reach >= 90 OR _n <= 3 THEN sequence(0, _n - 1) ELSE "
            "array_distinct(transform(sequence(cast(floor((lon + 180 - _reach) / (360D / _n)) as int), "
            "cast(floor((lon + 180 + _reach) / (360D / _n)) as int)), c -> pmod(c, _n))) END")))
        .drop("_b0", "_n", "_reach")
    )


def _radii(stations: DataFrame, radius_km: float, rows: int) -> list[float]:
    """Growing search radii whose first cells are counted to hold at most ``rows`` stations."""
    steps = [radius_km / 4**i for i in range(9)]
    cell = [F.struct(F.lit(i).alias("i"), F.floor(F.col("lat") / _bands(r)).alias("a"),
                     F.floor(F.col("lon") * F.cos(F.radians("lat")) / _bands(r)).alias("b"))
            for i, r in enumerate(steps)]
    filled = stations.select(F.explode(F.array(*cell)).alias("c")).groupBy("c").count()
    worst = {r["i"]: r["m"] for r in filled.groupBy(F.col("c.i").alias("i")).agg(F.max("count").alias("m")).collect()}
    first = next((i for i in range(len(steps)) if worst[i] <= rows), len(steps) - 1)
    return steps[first::-1]


def nearest_stations(
    places: DataFrame, stations: DataFrame, k: int, radius_km: float, per: str | None = None
) -> DataFrame:
    """The ``k`` nearest stations of each place within the radius, ties by id.

    ``places``: place_id, lat, lon. ``stations``: station_id, lat, lon, more columns.
    With ``per`` the k nearest are taken for each of its values (few, such as data
    types) separately. Copies at one location are first cut to the k lowest ids, which
    are the only ones that can be chosen. Where stations are dense, places search a
    small radius first and only those that did not find k go on to the next.
    """
    group = [per] if per else []
    spot = Window.partitionBy("lat", "lon", *group).orderBy("station_id")
    distinct = stations.withColumn("_k", F.row_number().over(spot)).where(F.col("_k") <= k).drop("_k")
    radii, kinds = [radius_km], 1
    if not fits(distinct, ONE_PASS_ROWS):
        distinct = stage(distinct, "stations")
        kinds = distinct.select(per).distinct().count() if per else 1
        radii = _radii(distinct, radius_km, max(CELL_ROWS, 4 * k * kinds))

    found, open_places = [], places.select("place_id", "lat", "lon")
    for radius in radii:
        h = _bands(radius)
        right = _station_cells(distinct, h).withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
        left = _search_cells(open_places, radius, h)
        if fits(right):
            pairs = left.join(F.broadcast(right), ["_band", "_cell"])
        elif radius != radii[0] and fits(left):
            pairs = F.broadcast(left).join(right, ["_band", "_cell"])
        else:
            pairs = salted_join(left, right, ["_band", "_cell"], F.col("place_id"))
        distance = geo.great_circle_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
        order = Window.partitionBy("place_id", *group).orderBy("distance_km", "station_id")
        top = (
            pairs.withColumn("distance_km", distance).where(F.col("distance_km") <= radius)
            .withColumn("nearness", F.row_number().over(order)).where(F.col("nearness") <= k)
            .drop("_band", "_cell", "lat", "lon").withColumnsRenamed({"_lat": "lat", "_lon": "lon"})
        )
        if radius == radii[-1]:
            found.append(top)
            break
        top = stage(top, "nearest")
        full = top.groupBy("place_id").agg(F.count_if(F.col("nearness") == k).alias("_full")).where(
            F.col("_full") == kinds
        )
        found.append(top.join(full, "place_id", "left_semi"))
        open_places = stage(open_places.join(full, "place_id", "left_anti"), "open")
        if open_places.isEmpty():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def nearest_complete_mean(
    places: DataFrame, stations: DataFrame, measures: list[str], k: int, radius_km: float
) -> DataFrame:
    """Mean of each measure over the k nearest stations that report all of them."""
    ok = F.lit(True)
    for m in measures:
        ok = ok & F.col(m).isNotNull() & ~F.isnan(m) & (F.col(m) >= 0)
    near = nearest_stations(places, stations.where(ok), k, radius_km)
    return near.groupBy("place_id").agg(
        *[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("stations"),
        F.max("distance_km").alias("farthest_km"),
    )


# ---- planar neighbors ------------------------------------------------------------

def _around(places: DataFrame, reach: Column) -> DataFrame:
    return places.select(
        "*", *[(F.col(f"place_{a}") + s * reach).alias(f"{a}{i}")
               for a in ("x", "y") for i, s in ((0, -1), (1, 1))],
    )


def radius_neighbors(places: DataFrame, points: DataFrame, low: float, high: float) -> DataFrame:
    """(place_id, point_id, distance, share): points at low <= distance <= high.

    ``places``: place_id, place_x, place_y. ``points``: point_id, x, y, weight. ``share``
    is the point's part of the weight found around its place. Pairs are met twice, once
    for the weight around each place, which the places then bring along, so no pair is
    shuffled or sorted.
    """
    large = is_large(points)

    def pairs(around: DataFrame) -> DataFrame:
        if large:
            near = least_in_cells(in_cells(around.where("place_x IS NOT NULL AND place_y IS NOT NULL"), "place_x", "place_y", high * 1.001),
                                  in_cells(points.where("x IS NOT NULL AND y IS NOT NULL"), "x", "y", high * 1.001, around=True),
                                  _beyond(low, high), every=True)
        else:
            near = box_join(points, _around(around, F.lit(float(high))), "point_id")
        return near.withColumn(
            "distance", F.hypot(F.col("x") - F.col("place_x"), F.col("y") - F.col("place_y"))
        ).where((F.col("distance") >= low) & (F.col("distance") <= high))

    totals = stage(pairs(places).groupBy("place_id").agg(F.sum("weight").alias("_total")), "totals")
    return pairs(join_lookup(places, totals, ["place_id"])).select(
        "place_id", "point_id", "distance", (F.col("weight") / F.col("_total")).alias("share")
    )


def _beyond(low: float, reach: float):
    def measure(place, point):
        d = np.hypot(point["x"] - place["place_x"], point["y"] - place["place_y"])
        slack = 1e-9 * (1 + low + reach)
        return d, (d >= low + slack) & (d <= reach - slack), (d >= low - slack) & (d <= reach + slack)

    return measure


def nearest_beyond(
    places: DataFrame, points: DataFrame, low: float, high: float, start: float | None = None
) -> DataFrame:
    """Nearest point at distance >= low for each place, and where a leg of at most
    ``high`` towards it ends: (place_id, point_id, distance, end_x, end_y).

    The search box doubles until a point is found or it covers all points.
    """
    extent = points.agg(
        *[f(a).alias(f"{n}{a}") for a in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    spread = places.agg(
        *[f(f"place_{a}").alias(f"{n}{a}") for a in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    if extent["lox"] is None or spread["lox"] is None:
        widest = 0.0
    else:
        widest = math.hypot(*[
            max(extent[f"hi{a}"], spread[f"hi{a}"]) - min(extent[f"lo{a}"], spread[f"lo{a}"])
            for a in ("x", "y")
        ])
    reach, open_places, found = start or max(high, 1e-6), places, []
    large = is_large(points)
    if large:  # of points at one spot only the lowest id can be chosen
        points = stage(points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min_by("point_id", F.struct("point_id")).alias("point_id")), "spots")
    while True:
        if large:
            pairs = least_in_cells(in_cells(open_places.select("place_id", "place_x", "place_y").where("place_x IS NOT NULL AND place_y IS NOT NULL"),
                                            "place_x", "place_y", reach * 1.001),
                                   in_cells(points, "x", "y", reach * 1.001, around=True), _beyond(low, reach))
        else:
            pairs = box_join(points, _around(open_places, F.lit(float(reach))), "point_id")
        distance = F.hypot(F.col("x") - F.col("place_x"), F.col("y") - F.col("place_y"))
        best = (
            pairs.withColumn("d", distance).where((F.col("d") >= low) & (F.col("d") <= reach))
            .groupBy("place_id")
            .agg(F.min(F.struct("d", "point_id", "x", "y", "place_x", "place_y")).alias("m"))
        )
        if reach >= widest:
            found.append(best)
            break
        best = stage(best, "beyond")
        found.append(best)
        open_places = stage(open_places.join(best, "place_id", "left_anti"), "open")
        if open_places.isEmpty():
            break
        reach = reach * 2
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    part = F.least(F.lit(1.0), F.lit(float(high)) / F.col("m.d"))
    return out.select(
        "place_id", "m.point_id", F.col("m.d").alias("distance"),
        (F.col("m.place_x") + (F.col("m.x") - F.col("m.place_x")) * part).alias("end_x"),
        (F.col("m.place_y") + (F.col("m.y") - F.col("m.place_y")) * part).alias("end_y"),
    )


def _to_segment(reach: float):
    def measure(point, line):
        run, rise = line["bx"] - line["ax"], line["by"] - line["ay"]
        size = run * run + rise * rise
        east, north = point["x"] - line["ax"], point["y"] - line["ay"]
        along = east * (run / np.where(size > 0, size, 1.0))
        along += north * (rise / np.where(size > 0, size, 1.0))
        np.clip(along, 0.0, 1.0, out=along)
        east -= along * run
        north -= along * rise
        d = np.sqrt(east * east + north * north)
        slack = 1e-9 * (1 + reach)
        return d, d <= reach - slack, d <= reach + slack

    return measure


def _crossed(line: dict, wide: float, x0: float, y0: float, g: float, nx: int, ny: int):
    """(segment, cell): every cell of a grid that a segment comes within ``wide`` of, a part of the segments at a time."""
    def span(low, high, start, most):
        return (np.clip(np.floor((c - start) / g), -1, most).astype(np.int64) for c in (low - wide, high + wide))

    def spread(begin, end, most):
        begin, end = np.maximum(begin, 0), np.minimum(end, most - 1)
        n = np.maximum(end - begin + 1, 0)
        own = np.repeat(np.arange(len(n)), n)
        return own, np.arange(len(own)) - (np.cumsum(n) - n)[own] + begin[own]

    ax, ay, run, rise = line["ax"], line["ay"], line["bx"] - line["ax"], line["by"] - line["ay"]
    low, high = span(np.minimum(ax, line["bx"]), np.maximum(ax, line["bx"]), x0, nx)
    sums = np.cumsum(high - low + 1)
    begin = 0
    while begin < len(ax):
        end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + SNAP_PAIRS, "right")))
        own, column = spread(low[begin:end], high[begin:end], nx)
        own += begin
        # where the segment runs between the column's sides; one that hardly leaves a column counts as a whole
        slope = np.abs(run[own]) > 0.01 * g
        safe = np.where(slope, run[own], 1.0)
        t = [np.where(slope, np.clip((x0 + (column + k) * g + (2 * k - 1) * wide - ax[own]) / safe, 0.0, 1.0), float(k)) for k in (0, 1)]
        y = [ay[own] + rise[own] * v for v in t]
        at, row = spread(*span(np.minimum(*y), np.maximum(*y), y0, ny), ny)
        yield own[at], column[at] * ny + row
        begin = end


def _close_pairs(x: np.ndarray, y: np.ndarray, line: dict, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, segment): pairs that may be a point's nearest within ``reach``.

    Segments are drawn on a grid whose cells hold few points, dilated by a radius, and meet the points of those
    cells. Points without a segment that near go on with twice the radius and cells.
    """
    measure, pairs = _to_segment(reach), [(np.zeros(0, np.int64),) * 2]
    left = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    real = np.flatnonzero(np.isfinite(line["ax"] + line["ay"] + line["bx"] + line["by"]))
    line = {c: v[real] for c, v in line.items()}
    if not len(left) or not len(real):
        return pairs[0]
    sides = [max(np.ptp(c[left]), 1e-9) for c in (x, y)]
    size = 1 + max(np.abs(c).max() for c in (x[left], y[left], *line.values()))
    r = max(np.sqrt(SNAP_POINTS * sides[0] * sides[1] / len(left)) / 2, np.sqrt(sides[0] * sides[1]) / 2048, max(sides) / 2**20, reach / 256)
    while True:
        r = min(r, reach)
        g, wide, x0, y0 = 2 * r, r * (1 + 1e-6) + 1e-9 * size, x[left].min(), y[left].min()
        cx, cy = (np.floor((c[left] - o) / g).astype(np.int64) for c, o in ((x, x0), (y, y0)))
        nx, ny = int(cx.max()) + 1, int(cy.max()) + 1
        code = cx * ny + cy
        held = np.bincount(code, minlength=nx * ny)
        starts, places = np.cumsum(held) - held, left[np.argsort(code, kind="stable")]
        best, found = np.full(len(x), np.inf), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for of, cell in _crossed(line, wide, x0, y0, g, nx, ny):
            some = held[cell] > 0
            of, cell = of[some], cell[some]
            sums, begin = np.cumsum(held[cell]), 0
            while begin < len(cell):
                end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + SNAP_PAIRS, "right")))
                n = held[cell[begin:end]]
                own = np.repeat(np.arange(begin, end), n)
                point = places[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + starts[cell[own]]]
                segment = of[own]
                d, sure, perhaps = measure({"x": x[point], "y": y[point]}, {c: v[segment] for c, v in line.items()})
                np.minimum.at(best, point[sure], d[sure])
                kept = perhaps & (d <= best[point] * (1 + 1e-9) + 1e-12)
                found.append((point[kept], segment[kept], d[kept]))
                begin = end
        point, segment, d = (np.concatenate(c) for c in zip(*found))
        done = np.full(len(x), r >= reach) | (best <= r * (1 - 1e-6))
        kept = done[point] & (d <= best[point] * (1 + 1e-9) + 1e-12)
        pairs.append((point[kept], real[segment[kept]]))
        left = left[~done[left]]
        if not len(left):
            return tuple(np.concatenate(c) for c in zip(*pairs))
        r = 2 * r


def _near_segments(spots: DataFrame, segments: DataFrame, reach: float, side: float) -> DataFrame:
    """Pairs of a point (point_id, x, y) and a segment that may be its nearest within ``reach``, by tiles.

    A segment is filed once, under its middle, among tiles of its size's level; points go to the tiles whose segments
    may be near. A tile's points and segments are cut to what a task holds.
    """
    size = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    keys = ["_level", "_cx", "_cy"]
    filed = segments.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(size / side))).cast("int")).where("_level IS NOT NULL")
    sides = filed.groupBy("_level").agg(F.max(size).alias("size")).collect()  # a row for each level: at most log2(SEGMENT_CELLS) + 1
    for a in ("x", "y"):
        filed = filed.withColumn(f"_c{a}", F.floor((F.col(f"a{a}") + F.col(f"b{a}")) / 2 / (side * F.pow(F.lit(2.0), F.col("_level")))).cast("long"))
    levels = F.array(*[F.struct(F.lit(r["_level"]).cast("int").alias("_level"), F.lit(side * 2.0 ** r["_level"]).alias("s"),
                                F.lit((reach + r["size"] / 2) * (1 + 1e-9)).alias("w")) for r in sides])
    asked = spots.withColumn("_l", F.explode(levels) if sides else F.lit(None).cast("struct<_level: int, s: double, w: double>"))
    for a in ("x", "y"):
        low, high = (F.floor((F.col(a) + sign * (F.col("_l.w") + 1e-9 * F.abs(F.col(a)))) / F.col("_l.s")).cast("long") for sign in (-1, 1))
        asked = asked.withColumn(f"_c{a}", F.explode(F.sequence(low, high)))
    asked = asked.select("point_id", "x", "y", "_l._level", "_cx", "_cy")
    rows = F.count(F.lit(1))
    counts = asked.groupBy(*keys).agg(F.ceil(rows / MATRIX_LEFT).cast("int").alias("_p")).join(
        filed.groupBy(*keys).agg(F.ceil(rows / SNAP_SEGMENTS).cast("int").alias("_s")), keys)
    counts = stage(counts, "tiles")
    asked = join_lookup(asked, counts, keys).withColumn("_a", F.pmod(F.xxhash64("point_id", "x", "y"), F.col("_p")).cast("int")).withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_p", "_s")
    filed = join_lookup(filed, counts, keys).withColumn("_b", F.pmod(F.xxhash64(*segments.columns), F.col("_s")).cast("int")).withColumn(
        "_a", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).drop("_p", "_s")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*spots.schema, *segments.schema))

    def match(points: pa.Table, lines: pa.Table) -> pa.Table:
        points, lines = points.select(spot_names), lines.select(line_names)
        at, of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if points.num_rows and lines.num_rows:
            at, of = _close_pairs(points["x"].to_numpy(), points["y"].to_numpy(), {c: lines[c].to_numpy() for c in ("ax", "ay", "bx", "by")}, reach)
        points, lines = points.take(pa.array(at)), lines.take(pa.array(of))
        return pa.table([*points.columns, *lines.columns], names=[*points.column_names, *lines.column_names])

    spot_names, line_names = spots.columns, segments.columns
    on = [*keys, "_a", "_b"]
    return asked.groupBy(*on).cogroup(filed.groupBy(*on)).applyInArrow(match, kinds)


def snap_to_segments(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """Nearest road segment of each point within ``reach``.

    ``segments``: edge_id, seg, ax, ay, bx, by, start (length along the edge before it).
    Gives distance, the snapped position and how far along the edge it lies.
    """
    segments = stage(segments, "segments")
    boxes = segments.select(
        "*",
        *[F.expr(f"least(a{a}, b{a}) - {reach!r}D").alias(f"{a}0") for a in ("x", "y")],
        *[F.expr(f"greatest(a{a}, b{a}) + {reach!r}D").alias(f"{a}1") for a in ("x", "y")],
    )
    if is_large(segments):
        # short segments meet points within tiles, the few long ones by size as any box
        side = 4.0 * reach
        is_long = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > SEGMENT_CELLS * side
        spots = points.select("point_id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
        pairs = _near_segments(spots, boxes.where(~is_long).select(segments.columns), reach, side)
        pairs = pairs.unionByName(box_join(spots, boxes.where(is_long), "point_id").select(pairs.columns))
    else:
        pairs = box_join(points, boxes, "point_id")
    near = geo.point_to_segment(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    pairs = pairs.withColumn("_n", near).where(F.col("_n.distance") <= reach)
    best = pairs.groupBy("point_id").agg(F.min(F.struct(
        F.col("_n.distance").alias("distance"), "edge_id", "seg",
        F.expr("start + _n.fraction * hypot(bx - ax, by - ay)").alias("along"),
        F.expr("ax + _n.fraction * (bx - ax)").alias("snap_x"),
        F.expr("ay + _n.fraction * (by - ay)").alias("snap_y"),
    )).alias("m"))
    return best.select("point_id", "m.*")


def hash_uniform(*parts: Column) -> Column:
    """Reproducible uniform in [0, 1) from the first 32 bits of an MD5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def sample_in_polygons(polygons: DataFrame, n: int = 32, seed: str = "", attempts: int = 100_000) -> DataFrame:
    """First ``n`` seeded uniform points of the bounding box that the shape covers; its borders count.

    Row-local: no pairs and no shuffle of points. Most shapes need few draws, so a longer
    sequence is only tried where the shorter one came up short.
    """
    boxes = with_shape(spread(polygons, "polygon_id"))
    outlines = F.flatten(F.transform("shape", lambda part: F.element_at(part, 1)))
    boxes = boxes.withColumns({f"{a}{i}": f(F.transform(outlines, lambda p: p[a]))
                               for a in ("x", "y") for i, f in ((0, F.array_min), (1, F.array_max))})

    def draws(count: int) -> Column:
        points = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(
            i.alias("attempt"),
            *[(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0"))
               * hash_uniform(F.lit(seed), F.col("polygon_id"), i, F.lit(a))).alias(a)
              for a in ("x", "y")],
        ))
        flat = (F.col("x0") >= F.col("x1")) | (F.col("y0") >= F.col("y1"))  # without an area nothing can be drawn
        return F.slice(F.filter(points, lambda p: ~flat & F.exists("shape", lambda part: shapes.covered_by_part(p["x"], p["y"], part))), 1, n)

    tried = boxes.withColumn("_s", draws(2 * n))
    for count in (16 * n, attempts):
        tried = tried.withColumn("_s", F.when(F.size("_s") >= n, F.col("_s")).otherwise(draws(count)))
    enough = F.when(F.size("_s") >= n, F.col("_s")).otherwise(
        F.raise_error(F.lit("Could not sample enough points inside a polygon"))
    )
    return tried.select("polygon_id", F.posexplode(enough).alias("sample", "p")).select(
        "polygon_id", "sample", "p.attempt", "p.x", "p.y"
    )


def weighted_choice(requests: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone of each request (request_id, u in [0,1)) drawn in proportion to zone weight.

    ``zones``: zone_id, weight (whole numbers). The cumulative weights come from a
    range-partitioned running sum; zone starts and request targets are then merged in
    one sorted pass, so neither side is broadcast and no range join is needed.
    """
    total = zones.agg(F.sum("weight")).first()[0]
    ends = add_running_total(zones.where("weight > 0"), [F.col("zone_id")], "weight", "_end")
    starts = ends.select(
        (F.col("_end") - F.col("weight")).cast("long").alias("_at"), F.lit(0).alias("_kind"),
        F.col("zone_id").alias("_id"), F.col("zone_id").alias("zone_id"),
    )
    targets = requests.select(
        F.floor(F.col("u") * F.lit(total)).cast("long").alias("_at"), F.lit(1).alias("_kind"),
        F.col("request_id").alias("_id"), F.lit(None).cast(zones.schema["zone_id"].dataType).alias("zone_id"),
    )
    merged = carry_last(starts.unionByName(targets), [F.col("_at"), F.col("_kind"), F.col("_id")],
                        "zone_id", "_zone")
    return merged.where("_kind = 1").select(F.col("_id").alias("request_id"), F.col("_zone").alias("zone_id"))
