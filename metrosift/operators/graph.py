"""Road-graph jobs: degrees, components, proximity clusters and shortest paths.

Iterations write each round to scratch tables, so plans stay short and a lost
executor costs at most one round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metrosift.operators.joins import BROADCAST_ROWS, fits, hot_keys, join_lookup, salted_join
from metrosift.operators.ordered import add_neighbor
from metrosift.operators.spatial import off_border
from metrosift.session import stage

MAX_ROUNDS = 60
# Two grid cells with at most this many point pairs are compared point by point.
PAIRS_PER_CELLS = 4096
# Cells on a tile's side (as a power of two), and how far a cell reaches: its side is over tolerance/2, so only the two next ones matter.
TILE_BITS, REACH = 5, 2
# Spots that one task compares, about; spots of a tile beyond which its cells are counted, and of a cell that no tile compares.
SPOTS_PER_TASK, CROWDED_TILE, CROWDED_CELL = 200_000, 32_768, 1024
# Dead ends are peeled off again while there was more than one for so many ways left.
PEEL_LEAST = 20
# Routes of up to this power of two are joined together from stretches.
PLAIN_ROUNDS = 4
# One node of so many is an anchor of longer routes; anchors and routes of a slice; slices that are tasks of their own, at most.
ANCHOR_EVERY, ANCHORS_PER_SLICE, ROUTES_PER_SLICE, MOST_SLICES = 16, 1024, 50_000, 4096
# Bytes of routes that a task gives out at once.
ROUTE_BYTES = 1 << 24


def node_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, x, y): endpoint counts and coordinates.

    ``edges``: county, from_node, to_node, from_x, from_y, to_x, to_y. A self-loop
    counts twice. The coordinate is the mean within a county; the lowest county id wins.
    """
    ends = edges.select("county", F.explode(F.array(
        *[F.struct(F.col(f"{s}_node").alias("node"), F.col(f"{s}_x").alias("x"), F.col(f"{s}_y").alias("y"))
          for s in ("from", "to")]
    )).alias("e")).select("county", "e.*").where("node > 0 AND x IS NOT NULL AND y IS NOT NULL")
    by_county = ends.groupBy("county", "node").agg(
        F.count(F.lit(1)).alias("degree"), F.avg("x").alias("x"), F.avg("y").alias("y")
    )
    return by_county.groupBy("node").agg(
        F.sum("degree").alias("degree"), F.min(F.struct("county", "x", "y")).alias("_c")
    ).select("node", "degree", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"))


def _meet(rows: DataFrame, lookup: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Join to per-node values; a hub node's rows are never sent to one task."""
    return rows.join(F.broadcast(lookup), on) if small else join_lookup(rows, lookup, on)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of undirected edges (a, b).

    Alternates the large-star and small-star steps of the published map-reduce
    algorithm, which end with every node linked to its component's lowest id after few
    rounds even on long chains and never add edges. Only minima are aggregated.
    """
    pairs = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    loops = pairs.where("u = v").select(F.col("u").alias("node"))
    links = pairs.where("u <> v")
    mark = None
    for _ in range(MAX_ROUNDS):
        size = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (size["n"], size["h"]) == mark:
            break
        mark = (size["n"], size["h"])
        small = size["n"] * 2 <= BROADCAST_ROWS
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _meet(both, low, ["u"], small).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        if not small:
            down = stage(down, "large-star")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        star = _meet(down, low, ["u"], small).where("v <> m").select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")
        ).unionByName(low.select("u", F.col("m").alias("v")))
        links = stage(star.distinct(), "links")
    else:
        raise RuntimeError("Components did not settle")
    labels = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = links.select(F.col("v").alias("node")).distinct().join(
        labels.select("node"), "node", "left_anti"
    ).withColumn("component", F.col("node"))
    known = labels.unionByName(roots)
    alone = loops.join(known.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return known.unionByName(alone)


def largest_component(edges: DataFrame) -> DataFrame:
    """(node, component) of the component with most nodes, ties to the lowest label."""
    labels = stage(components(edges), "labels")
    top = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return labels.join(F.broadcast(top.select("component")), "component", "left_semi")


def _cell_stats(points: DataFrame, side: float) -> DataFrame:
    return points.withColumn("cx", F.floor(F.col("x") / side).cast("long")).withColumn(
        "cy", F.floor(F.col("y") / side).cast("long")
    ).groupBy("g", "cx", "cy").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("rep"),
        *[f(a).alias(f"{a}{i}") for a in ("x", "y") for i, f in ((0, F.min), (1, F.max))],
    )


def close_cells(points: DataFrame, tolerance: float, side: float) -> DataFrame:
    """(a, b): representative nodes of grid cells of one ``g`` that hold points within ``tolerance``.

    Cells are compared by their bounding boxes first. Boxes wholly within or wholly
    beyond the tolerance are settled at once; cells with few pairs compare points; only
    crowded, undecided cells are cut into 4 x 4 and compared again. So the pairs looked
    at stay near-linear even when one cell holds most of the points.
    """
    root = stage(_cell_stats(points, side), "cells")
    offsets = F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
        for dx in range(-REACH, REACH + 1) for dy in range(-REACH, REACH + 1) if (dx, dy) > (0, 0)
    ])
    a = root.select("g", "cx", "cy", F.col("rep").alias("ra"), F.explode(offsets).alias("o"))
    pairs = a.select(
        "g", F.col("cx").alias("ax"), F.col("cy").alias("ay"), "ra",
        (F.col("cx") + F.col("o.dx")).alias("bx"), (F.col("cy") + F.col("o.dy")).alias("by"),
    ).join(root.select("g", F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("rep").alias("rb")), ["g", "bx", "by"])
    accepted = []
    while True:
        stats = _cell_stats(points, side)
        p, q = ({c: f"{c}_{s}" for c in ("n", "x0", "x1", "y0", "y1")} for s in ("a", "b"))
        left = stats.select("g", F.col("cx").alias("ax"), F.col("cy").alias("ay"), *[F.col(c).alias(v) for c, v in p.items()])
        right = stats.select("g", F.col("cx").alias("bx"), F.col("cy").alias("by"), *[F.col(c).alias(v) for c, v in q.items()])
        both = pairs.join(left, ["g", "ax", "ay"]).join(right, ["g", "bx", "by"])
        gap = [f"greatest(0D, {a}0_b - {a}1_a, {a}0_a - {a}1_b)" for a in ("x", "y")]
        far = [f"greatest({a}1_b - {a}0_a, {a}1_a - {a}0_b)" for a in ("x", "y")]
        both = both.withColumn("near", F.expr(f"hypot({gap[0]}, {gap[1]})")).withColumn(
            "far", F.expr(f"hypot({far[0]}, {far[1]})")
        ).where(F.col("near") <= tolerance)
        both = stage(both, "cell-pairs")
        accepted.append(both.where(F.col("far") <= tolerance).select("ra", "rb"))
        open_pairs = both.where(F.col("far") > tolerance)
        few = open_pairs.where(F.col("n_a") * F.col("n_b") <= PAIRS_PER_CELLS)
        placed = points.select("g", "x", "y", F.floor(F.col("x") / side).cast("long").alias("cx"),
                               F.floor(F.col("y") / side).cast("long").alias("cy"))
        one = placed.select("g", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("x").alias("px"), F.col("y").alias("py"))
        two = placed.select("g", F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("x").alias("qx"), F.col("y").alias("qy"))
        compared = few.select("g", "ax", "ay", "bx", "by", "ra", "rb").join(one, ["g", "ax", "ay"]).join(two, ["g", "bx", "by"]).where(
            F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2) <= tolerance**2
        )
        accepted.append(compared.select("ra", "rb"))
        crowded = open_pairs.where(F.col("n_a") * F.col("n_b") > PAIRS_PER_CELLS)
        if crowded.isEmpty():
            break
        done = accepted[0]
        for more in accepted[1:]:
            done = done.unionByName(more)
        crowded = crowded.join(done.distinct(), ["ra", "rb"], "left_anti")
        step = F.sequence(F.lit(0), F.lit(3))
        pairs = crowded.select("g", "ax", "ay", "bx", "by", "ra", "rb")
        for c in ("ax", "ay", "bx", "by"):
            pairs = pairs.withColumn("_d", F.explode(step)).withColumn(c, F.col(c) * 4 + F.col("_d")).drop("_d")
        side = side / 4
    out = accepted[0]
    for more in accepted[1:]:
        out = out.unionByName(more)
    return out.distinct().select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def _ranks(nodes: pa.Array) -> np.ndarray:
    """Each value's place in Spark's order of values, null last."""
    keys = [nodes.is_null()]

    def add(values: pa.Array) -> None:
        if pa.types.is_struct(values.type):
            for field in values.flatten():
                add(field)
        else:
            keys.extend([pc.is_valid(values), values])

    add(nodes)
    names = [str(i) for i in range(len(keys))]
    order = pc.sort_indices(pa.table(keys, names), sort_keys=[(n, "ascending") for n in names]).to_numpy()
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows with the same keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b: the least number of each component."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def _linked_cells(x: np.ndarray, y: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    """Labels of cells after linking the pairs (a, b) that hold points within ``tolerance``.

    Points are sorted by cell. Pairs of cells that are connected already are left out, so
    crowded neighbors cost a look at a few of their points.
    """
    ends = np.append(starts[1:], len(x))
    label, n = np.arange(len(starts)), ends - starts
    for most in (16, None):
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        step_a, step_b = (np.ones(len(c), np.int64) if most is None else -(-n[c] // most) for c in (a, b))
        na, nb = -(-n[a] // step_a), -(-n[b] // step_b)
        order = np.argsort(na * nb, kind="stable")
        size = np.cumsum((na * nb)[order])
        at = 0
        while at < len(order):
            until = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 21), "right")))
            some = order[at:until]
            some, at = some[label[a[some]] != label[b[some]]], until
            for part in np.split(some, range(1, len(some))) if len(some) and (na * nb)[some].max() > 1 << 21 else [some]:
                width, count = nb[part], (na * nb)[part]
                if not len(part):
                    continue
                # a pair of large cells is compared in slices
                for begin in range(0, int(count.max()) if len(part) == 1 else 1, 1 << 22):
                    own = np.repeat(np.arange(len(part)), count) if len(part) > 1 else np.zeros(min(1 << 22, int(count[0]) - begin), np.int64)
                    place = np.arange(len(own)) - (np.cumsum(count) - count)[own] + begin
                    p = starts[a[part]][own] + place // width[own] * step_a[part][own]
                    q = starts[b[part]][own] + place % width[own] * step_b[part][own]
                    near = part[own[(x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2 <= tolerance**2]]
                    label = _merged(label, a[near], b[near])
                    if len(near) and len(part) == 1:
                        break
    return label


def _tile_clusters(tolerance: float, schema: pa.Schema):
    """Clusters of cells within each tile and its rim, as (g, cx, cy, rep, label, own, linked, open)."""
    across = (1 << TILE_BITS) + 2 * REACH

    def cluster(rows: pa.Table) -> pa.Table:
        nodes = rows["node"].combine_chunks()
        tx, ty, cx, cy, x, y, near = (rows[c].to_numpy() for c in ("tx", "ty", "cx", "cy", "x", "y", "near"))
        tile = _numbered(rows["g"].combine_chunks().dictionary_encode().indices.to_numpy(), tx, ty)
        lx, ly = cx - (tx << TILE_BITS) + REACH, cy - (ty << TILE_BITS) + REACH
        code, rank = (tile * across + lx) * across + ly, _ranks(nodes)
        order = np.lexsort((rank, code))  # a cell's first point is its least node
        starts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
        first = order[starts]
        codes, lx, ly, x, y = code[first], lx[first], ly[first], x[order], y[order]
        low, high = ([f.reduceat(c, starts) for c in (x, y)] for f in (np.minimum, np.maximum))
        inner = [(c >= REACH) & (c < across - REACH) for c in (lx, ly)]
        own = inner[0] & inner[1]
        a, b = [], []
        for dx in range(REACH + 1):
            for dy in range(-REACH, REACH + 1):
                if (dx, dy) <= (0, 0):
                    continue
                one = np.flatnonzero((lx + dx < across) & (ly + dy >= 0) & (ly + dy < across))
                two = np.minimum(np.searchsorted(codes, codes[one] + dx * across + dy), len(codes) - 1)
                there = (codes[two] == codes[one] + dx * across + dy) & (own[one] | own[two])
                one, two = one[there], two[there]
                gap = [np.maximum(0.0, np.maximum(low[i][two] - high[i][one], low[i][one] - high[i][two])) for i in (0, 1)]
                close = ~(np.hypot(*gap) > tolerance * (1 + 1e-9))
                a.append(one[close])
                b.append(two[close])
        label = _linked_cells(x, y, starts, np.concatenate(a), np.concatenate(b), tolerance)
        least = np.full(len(starts), len(order))
        np.minimum.at(least, label, rank[first])
        place = np.empty(len(order), np.int64)
        place[rank] = np.arange(len(order))
        # cells that another tile sees as well, or that lie beside a crowded one
        linked = near[first] | ~own | ~np.logical_and(*[(c >= 2 * REACH) & (c < across - 2 * REACH) for c in (lx, ly)])
        open_, kept = (np.bincount(label, c, minlength=len(starts))[label] > 0 for c in (linked, own))
        told = np.flatnonzero(own | (linked & kept))
        at = pa.array(first[told])
        return pa.table([rows["g"].take(at), rows["cx"].take(at), rows["cy"].take(at), nodes.take(at), nodes.take(pa.array(place[least[label[told]]])),
                         pa.array(own[told]), pa.array(linked[told]), pa.array(open_[told])], schema=schema)

    return cluster


def cell_clusters(spots: DataFrame, tolerance: float, side: float) -> DataFrame:
    """(g, cx, cy, cluster): the lowest node of the cluster that each grid cell of ``spots`` (node, g, x, y) belongs to.

    Tiles of 32 x 32 cells, with a rim of the next two, are clustered each within a task; many tiles share one. Only
    cells that two tiles see are linked across tiles. Crowded cells stay out of tiles: ``close_cells`` compares them
    with the cells around.
    """
    keys = ["g", "cx", "cy"]
    placed = spots.select("*", *[F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in ("x", "y")])
    tile = [F.shiftright(f"c{c}", TILE_BITS).alias(f"t{c}") for c in ("x", "y")]
    full = stage(placed.groupBy("g", *tile).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED_TILE), "crowded-tiles")
    crowded = None
    if not full.isEmpty():
        counted = join_lookup(placed.select(*keys, *tile), full.select("g", "tx", "ty"), ["g", "tx", "ty"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        crowded = stage(counted.where(F.col("n") > CROWDED_CELL).select(*keys), "crowded-cells")
        crowded = None if crowded.isEmpty() else crowded
    near = placed.withColumn("near", F.lit(False))
    if crowded is not None:
        step = F.sequence(F.lit(-REACH), F.lit(REACH))
        around = crowded.select("g", "cx", "cy", F.explode(step).alias("dx")).select("*", F.explode(step).alias("dy")).select(
            "g", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"),
            ((F.col("dx") == 0) & (F.col("dy") == 0)).alias("crowded")).groupBy(*keys).agg(F.bool_or("crowded").alias("crowded"))
        near = stage(join_lookup(placed, stage(around, "around"), keys, "left"), "near-crowded")
        beside = near.where("crowded IS NOT NULL")
        near = near.where("crowded IS NULL OR NOT crowded").withColumn("near", F.col("crowded").isNotNull()).drop("crowded")
    of = {f.name: f.dataType for f in spots.schema}
    out = T.StructType([T.StructField("g", of["g"]), T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()),
                        T.StructField("rep", of["node"]), T.StructField("label", of["node"]),
                        *[T.StructField(c, T.BooleanType()) for c in ("own", "linked", "open")]])
    rows = near.select("*", *[F.sequence(F.shiftright(F.col(c) - REACH, TILE_BITS), F.shiftright(F.col(c) + REACH, TILE_BITS)).alias(f"_{c}")
                              for c in ("cx", "cy")]).select(*near.columns, F.explode("_cx").alias("tx"), "_cy").select(
        *near.columns, "tx", F.explode("_cy").alias("ty"))
    tasks = max(1, -(-spots.count() // SPOTS_PER_TASK))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("g", "tx", "ty"), F.lit(tasks)))
    found = stage(dealt.groupBy("task").applyInArrow(_tile_clusters(tolerance, to_arrow_schema(out)), out), "tile-clusters")
    links = found.where("linked").select(F.col("rep").alias("a"), F.col("label").alias("b"))
    cells = found.where("own").select(*keys, "label", "open")
    if crowded is not None:
        alone = stage(beside.where("crowded").groupBy(*keys).agg(F.min("node").alias("label")), "crowded")
        links = links.unionByName(close_cells(beside.select("node", "g", "x", "y"), tolerance, side)).unionByName(
            alone.select(F.col("label").alias("a"), F.col("label").alias("b")))
        cells = cells.unionByName(alone.withColumn("open", F.lit(True)))
    known = stage(components(links), "components").select(F.col("node").alias("label"), F.col("component").alias("cluster"))
    return cells.where("NOT open").select(*keys, F.col("label").alias("cluster")).unionByName(
        join_lookup(cells.where("open"), known, ["label"]).select(*keys, "cluster"))


def proximity_clusters(points: DataFrame, tolerance: float, by: str | None = None) -> DataFrame:
    """(node, cluster): single-link clusters of points (node, x, y) within ``tolerance``.

    With ``by``, only points of one value of that column are linked; nodes of different
    values must differ. Points in one cell of side tolerance/sqrt(2) are within reach of
    each other, so a cell has one cluster, and copies of one location collapse before
    anything is compared.
    """
    side = tolerance / 2**0.5 * (1 - 1e-12)
    points = stage(points.select("node", (F.col(by) if by else F.lit(0)).alias("g"), "x", "y").where(
        "g IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), "points")
    spots = stage(points.groupBy("g", "x", "y").agg(F.min("node").alias("node")), "spots")
    cell = [F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in ("x", "y")]
    labels = stage(cell_clusters(spots, tolerance, side), "cell-clusters")
    # The lowest node of the cluster is the lowest of its cells' lowest nodes.
    return join_lookup(points.select("node", "g", *cell), labels, ["g", "cx", "cy"]).select("node", "cluster")


def junctions(nodes: DataFrame, tolerance: float, boundary: DataFrame | None = None,
              border: float = 5.0, least_degree: int = 3) -> DataFrame:
    """Cluster nodes of degree >= 3 that the boundary covers, off its border.

    ``nodes``: node, degree, x, y. ``boundary``: shape (or ring). Gives (node, cluster);
    junctions are the clusters.
    """
    kept = nodes.where(F.col("degree") >= least_degree)
    if boundary is not None:
        kept = off_border(kept, boundary, border, "node")
    return proximity_clusters(kept.select("node", "x", "y"), tolerance)


def endpoint_junctions(ends: DataFrame, tolerance: float, boundary: DataFrame | None = None,
                       border: float = 5.0, least_edges: int = 3) -> DataFrame:
    """Endpoint clusters with at least three distinct edges and an off-border centroid.

    ``ends``: end_id, edge_id, x, y. Gives (cluster, edges, x, y).
    """
    labels = proximity_clusters(ends.select(F.col("end_id").alias("node"), "x", "y"), tolerance)
    joined = ends.join(labels.withColumnRenamed("node", "end_id"), "end_id")
    found = joined.groupBy("cluster").agg(
        F.count_distinct("edge_id").alias("edges"), F.avg("x").alias("x"), F.avg("y").alias("y")
    ).where(F.col("edges") >= least_edges)
    return off_border(found, boundary, border, "cluster") if boundary is not None else found


def contract_chains(ways: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contracted ways, chain nodes): runs of nodes with two neighbors become single ways.

    ``ways``: a, b, length, each in both directions and once. ``keep``: nodes that stay,
    besides those with other than two neighbors. Chain nodes: p, node, end, rest: coming
    from neighbor p into the node, its chain ends at ``end`` after ``rest``. Rings without
    a kept node are left out, as nothing leads into them. Every way into a chain node
    points to the one way that goes on from there; pointers double, so a chain of n nodes
    takes about log2 n rounds. Without a chain node, ``ways`` (a stored table) is given back as it is.
    """
    neighbors = ways.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    inner = stage(neighbors.where("n = 2").select("node").join(
        keep.select("node").distinct(), "node", "left_anti").withColumn("inner", F.lit(True)), "inner")
    if inner.isEmpty():
        return ways, ways.where(F.lit(False)).select(F.col("a").alias("p"), F.col("b").alias("node"), F.col("b").alias("end"), F.col("length").alias("rest"))
    marked = stage(join_lookup(ways, inner.withColumnsRenamed({"node": "b", "inner": "to_inner"}), ["b"], "left"), "marked")
    into = marked.where("to_inner").select(F.col("a").alias("p"), F.col("b").alias("node"))
    onward = join_lookup(marked, inner.withColumnsRenamed({"node": "a", "inner": "from_inner"}), ["a"]).select(
        F.col("a").alias("node"), F.col("b").alias("end"), F.col("length").alias("rest"), F.col("to_inner").isNull().alias("done"))
    steps = into.join(onward, "node").where("end <> p").select("p", "node", F.col("node").alias("from"), "end", "rest", "done")
    steps = stage(steps, "steps")
    left = steps.where("not done").count()
    # a chain has at most as many nodes as there are steps; what is open after so many doublings runs in a ring
    for _ in range(max(left, 1).bit_length() + 1):
        if not left:
            break
        further = steps.select(F.col("p").alias("from"), F.col("node").alias("end"), F.col("from").alias("_from"), F.col("end").alias("_end"),
                               F.col("rest").alias("_rest"), F.col("done").alias("_done"))
        moved = steps.where("not done").join(further, ["from", "end"]).select(
            "p", "node", F.col("_from").alias("from"), F.col("_end").alias("end"), (F.col("rest") + F.col("_rest")).alias("rest"), F.col("_done").alias("done"))
        steps = stage(steps.where("done").unionByName(moved), "steps")
        left = steps.where("not done").count()
    chains = steps.where("done").select("p", "node", "end", "rest")
    outer = join_lookup(marked, inner.withColumnsRenamed({"node": "a", "inner": "_x"}), ["a"], "left_anti")
    plain = outer.where("to_inner IS NULL").select("a", "b", "length")
    through = outer.where("to_inner").join(chains.withColumnsRenamed({"p": "a", "node": "b"}), ["a", "b"]).where("end <> a").select(
        "a", F.col("end").alias("b"), (F.col("length") + F.col("rest")).alias("length"))
    return stage(plain.unionByName(through).groupBy("a", "b").agg(F.min("length").alias("length")), "contracted"), chains


def peel_leaves(ways: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways left, leaves): nodes with one neighbor go, but for those of ``keep``; leaves: leaf, at, length.

    ``ways``: a, b, length, each in both directions and once. Only one layer is taken.
    """
    ends = ways.groupBy(F.col("a").alias("leaf")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("b").alias("at"), F.min("length").alias("length")).where("_n = 1").drop("_n")
    leaves = stage(ends.join(keep.select(F.col("node").alias("leaf")).distinct(), "leaf", "left_anti"), "leaves")
    if leaves.isEmpty():
        return ways, leaves
    left = ways
    for end in ("a", "b"):
        left = join_lookup(left, leaves.select(F.col("leaf").alias(end)), [end], "left_anti")
    return stage(left.select("a", "b", "length"), "peeled"), leaves


def _least_costs(ways: DataFrame, sources: DataFrame, limit: int | float | None) -> DataFrame:
    """(source, node, cost): least costs over ``ways``, each round from the nodes whose cost just fell.

    Only improvements are written. What a round finds is compared with the earlier
    improvements of the same nodes; pieces are merged now and then.
    """
    few_ways, hot = ways.count() <= BROADCAST_ROWS, None
    zero = F.lit(0).cast(dict(ways.dtypes)["length"])
    fresh = stage(sources.select("source", F.col("source").alias("node"), zero.alias("cost")).distinct(), "reached")
    pieces, n = [fresh], fresh.count()

    def known() -> DataFrame:
        out = pieces[0]
        for more in pieces[1:]:
            out = out.unionByName(more)
        return out

    while n:
        edge = fresh.select("source", F.col("node").alias("a"), "cost")
        if few_ways:
            step = edge.join(F.broadcast(ways), "a")
        elif n <= BROADCAST_ROWS:
            step = ways.join(F.broadcast(edge), "a")
        else:
            hot = stage(hot_keys(ways, ["a"]), "hot-ways") if hot is None else hot
            step = salted_join(ways, edge, ["a"], F.col("b"), hot=hot)
        found = step.select("source", F.col("b").alias("node"), (F.col("cost") + F.col("length")).alias("cost"))
        if limit is not None:
            found = found.where(F.col("cost") <= limit)
        found = stage(found.groupBy("source", "node").agg(F.min("cost").alias("cost")), "found")
        before = join_lookup(known(), found.select("source", "node"), ["source", "node"], "left_semi").groupBy("source", "node").agg(
            F.min("cost").alias("before"))
        fresh = stage(found.join(before, ["source", "node"], "left").where("before IS NULL OR cost < before").drop("before"), "reached")
        n = fresh.count()
        pieces.append(fresh)
        if len(pieces) > 8:
            pieces[:] = [stage(known().groupBy("source", "node").agg(F.min("cost").alias("cost")), "merged")]
    return known().groupBy("source", "node").agg(F.min("cost").alias("cost"))


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: int | float | None = None) -> DataFrame:
    """(source, node, cost, previous): cheapest paths from many sources at once.

    ``edges``: a, b, length > 0, used both ways. Costs over ``limit`` are cut. Chains of
    nodes with two neighbors are contracted and dead ends peeled off in turns first, which
    takes a tree of n nodes about log2 n turns, so rounds follow the junctions of what has
    no dead ends. Then turns are undone, the last one first: a dead end's cost comes from its
    neighbor, a chain node's from the nearer way to its ends. ``previous`` is the neighbor the
    path comes from, the lowest of equally good ones, and null at the source.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length").where("a <> b").groupBy("a", "b").agg(
        F.min("length").alias("length"))
    ways = stage(pairs.select(F.explode(F.array(F.struct("a", "b", "length"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "length"))).alias("w")).select(
        "w.*"), "ways")
    keep = sources.select(F.col("source").alias("node"))
    core, turns = ways, []
    while True:
        core, chains = contract_chains(core, keep)
        core, leaves = peel_leaves(core, keep)
        turns.append((chains, leaves))
        # few dead ends are left out of further turns: the rounds below reach them as well
        if leaves.count() * PEEL_LEAST <= core.count():
            break
    costs = stage(_least_costs(core, sources, limit), "costs")
    for chains, leaves in reversed(turns):
        for inner, name in ((leaves.select("at", F.col("leaf").alias("node"), F.col("length").alias("rest")), "leaf-costs"),
                            (chains.select(F.col("end").alias("at"), "node", "rest"), "costs")):
            if inner.isEmpty():
                continue
            inside = salted_join(inner, costs.withColumnRenamed("node", "at"), ["at"], F.col("node")).select(
                "source", "node", (F.col("cost") + F.col("rest")).alias("cost"))
            if limit is not None:
                inside = inside.where(F.col("cost") <= limit)
            costs = stage(costs.unionByName(inside.groupBy("source", "node").agg(F.min("cost").alias("cost"))), name)
    reached = costs.select("source", F.col("node").alias("a"), "cost")
    step = ways.join(F.broadcast(reached), "a") if fits(reached) else salted_join(ways, reached, ["a"], F.col("b"))
    before = step.select("source", F.col("b").alias("node"), F.struct((F.col("cost") + F.col("length")).alias("cost"), F.col("a").alias("a")).alias("_m"))
    before = before.groupBy("source", "node").agg(F.min("_m")["a"].alias("_a"))
    at_source = F.col("node") == F.col("source")
    return costs.join(before, ["source", "node"], "left").select("source", "node", "cost", F.when(~at_source, F.col("_a")).alias("previous"))


def _longer(known: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows of ``open_`` with the stretch that ends at their head before their own."""
    ahead = known.select("source", F.col("node").alias("head"), F.col("head").alias("_head"), F.col("route").alias("_route"))
    return join_lookup(open_, ahead, ["source", "head"]).select(
        *[F.col("_head").alias("head") if c == "head" else F.concat("_route", "route").alias("route") if c == "route" else F.col(c) for c in open_.columns])


def _listed(anchors: DataFrame) -> DataFrame:
    """(source, node, at, after, depth): places in a depth-first walk of the trees that ``anchors`` (source, node, head) form.

    A node is entered and left. ``at`` and ``after`` count the nodes that are entered from there on, so a node's
    descendants have an ``at`` between its own and its ``after``. Links to the next step double, as ranks of lists do.
    """
    beside = add_neighbor(anchors.where("head IS NOT NULL").select("source", "head", "node"),
                          [F.col(c) for c in ("source", "head", "node")], ["source", "head", "node"], "_next")
    same = (F.col("_next.source") == F.col("source")) & (F.col("_next.head") == F.col("head"))
    beside = beside.select("source", "node", F.when(same, F.col("_next.node")).alias("beside"))
    below = anchors.where("head IS NOT NULL").groupBy("source", F.col("head").alias("node")).agg(F.min("node").alias("below"))
    nodes = anchors.select("source", "node", "head").join(below, ["source", "node"], "left").join(beside, ["source", "node"], "left")
    enter = F.struct(F.lit(False).alias("left"), F.coalesce("below", "node").alias("next"), F.col("below").isNull().alias("leaves"),
                     F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("deeper"))
    leave = F.struct(F.lit(True).alias("left"), F.coalesce("beside", "head").alias("next"), F.col("beside").isNull().alias("leaves"),
                     F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("deeper"))
    steps = stage(nodes.select("source", "node", F.explode(F.array(enter, leave)).alias("s")).select("source", "node", "s.*"), "steps")
    while not steps.where("next IS NOT NULL").isEmpty():
        further = steps.select("source", F.col("node").alias("next"), F.col("left").alias("leaves"), F.col("next").alias("_next"),
                               F.col("leaves").alias("_leaves"), F.col("n").alias("_n"), F.col("deeper").alias("_deeper"))
        moved = steps.where("next IS NOT NULL").join(further, ["source", "next", "leaves"]).select(
            "source", "node", "left", F.col("_next").alias("next"), F.col("_leaves").alias("leaves"),
            (F.col("n") + F.col("_n")).alias("n"), (F.col("deeper") + F.col("_deeper")).alias("deeper"))
        steps = stage(steps.where("next IS NULL").unionByName(moved), "steps")
    return steps.groupBy("source", "node").agg(F.min(F.when(~F.col("left"), F.col("n"))).alias("at"), F.min(F.when(F.col("left"), F.col("n"))).alias("after"),
                                               (-F.min(F.when(~F.col("left"), F.col("deeper")))).alias("depth"))


def _told(names: list[str], text: str | None, kind: pa.DataType):
    """Whole routes, a few at a time, from anchors and nodes in the order of a walk; only the route to the present anchor is held."""
    between = text.encode() if text is not None else None

    def after(held, more):
        if between is None:
            return more if held is None else pa.concat_arrays([held, more])
        return more if held is None else held + between + more

    def column(found: list) -> pa.Array:
        ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
        if between is None:
            return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(found)).cast(kind)
        return pa.StringArray.from_buffers(len(found), pa.py_buffer(ends), pa.py_buffer(b"".join(found)))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ends = None, None, []
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("source", "slice", "salt")]))
            depth, opens = (batch.column(c).to_pylist() for c in ("depth", "opens"))
            part = batch.column("route")
            stretch = part.cast(pa.binary()).to_pylist() if between is not None else [p.values if p.is_valid else None for p in part]
            found, rows, size = [], [], 0
            for i, own in enumerate(keys):
                if own != key:
                    key, held, ends = own, None, []
                if opens[i]:
                    del ends[depth[i]:]
                    held = after(held[:ends[-1]] if ends else None, stretch[i])
                    ends.append(len(held))
                    continue
                found.append(held if stretch[i] is None else after(held, stretch[i]))
                rows.append(i)
                size += found[-1].nbytes if between is None else len(found[-1])
                if size >= ROUTE_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(rows)).columns, column(found)], [*names, "route"])
                    found, rows, size = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(rows)).columns, column(found)], [*names, "route"])

    return tell


def _deep_routes(ahead: DataFrame, names: list[str], text: str | None) -> DataFrame:
    """Whole routes, written by no round and no shuffle.

    One node of ``ANCHOR_EVERY`` and the sources are anchors. A node keeps the stretch from the anchor above it; the
    anchors' own stretches are brought into the order of a depth-first walk and cut into slices. A task holds the route to
    the anchor it has reached and gives out the routes of the nodes below it; a slice begins with the anchors above its first.
    """
    def anchor(node):
        return F.pmod(F.xxhash64(F.col("source"), node), F.lit(ANCHOR_EVERY)) == 0

    whole = "source IS NOT NULL AND node IS NOT NULL"
    odd, ahead = ahead.where(f"NOT ({whole})"), ahead.where(whole)
    # a stretch ends at the last anchor before its node
    marks = F.transform("route", lambda n, i: F.when(anchor(n) | (F.col("head").isNull() & (i == 0)), i + 1).otherwise(0))
    ahead = ahead.withColumn("_at", F.array_max(F.concat(F.array(F.lit(0)), F.slice(marks, 1, F.size("route") - 1))))
    ahead = stage(ahead.withColumns({"head": F.when(F.col("_at") > 0, F.get("route", F.col("_at") - 1)).otherwise(F.col("head")),
                                     "route": F.slice("route", F.col("_at") + 1, F.size("route") - F.col("_at"))}).drop("_at"), "routes")
    done = F.col("head").isNull() | anchor(F.col("head"))
    while True:
        open_ = ahead.where(~done)
        ends = stage(open_.select("source", F.col("head").alias("node")).distinct(), "heads")
        # heads without a way before them are sources: anchors as well
        roots = join_lookup(ahead.where("head IS NULL"), ends, ["source", "node"], "left_semi").select("source", F.col("node").alias("head"))
        going = stage(join_lookup(open_, roots, ["source", "head"], "left_anti"), "going")
        if going.isEmpty():
            break
        stopped = ahead.where(done).unionByName(join_lookup(open_, roots, ["source", "head"], "left_semi"))
        ahead = stage(stopped.unionByName(_longer(ahead, going).select(ahead.columns)), "routes")

    anchors = ahead.where(anchor(F.col("node")) | F.col("head").isNull())
    listed = stage(_listed(stage(anchors.select("source", "node", "head"), "anchors")), "listed")
    if text is None:
        written = F.when(F.size("route") > 0, F.col("route"))
    else:
        written = F.when(F.size("route") > 0, F.array_join(F.transform("route", lambda n: n.cast("string")), text))
    slice_ = F.floor(F.col("at") / ANCHORS_PER_SLICE)
    own = anchor(F.col("node")) | F.col("head").isNull()
    below = ahead.withColumns({"_anchor": F.when(own, F.col("node")).otherwise(F.col("head")), "_part": F.when(~own, written)})
    below = join_lookup(below.select(*names, "_anchor", F.col("_part").alias("route")),
                        listed.select("source", F.col("node").alias("_anchor"), "at", "depth"), ["source", "_anchor"]).withColumn("slice", slice_)
    tasks = stage(below.groupBy("source", "slice").agg(F.ceil(F.count(F.lit(1)) / ROUTES_PER_SLICE).cast("int").alias("salts")), "slices")
    below = join_lookup(below, tasks, ["source", "slice"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    first = F.floor((F.col("after") + 1) / ANCHORS_PER_SLICE)
    above = anchors.select("source", "node", written.alias("route")).join(listed, ["source", "node"])
    above = above.withColumn("slice", F.explode(F.sequence(F.least(first, slice_), slice_)))
    above = join_lookup(above, tasks, ["source", "slice"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    parts = tasks.agg(F.sum("salts")).first()[0] or 1
    keys = ["source", "slice", "salt"]
    rows = below.withColumn("opens", F.lit(False)).unionByName(above.withColumn("opens", F.lit(True)), allowMissingColumns=True).select(
        *dict.fromkeys([*keys, "at", "depth", "opens", *names, "route"]))
    rows = rows.repartition(max(min(parts, MOST_SLICES), ahead.sparkSession.sparkContext.defaultParallelism), *keys)
    rows = rows.sortWithinPartitions(*keys, F.col("at").desc(), F.col("opens").desc())
    out = T.StructType([*[ahead.schema[c] for c in names], T.StructField("route", T.StringType() if text is not None else ahead.schema["route"].dataType)])
    told = rows.mapInArrow(_told(names, text, to_arrow_schema(out).field("route").type), out)
    return told.unionByName(odd.select(*names, "route" if text is None else F.array_join(F.transform("route", lambda n: n.cast("string")), text).alias("route")))


def routes(paths: DataFrame, also: Sequence[str] = (), text: str | None = None) -> DataFrame:
    """(source, node, route): all nodes from the source to the node, read back from ``previous``.

    ``also`` names columns of ``paths`` that come along; with ``text``, a route is one string of its nodes with ``text``
    between them. Every row knows a stretch of its route; stretches are joined to the one that ends where they begin.
    Routes of over 2 ** ``PLAIN_ROUNDS`` nodes are written from one walk instead, as whole routes grow with the square of the nodes.
    """
    names = ["source", "node", *also]
    ahead = stage(paths.select(*names, F.col("previous").alias("head"), F.array("node").alias("route")), "routes")
    for _ in range(PLAIN_ROUNDS):
        open_ = ahead.where("head IS NOT NULL")
        if open_.isEmpty():
            break
        ahead = stage(ahead.where("head IS NULL").unionByName(_longer(ahead, open_).select(ahead.columns)), "routes")
    if not ahead.where("head IS NOT NULL").isEmpty():
        return _deep_routes(ahead, names, text)
    route = F.col("route") if text is None else F.array_join(F.transform("route", lambda n: n.cast("string")), text)
    return ahead.select(*names, route.alias("route"))
