"""Nearest reference vectors by weighted Euclidean distance.

References that are counted to be few travel inside the plan as one constant array
and every row is matched where it lies: no shuffle, no join, no pair rows. Beyond
that size they are cut into blocks by a k-d tree. A row visits its nearest block first
and then only blocks whose box may hold something as near as what it has found.
Distances are the same sums in the same order everywhere, so both ways agree bit by bit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrosift.session import stage

REFERENCES_IN_PLAN = 512
# Vectors at least this long are compared as Arrow batches instead of expressions.
WIDE_VECTOR = 16
# Vectors of a block, about; blocks grow where there would be more than MAX_BLOCKS, whose boxes every task holds. Rows
# are sent to each block they visit, so large blocks spare vectors without structure, which visit all.
BLOCK_VECTORS = 16_384
MAX_BLOCKS = 16_384
# Vectors the tree's splits are taken from, at most about; blocks, boxes and matches cover all.
SPLIT_SAMPLE = 65_536
# Rows that meet a block in one task; more are spread over tasks. Rows that travel to a block as one matrix.
VISITS_PER_TASK = 50_000
PACKED_ROWS = 256
_SHAPE = "array<struct<v: array<double>, m: array<struct<r: string, e: string>>>>"
MATCH = "array<struct<reference_id: string, entity_id: string, distance: double, similarity: double>>"


def group_references(references: DataFrame, vector: Column) -> DataFrame:
    """(v, m): equal vectors collapse to one row listing their ids in order.

    Only the two lowest ids of different entities matter for any candidate: the lowest,
    and, for a candidate that is the entity of the lowest, the lowest of another entity.
    So a group of copies of any size is cut to two rows before it is collected.
    """
    rows = references.select(F.col("reference_id").alias("r"), F.col("entity_id").alias("e"),
                             vector.alias("v"))
    lowest = rows.groupBy("v", "e").agg(F.min("r").alias("r"))
    by_vector = Window.partitionBy("v").orderBy("r")
    kept = lowest.withColumn("_k", F.row_number().over(by_vector)).where("_k <= 2")
    return kept.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("r", "e"))).alias("m"))


def _best(blocks: str, vector: str, entity: str, weights: Sequence[float], k: int) -> Column:
    """Top-k matches of one row against a column of (v, m) groups, self removed."""
    squares = " + ".join(
        f"{float(w)!r}D * ({vector}[{i}] - g.v[{i}]) * ({vector}[{i}] - g.v[{i}])"
        for i, w in enumerate(weights)
    )
    measured = (
        f"transform({blocks}, g -> named_struct('distance', sqrt({squares}), "
        f"'m', get(filter(g.m, m -> NOT (m.e <=> {entity})), 0)))"
    )
    flat = (
        f"transform(filter({measured}, x -> x.m IS NOT NULL), x -> named_struct("
        "'distance', x.distance, 'reference_id', x.m.r, 'entity_id', x.m.e))"
    )
    return F.expr(
        f"transform(slice(sort_array({flat}), 1, {k}), x -> named_struct('reference_id', x.reference_id, "
        "'entity_id', x.entity_id, 'distance', x.distance, 'similarity', (1 - least(1D, x.distance)) * 100))"
    )


def distances(x: np.ndarray, y: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Distance of every row of x to every row of y, summed dimension by dimension as the expressions do."""
    total = np.zeros((len(x), len(y)))
    for i, w in enumerate(weights):
        gap = x[:, i, None] - y[None, :, i]
        total = total + float(w) * gap * gap if i else float(w) * gap * gap
    return np.sqrt(total)


def _best_arrays(sample: list, weights: Sequence[float], k: int):
    """The same match as an Arrow-batched function, for vectors too long for expressions.

    One batch is one matrix; distances are plain differences, so equal vectors are at
    distance exactly zero.
    """
    refs = sorted(sample, key=lambda g: g["m"][0]["r"])
    matrix = np.array([list(g["v"]) for g in refs], dtype=float).reshape(len(refs), len(weights))
    members = [[(m["r"], m["e"]) for m in g["m"]] for g in refs]
    @F.pandas_udf(MATCH)
    def match(vectors: pd.Series, entities: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.empty((0, len(weights)))
        d = distances(x, matrix, weights)
        # The walk in distance order stops once k are found and no tie is left.
        order = np.argsort(d, axis=1, kind="stable")
        out = []
        for i, entity in enumerate(entities):
            found = []
            for j in order[i]:
                if len(found) >= k and d[i, j] > found[k - 1][0]:
                    break
                other = next((m for m in members[j] if m[1] != entity), None)
                if other:
                    found.append((float(d[i, j]), *other))
            found.sort()
            out.append([
                {"reference_id": r, "entity_id": e, "distance": z, "similarity": (1 - min(1.0, z)) * 100}
                for z, r, e in found[:k]
            ])
        return pd.Series(out)

    return match


def add_matches(
    candidates: DataFrame, groups: DataFrame, vector: Column, weights: Sequence[float],
    k: int = 3, name: str = "matches", limit: int = REFERENCES_IN_PLAN,
) -> DataFrame:
    """Up to ``k`` nearest references per row as an array of structs, nearest first.

    ``candidates`` has a unique ``entity_id``. Ties go to the lower reference id.
    """
    sample = groups.limit(limit + 1).collect()
    if len(sample) <= limit and len(weights) >= WIDE_VECTOR:
        return candidates.withColumn(name, _best_arrays(sample, weights, k)(vector, F.col("entity_id")))
    if len(sample) <= limit:
        text = json.dumps([
            {"v": list(g["v"]), "m": [{"r": m["r"], "e": m["e"]} for m in g["m"]]} for g in sample
        ])
        prepared = candidates.withColumns({"_vector": vector, "_refs": F.from_json(F.lit(text), _SHAPE)})
        return prepared.withColumn(name, _best("_refs", "_vector", "entity_id", weights, k)).drop("_vector", "_refs")

    found = tree_matches(candidates.select("entity_id", vector.alias("v")), groups, weights, k)
    return (
        candidates.join(found.select("entity_id", F.col("matches").alias(name)), "entity_id", "left")
        .withColumn(name, F.coalesce(name, F.array().cast(MATCH)))
    )


# ---- a k-d tree of blocks --------------------------------------------------------

class SplitTree:
    """Splits of a k-d tree: where a vector goes left (value <= threshold) or right, down to a block number."""

    def __init__(self, sample: np.ndarray, weights: Sequence[float], n_blocks: int) -> None:
        self.dim, self.threshold, self.left, self.right, self.blocks = [], [], [], [], 0
        scale = np.sqrt(np.array(weights, dtype=float))
        self._grow(sample, scale, max(1, -(-len(sample) // n_blocks)))
        self.arrays = tuple(np.array(a) for a in (self.dim, self.threshold, self.left, self.right))

    def _grow(self, rows: np.ndarray, scale: np.ndarray, size: int) -> int:
        node = len(self.dim)
        for column, value in ((self.dim, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1)):
            column.append(value)
        spread = (rows.max(0) - rows.min(0)) * scale if len(rows) else np.zeros(len(scale))
        if len(rows) <= size or not spread.max() > 0:
            self.left[node], self.blocks = self.blocks, self.blocks + 1
            return node
        dim = int(spread.argmax())
        values = np.sort(rows[:, dim])
        at = values[(len(values) - 1) // 2]
        at = at if at < values[-1] else values[np.searchsorted(values, values[-1], "left") - 1]
        low = rows[:, dim] <= at
        self.dim[node], self.threshold[node] = dim, float(at)
        self.left[node] = self._grow(rows[low], scale, size)
        self.right[node] = self._grow(rows[~low], scale, size)
        return node

    def block_of(self, x: np.ndarray) -> np.ndarray:
        dim, threshold, left, right = self.arrays
        at = np.zeros(len(x), np.int64)
        inner = dim[at] >= 0
        while inner.any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, dim[node]] <= threshold[node], left[node], right[node])
            inner[rows] = dim[at[rows]] >= 0
        return left[at]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def box_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Least distance from each row of x to each box; never above that to a point within, in the last bit either."""
    total = np.zeros((len(x), len(low)))
    for i, w in enumerate(weights):
        gap = np.maximum(0.0, np.maximum(low[None, :, i] - x[:, i, None], x[:, i, None] - high[None, :, i]))
        total = total + float(w) * gap * gap if i else float(w) * gap * gap
    return np.sqrt(total)


def _may_be_near(x: np.ndarray, y: np.ndarray, limits: np.ndarray, weights: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): every pair that can be within the row's limit and among its ``k`` + 1 nearest.

    Squared distances come from one matrix product; pairs within its rounding error stay.
    """
    scale = np.sqrt(np.array(weights, dtype=float))
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = x * scale, y * scale
        square_a, square_b = (a * a).sum(1), (b * b).sum(1)
        slack = 8 * np.finfo(float).eps * (len(weights) + 8) * (square_a + (square_b.max() if len(b) else 0.0))
        squares = square_b[None, :] - 2 * (a @ b.T) + square_a[:, None]
        edge = limits * limits * (1 + 1e-12) + slack
        loose = np.flatnonzero((squares <= edge[:, None]).sum(1) > 4 * (k + 1)) if len(b) > k + 1 else np.array([], int)
        if len(loose):
            edge[loose] = np.fmin(edge[loose], np.partition(squares[loose], k, axis=1)[:, k] + 2 * slack[loose])
        return np.nonzero(~(squares > edge[:, None]))


def _visit(weights: Sequence[float], k: int):
    """Best ``k`` of one block for each row that visits it, if no farther than the row's limit."""
    schema = pa.schema([("entity_id", pa.string()), ("distance", pa.float64()), ("reference_id", pa.string()), ("other", pa.string())])
    dims = len(weights)

    def visit(rows: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and block.num_rows:
            groups = block["m"].combine_chunks()
            y = _matrix(block["v"].combine_chunks(), dims)
            step = max(1, (1 << 21) // len(y))
            for r in range(rows.num_rows):
                entities = rows["ids"][r].values
                x, limits = (np.frombuffer(rows[c][r].as_py(), float) for c in ("x", "limits"))
                x = x.reshape(-1, dims)
                for begin in range(0, len(x), step):
                    row, at = _may_be_near(x[begin:begin + step], y, limits[begin:begin + step], weights, k)
                    row = row + begin
                    total = np.zeros(len(row))
                    for i, w in enumerate(weights):  # the sums of ``distances``
                        gap = x[row, i] - y[at, i]
                        total = total + float(w) * gap * gap if i else float(w) * gap * gap
                    near = np.sqrt(total)
                    kept = np.flatnonzero(near <= limits[row])
                    if not len(kept):
                        continue
                    order = kept[np.lexsort((near[kept], row[kept]))]
                    names = entities.take(pa.array(row[order])).to_pylist()
                    members, found, last = groups.take(pa.array(at[order])).to_pylist(), [], -1
                    for own, name, distance, group in zip(row[order].tolist(), names, near[order].tolist(), members):
                        if own != last:
                            out += sorted(found, key=lambda f: f[1:])[:k]
                            found, last = [], own
                        # at most one vector has no member left for the row's own entity
                        other = next(((m["r"], m["e"]) for m in group if m["e"] != name), None)
                        if other:
                            found.append((name, distance, *other))
                    out += sorted(found, key=lambda f: f[1:])[:k]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else
                        [pa.array([], f.type) for f in schema], schema=schema)

    return visit


def tree_matches(candidates: DataFrame, groups: DataFrame, weights: Sequence[float], k: int = 3) -> DataFrame:
    """(entity_id, matches, visited): the ``k`` nearest references of each row, and the blocks it had to look at.

    ``candidates``: entity_id (unique), v; rows with a null vector or component are left
    out. ``groups``: v, m as of ``group_references``. Rounds of 1, 4, 16, ... further blocks in order
    of their boxes' distance go on until every other box is farther than the ``k``-th match.
    """
    spark, dims = candidates.sparkSession, len(weights)
    groups = stage(groups, "reference-vectors")
    total = groups.count()
    n_blocks = min(MAX_BLOCKS, -(-total // BLOCK_VECTORS))
    share = F.pmod(F.xxhash64("v", F.lit("split")), F.lit(max(1, -(-total // SPLIT_SAMPLE)))) == 0
    sample = np.array([r["v"] for r in groups.where(share).select("v").collect()], dtype=float).reshape(-1, dims)
    tree = spark.sparkContext.broadcast(SplitTree(sample, weights, n_blocks))

    @F.pandas_udf("long")
    def block_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(tree.value.block_of(np.stack([np.asarray(v, dtype=float) for v in vectors])) if len(vectors) else np.empty(0, int))

    blocks = stage(groups.withColumn("block", block_of("v")), "blocks")
    edges = blocks.groupBy("block").agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max))])
    found = sorted(edges.collect())  # a row for each block, at most MAX_BLOCKS
    numbers = np.array([r["block"] for r in found])
    low, high = (np.array([[r[f"{n}{i}"] for i in range(dims)] for r in found], dtype=float) for n in "ab")
    boxes = spark.sparkContext.broadcast((numbers, low, high))

    def visits(step: int):
        @F.pandas_udf("array<long>")
        def plan(vectors: pd.Series, limits: pd.Series, seen: pd.Series) -> pd.Series:
            own, a, b = boxes.value
            out = []
            some = max(1, (1 << 20) // max(1, len(own)))
            for begin in range(0, len(vectors), some):
                rows = slice(begin, begin + some)
                least = box_distances(np.stack([np.asarray(v, dtype=float) for v in vectors.iloc[rows]]), a, b, weights)
                order = np.argsort(least, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(own))[None, :].repeat(len(order), 0), 1)
                first = seen.to_numpy()[rows, None]
                go = (place >= first) & (place < first + step) & (least <= limits.to_numpy()[rows, None])
                out += [own[g] for g in go]
            return pd.Series(out, dtype=object)

        return plan

    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.string())), ("x", pa.binary()), ("limits", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Visitors of one block as small matrices, so that no row of a shuffle is large."""
        for batch in batches:
            ids, go = batch.column(0), batch.column(3)
            x, limits, block = _matrix(batch.column(1), dims), batch.column(2).to_numpy(), go.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), go.value_lengths().to_numpy())
            order = np.argsort(block, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(block[order]) != 0)), len(order)) if len(order) else [0]
            for begin, end in zip(edges[:-1], edges[1:]):
                for at in range(begin, end, PACKED_ROWS):
                    some = row[order[at:min(at + PACKED_ROWS, end)]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block[order[begin]]], pa.int64()), pa.array([ids.take(pa.array(some)).to_pylist()], pa.list_(pa.string())),
                        pa.array([x[some].tobytes()], pa.binary()), pa.array([limits[some].tobytes()], pa.binary())], schema=schema)

    complete = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    state = candidates.where(complete).select(
        F.col("entity_id").cast("string").alias("entity_id"), F.col("v").cast("array<double>").alias("v"), F.lit(float("inf")).alias("limit"),
        F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("visited"),
        F.expr("cast(array() AS array<struct<distance: double, reference_id: string, other: string>>)").alias("best"))
    names, done, step = state.columns, [], 1
    while True:
        # a row that has no block near enough has none further out either
        state = stage(state.withColumn("go", visits(step)("v", "limit", "seen")), "match-state")
        done.append(state.where("size(go) = 0").select(names))
        going = state.where("size(go) > 0")
        heat = going.select(F.explode("go").alias("block")).groupBy("block").agg(
            F.ceil(F.count(F.lit(1)) / VISITS_PER_TASK).cast("int").alias("salts"))
        heat = F.broadcast(stage(heat, "heat"))  # a row for each block
        if heat.isEmpty():
            break
        asked = going.select("entity_id", "v", "limit", "go").mapInArrow(pack, "block long, ids array<string>, x binary, limits binary")
        left = asked.join(heat, "block").withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("salts")).cast("int"))
        right = blocks.join(heat, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        near = left.select("block", "salt", "ids", "x", "limits").groupBy("block", "salt").cogroup(
            right.select("block", "salt", "v", "m").groupBy("block", "salt")).applyInArrow(
            _visit(weights, k), "entity_id string, distance double, reference_id string, other string")
        met = near.groupBy("entity_id").agg(F.collect_list(F.struct("distance", "reference_id", "other")).alias("_met"))
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("_met", F.expr("cast(array() AS array<struct<distance: double, reference_id: string, other: string>>)")))), 1, k)
        limit = F.when(F.size("best") >= k, F.element_at("best", k)["distance"]).otherwise(F.lit(float("inf")))
        state = going.join(met, "entity_id", "left").select(
            "entity_id", "v", (F.col("seen") + step).alias("seen"), (F.col("visited") + F.size("go")).alias("visited"),
            best.alias("best")).withColumn("limit", limit).select(names)
        step *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("entity_id", "visited", F.expr(
        "transform(best, x -> named_struct('reference_id', x.reference_id, 'entity_id', x.other, 'distance', x.distance, "
        "'similarity', (1 - least(1D, x.distance)) * 100))").alias("matches"))
