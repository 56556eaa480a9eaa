"""Exact inner-product search by columnar branch and bound.

Candidates lie dimension by dimension. A query adds up a block of dimensions at a time;
after each, a candidate whose sum plus the largest product of the remaining masses
(Cauchy-Schwarz) stays below the k-th best score so far is dropped and the survivors are
moved together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrosift.llm.common import parts_for, table

K, SCALE = 20, 64
#: Candidates and queries that meet in one task; both are cut into as many blocks as that takes.
CANDIDATES_PER_BLOCK, QUERIES_PER_BLOCK = 16_384, 2_048
DIMENSIONS_PER_STEP = 8
_SEEDS = 256
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class Columns:
    """Candidates in vertical layout, with the mass each has left after every step."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, step: int = DIMENSIONS_PER_STEP) -> None:
        # exact in double precision while every partial sum is below 2**53
        self.kind = np.float64 if float(np.abs(rows).max(initial=0)) ** 2 * max(1, rows.shape[1]) < 2**53 else np.int64
        energy = np.square(rows.astype(np.float64))
        self.order = np.argsort(-energy.sum(0), kind="stable")  # heavy dimensions first
        self.ids, energy = ids, energy[:, self.order]
        self.blocks = [np.ascontiguousarray(rows[:, self.order[i:i + step]].T.astype(self.kind))
                       for i in range(0, rows.shape[1], step)]
        mass = np.cumsum(energy[:, ::-1], 1)[:, ::-1]
        self.left = [np.sqrt(mass[:, i]) if i < rows.shape[1] else np.zeros(len(rows))
                     for i in range(step, rows.shape[1] + step, step)]
        self.step = step

    def best(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest scores, ties to smaller ids; the own id is left out."""
        q = query[self.order].astype(self.kind)
        masses = np.sqrt(np.append(np.cumsum(np.square(q.astype(np.float64))[::-1])[::-1], 0.0))
        alive = np.flatnonzero(self.ids != own_id)
        seeds = alive[:_SEEDS]
        least = -np.inf
        if len(seeds) >= k:
            scores = sum(q[i * self.step:(i + 1) * self.step] @ b[:, seeds] for i, b in enumerate(self.blocks))
            least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(self.blocks) else -np.inf
        sums = np.zeros(len(alive), self.kind)
        whole = len(alive) == len(self.ids)
        for i, block in enumerate(self.blocks):
            sums = sums + q[i * self.step:(i + 1) * self.step] @ (block if whole else block[:, alive])
            rest = masses[min((i + 1) * self.step, len(q))] * (self.left[i] if whole else self.left[i][alive])
            keep = sums + rest * (1 + 1e-9) + 1e-6 >= least
            if not keep.all():
                alive, sums, whole = alive[keep], sums[keep], False
        if len(alive) > 4 * k:
            edge = np.partition(sums, len(sums) - k)[len(sums) - k]
            alive, sums = alive[sums >= edge], sums[sums >= edge]
        top = np.lexsort((self.ids[alive], -sums))[:k]
        return self.ids[alive[top]], sums[top].astype(np.int64)


def _search(k: int, step: int):
    def search(rows: pa.Table) -> pa.Table:
        ids, asks = rows["id"].to_numpy(), rows["asks"].to_numpy(zero_copy_only=False)
        vectors = rows["q"].to_pylist()
        wide = max((len(v) for v in vectors), default=0) // 8
        matrix = np.zeros((len(vectors), wide), np.int64)
        for i, v in enumerate(vectors):
            matrix[i, :len(v) // 8] = np.frombuffer(v, np.int64)
        out: list[tuple] = []
        if not asks.all():
            columns = Columns(ids[~asks], matrix[~asks], step)
            for own_id, query in zip(ids[asks].tolist(), matrix[asks]):
                found, scores = columns.best(own_id, query, k)
                out.append((np.full(len(found), own_id), found, scores))
        parts = [np.concatenate(p) for p in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(p.astype(np.int64)) for p in parts], schema=_FOUND)

    return search


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
          candidates_per_block: int = CANDIDATES_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each row where ``asks`` holds.

    All rows but those of the query's id are candidates. Blocks of queries meet blocks of
    candidates, each pair in one task of bounded size, and a window merges their best.
    Vectors that are null or hold null or non-finite components take no part, nor do null
    ids; shorter vectors count as ended by zeros. A repeated id is a candidate once per row
    and its distinct vectors share one ranking. Ties go to the smaller id. Fewer than ``k``
    candidates give fewer rows, none give none; other columns are not carried.
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), quantized(F.col(vector), scale).alias("v"), asks.alias("asked"))
    own = own.where("id is not null and v is not null")

    def packed(batches):
        for batch in batches:
            rows = [np.asarray(v, np.int64).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], names=["id", "q", "asked"])

    own = own.mapInArrow(packed, "id long, q binary, asked boolean")
    n_blocks = parts_for(own, F.lit(1), candidates_per_block)
    n_chunks = parts_for(own.where("asked"), F.lit(1), queries_per_block)
    block, chunk = (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(n)) for s, n in (("block", n_blocks), ("chunk", n_chunks)))
    candidates = own.select(block.alias("block"), F.explode(_upto(n_chunks)).alias("chunk"),
                            F.lit(False).alias("asks"), "id", "q")
    queries = own.where("asked").select(F.explode(_upto(n_blocks)).alias("block"),
                                        chunk.alias("chunk"), F.lit(True).alias("asks"), "id", "q").distinct()
    found = candidates.unionByName(queries).groupBy("block", "chunk").applyInArrow(
        _search(k, DIMENSIONS_PER_STEP), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op9_topk_search": op9_topk_search}
ORACLES = {"op9_topk_search": SQL}
