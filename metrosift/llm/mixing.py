"""Mixing sources to target weights, with DataFrame and SQL functions only.

A source's documents are permuted by a digest and cut into blocks of neighbours. A
splitting tree deals the drawn blocks among output shards: at each node every source's
quota is split by a multivariate hypergeometric draw, so that each half is what a random
half of all blocks would hold, while quotas stay exact. A shard then gets its own run of
each source's permuted blocks and orders its documents by another digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrosift.llm.common import WORD, table
from metrosift.session import stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SEED = 1.5, 2.0, 42
#: Documents of a block, about; words of an output shard, about.
PER_BLOCK, PER_SHARD = 256, 4_000_000
#: Sources are sent to every task up to this many; beyond, they are joined by shuffling.
MAX_BROADCAST_SOURCES = 10_000


def target_words(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size; one row each) with rank and target added.

    Sources in code point order, null last, take ``weights`` in turn. Together they get
    ``share`` of all words; no target passes ``cap`` times its source, and what is cut
    off goes to the others by weight. Sorted by cap / weight, the capped ones come first,
    so the level of the rest follows from running sums over the few source rows.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    every, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("__ratio", "rank")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("__weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", cap * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum(
        "__weight").over(onward)
    leveled = ranked.withColumn("__level", level)
    free = leveled.withColumn("__free", F.min(F.when(F.col("__ratio") > F.col("__level"), F.struct("__ratio", "rank", "__level")))
                              .over(every)["__level"])
    target = F.coalesce(F.least("__cap", F.col("__free") * F.col("__weight")), F.col("__cap"))
    return free.withColumn("target", target).select("source", "source_size", "__docs", "rank", "target")


def _split(seed: int) -> str:
    """SQL for one draw of a node: how much of each source's quota goes left.

    Sources are drawn one after another from what is left of total and room, each by
    inverting the hypergeometric distribution within 12 standard deviations of its mean.
    """
    ratio = "((q - x) * 1D * (room - x)) / ((x + 1D) * (total - q - room + x + 1D))"
    for name, value in (("room", "s.room"), ("total", "s.total")):
        ratio = ratio.replace(name, value)
    mean = "(s.room * 1D * q / s.total)"
    spread = f"(12 * sqrt({mean} * (1 - q * 1D / s.total)) + 2)"
    low = f"greatest(0L, s.room - (s.total - q), cast(floor({mean} - {spread}) as bigint))"
    high = f"least(q, s.room, cast(ceil({mean} + {spread}) as bigint))"
    uniform = f"(pmod(xxhash64({seed}, node, size(s.out)), 9007199254740992L) / 9007199254740992D)"
    whole = (f"aggregate(sequence({low}, {high}), named_struct('w', 1D, 'sum', 0D), (a, x) -> "
             f"named_struct('w', a.w * {ratio}, 'sum', a.sum + a.w), a -> a.sum)")
    picked = (f"aggregate(sequence({low}, {high}), named_struct('w', 1D, 'left', {uniform} * {whole}, 'x', {low}), (a, x) -> "
              f"named_struct('w', a.w * {ratio}, 'left', a.left - a.w, 'x', if(a.left > 0, x, a.x)), a -> a.x)")
    draw = f"if(q = 0 or s.room = 0, 0L, if(s.room >= s.total, q, {picked}))"
    return (
        "aggregate(quotas, named_struct('total', aggregate(quotas, 0L, (t, q) -> t + q), "
        "'room', aggregate(quotas, 0L, (t, q) -> t + q) div 2, 'out', cast(array() as array<bigint>)), "
        f"(s, q) -> aggregate(array({draw}), s, (s2, x) -> named_struct('total', s2.total - q, 'room', s2.room - x, "
        "'out', concat(s2.out, array(x)))), s -> s.out)")


def split_quotas(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """(shard, quotas) of 2**depth shards from one row of ``quotas``, an array of block counts."""
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "quotas")
    for _ in range(depth):
        halves = nodes.withColumn("left", F.expr(_split(seed)))
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"),
                     F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))
        nodes = halves.select(F.explode(both).alias("n")).select("n.*")
    return nodes.select((F.col("node") - 2 ** depth).alias("shard"), "quotas")


def _digest(seed: int, purpose: str, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[F.col(c).cast("string") for c in columns]))


def draw_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
             share: float = SHARE, cap: float = CAP, seed: int = SEED, whole: bool = False,
             per_block: int = PER_BLOCK, per_shard: int = PER_SHARD) -> tuple[DataFrame, DataFrame]:
    """Two DataFrames: a row per row of ``docs``, and a row per draw.

    The first has doc_id, source, digest (of the row's text), row, size, source_size and
    target. A draw has row, doc_id, source, digest, copy, start and n_words (which words
    it takes), shard and position (place in its shard). Each source's draws sum to its
    target rounded down, the last document giving a part; with ``whole`` documents are
    only taken whole and the sum differs by at most half a document. A document is drawn
    once per pass through its source and never above ``cap`` passes, rounded up.

    Nulls: a null source is a source of its own, sorted last; a null text has no words
    and is never drawn; null ids are kept. Repeated rows are rows of their own. Empty
    tables give empty results, extra columns are not carried. A source of any share is
    spread over blocks by digest, and no step gathers more than a block or a shard.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(source, text).alias("digest"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"))
    sized = stage(sized.withColumn("order", _digest(seed, "order", "doc_id")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs"))
    sources = stage(target_words(sources, weights, share, cap), "sources").withColumn(
        "digits", F.greatest(F.lit(0), F.ceil(F.log(F.col("__docs") / per_block) / math.log(16))).cast("int")).drop("__docs")
    quota = F.round("target") if whole else F.floor("target")
    sources = sources.withColumn("quota", quota.cast("long")).withColumns({
        "passes": F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")})
    sources = sources.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    few = sources.count() <= MAX_BROADCAST_SOURCES
    own = sources.withColumnRenamed("source", "__source")
    rows = sized.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    # running words in permuted order: over the blocks of a source, in two steps, then within a block
    rows = rows.withColumn("block", F.substring(F.col("order"), F.lit(1), F.col("digits")))
    blocks = rows.groupBy("rank", "block", "digits", "passes", "rest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("top", F.substring(F.col("block"), F.lit(1), F.greatest(F.lit(0), F.col("digits") - 3)))
    tops = blocks.groupBy("rank", "top").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("rank").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("rank", "top", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"),
                       F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("rank", "top").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(tops, ["rank", "top"]).select(
        "rank", "block", "passes", "rest",
        (F.col("w0") + F.coalesce(F.sum("words").over(before), F.lit(0))).alias("begin"),
        (F.col("c0") + F.row_number().over(inside) - 1).alias("at"))
    drawn = stage(blocks.withColumn("times", F.col("passes") + (F.col("begin") < F.col("rest")).cast("long")), "blocks")

    placed = _shards_of(drawn, sized, seed, per_shard, share)
    within = Window.partitionBy("rank", "block").orderBy("order", "doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.join(drawn.select("rank", "block", "begin"), ["rank", "block"]).withColumn(
        "cum", F.col("begin") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("cum")))
    if whole:
        part = F.when(F.col("cum") + F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(0)
    copies = F.filter(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda c: F.struct(
            c.alias("copy"), F.when(c < F.col("passes"), F.col("size")).otherwise(part).cast("long").alias("n_words"))),
        lambda d: d["n_words"] > 0)
    draws = rows.select("row", "doc_id", "source", "digest", "rank", "block", F.explode(copies).alias("d")).select(
        "row", "doc_id", "source", "digest", "rank", "block", "d.copy", F.lit(0).cast("long").alias("start"), "d.n_words")
    draws = draws.join(placed, ["rank", "block", "copy"])
    local = Window.partitionBy("shard").orderBy(_digest(seed, "local", "doc_id", "copy"), "row", "copy")
    draws = draws.withColumn("position", F.row_number().over(local) - 1)
    return (rows.select("doc_id", "source", "digest", "row", "size", "source_size", "target"),
            draws.select("row", "doc_id", "source", "digest", "copy", "start", "n_words", "shard", "position"))


def _shards_of(blocks: DataFrame, sized: DataFrame, seed: int, per_shard: int, share: float) -> DataFrame:
    """(rank, block, copy, shard) of every drawn block."""
    words = (sized.agg(F.sum("size").alias("s")).first()["s"] or 0) * share
    depth = max(0, math.ceil(math.log2(max(1, words / per_shard))))
    # a source's drawn blocks are numbered pass after pass, each in permuted order
    full = Window.partitionBy("rank")
    each = blocks.where("times > 0").select(
        "rank", "block", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
    counted = blocks.groupBy("rank").agg(F.sum("times").alias("q"), F.count(F.lit(1)).alias("nb")).where("q > 0")
    each = each.join(counted.select("rank", "nb"), "rank").withColumn("number", F.col("copy") * F.col("nb") + F.col("at"))
    root = counted.agg(F.array_sort(F.collect_list(F.struct("rank", "q"))).alias("all")).select(
        F.col("all.rank").alias("ranks"), F.col("all.q").alias("quotas"))
    leaves = split_quotas(root, depth, seed)
    ranks = root.select("ranks")
    shares = leaves.select("shard", F.posexplode("quotas").alias("i", "q")).join(
        ranks.select(F.posexplode("ranks").alias("i", "rank")), "i")
    end = Window.partitionBy("rank").orderBy("shard")
    shares = shares.withColumn("stop", F.sum("q").over(end)).where("q > 0")
    numbers = shares.select("rank", "shard", F.explode(F.sequence(F.col("stop") - F.col("q"), F.col("stop") - 1)).alias("number"))
    return each.join(numbers, ["rank", "number"]).select("rank", "block", "copy", "shard")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: ``docs``' rows, each as often as whole draws take it, same columns."""
    _, draws = draw_mix(docs, doc_id, text, source, whole=True, **how)
    times = draws.groupBy("doc_id", "source", "digest").agg(F.count(F.lit(1)).alias("__times"))
    keys = {"__id": F.col(doc_id), "__source": F.col(source), "__digest": F.xxhash64(source, text)}
    rows = docs.withColumns(keys).dropDuplicates(list(keys))
    taken = times.select(*[F.col(b).alias(f"__{b}_of") for b in ("doc_id", "source", "digest")], "__times")
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, ("__doc_id_of", "__source_of", "__digest_of"))]
    met = rows.join(taken, on)
    return met.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs, draws = draw_mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    taken = draws.groupBy(F.col("row").alias("__row")).agg(F.sum("n_words").alias("taken"))
    return docs.join(taken, F.col("row") == F.col("__row"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:order:' || doc_id) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][rank % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM sources),
leveled AS (
  SELECT *, cap / w AS ratio,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
          - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM weighed),
targets AS (
  SELECT source, source_size,
         coalesce(least(cap, (SELECT arg_min(lev, ratio) FROM leveled WHERE ratio > lev) * w), cap) AS target FROM leveled),
ordered AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS quota,
         coalesce(CAST(sum(size) OVER (PARTITION BY sized.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS cum
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE quota // source_size * size + greatest(0, least(size, quota - quota // source_size * source_size - cum)) END AS taken
FROM ordered
"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": SQL}
