"""Document fingerprints: bottom-k sketches of word shingles, by SQL functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's
shingles. Sketches of parts merge into that of the whole, and two of them estimate
resemblance and containment; one alone estimates the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrosift.llm.common import range_bounds, range_of, table
from metrosift.session import stage

SHINGLE, K = 5, 64
#: Rows of a neighbour bucket, about, and the most buckets that are told apart.
PER_BUCKET, MAX_BUCKETS = 2_000, 10_000
#: Bucket edges are sent to every task up to this many rows.
MAX_BROADCAST_EDGES = 100_000
_BLANKS = "[\\x20\\x09-\\x0D]+"
_LEAST = -(1 << 63)


def words_column(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANKS), lambda w: w != "")


def sketch_of_words(words: Column, shingle: int = SHINGLE, k: int = K) -> Column:
    """The sketch of an array column of words. Fewer than ``shingle`` words are one shingle; none give an empty sketch.

    ``words`` should be a column of its own, as it is read for every shingle.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(shingle)]))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(
        F.slice(F.array_sort(F.array_distinct(hashes)), 1, k))


def with_sketch(rows: DataFrame, text: str, out: str, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """``rows`` with column ``out``: the sketch of ``text``."""
    return rows.withColumn("__words", words_column(F.col(text))).withColumn(
        out, sketch_of_words(F.col("__words"), shingle, k)).drop("__words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the joint shingles that both have; two empty sketches are alike."""
    joint = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), joint))
    return F.when(F.size(joint) == 0, 1.0).otherwise(shared / F.size(joint)).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    reach = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too, 0 to 1; an empty ``a`` is contained."""
    likeness = resemblance(a, b, k)
    shared = likeness * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_sketches(rows: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group of ``rows``. Ranks are limited before the shuffle, so no group is gathered."""
    hashes = rows.select(*keys, F.explode(sketch).alias("__h")).distinct()
    low = hashes.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))).where(F.col("__r") <= k)
    return low.groupBy(*keys).agg(F.array_sort(F.collect_list("__h")).alias(sketch))


def hex_string(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(docs: DataFrame, key: str, text: str, per_bucket: int = PER_BUCKET, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """(key, text, sketch, next_text, next_sketch): each row beside the row of the next smaller key.

    After the smallest key comes the largest; a single row is its own neighbour. Buckets
    of neighbouring keys are found from quantiles. A bucket's first row, in descending
    order, is added to the bucket above as a guest, so texts are shuffled once and no
    window is larger than a bucket. Null keys count as the smallest; equal keys go in
    order of their texts.
    """
    keyed = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"),
                        F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("__at"))
    n = keyed.count()
    buckets = min(MAX_BUCKETS, max(1, -(-n // per_bucket)))
    bounds = range_bounds(keyed, "__at", buckets)
    placed = keyed.withColumn("__bucket", range_of(bounds, F.col("__at")))
    edges = stage(placed.groupBy("__bucket").agg(F.max("__at").alias("__at")), "edges")
    top = edges.agg(F.max("__bucket").alias("b")).first()["b"]
    to = edges.select("__at", F.when(F.col("__bucket") == top, 1).otherwise(F.col("__bucket") + 1).alias("__to"),
                      (F.col("__bucket") == top).alias("__last"))
    guests = keyed.join(F.broadcast(to) if len(bounds) <= MAX_BROADCAST_EDGES else to, "__at").select(
        "key", "text", "__at", F.col("__to").alias("__bucket"), F.when(F.col("__last"), 2).otherwise(1).alias("__guest"))
    together = placed.withColumn("__guest", F.lit(0)).unionByName(guests).repartition("__bucket")
    sketched = with_sketch(together, "text", "sketch", shingle, k)
    down = Window.partitionBy("__bucket").orderBy((F.col("__guest") == 2).cast("int"), F.desc("__at"), "text")
    return sketched.withColumns({"next_text": F.lead("text").over(down), "next_sketch": F.lead("sketch").over(down)}).where(
        "__guest = 0").select("key", "text", "sketch", "next_text", "next_sketch")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """Sketches of each row's text, of its edited text and of the next text, with the edited text itself.

    The edited text has the last half of the code points (rounded down) replaced by as
    many first ones of the next text. Null texts are empty and have empty sketches, with
    likeness 1 among each other and 0 to others. Repeated rows are kept, extra columns
    are not carried, an empty table gives no rows.
    """
    rows = with_next(docs, doc_id, text, shingle=shingle, k=k)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited_text", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                                F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_sketch(rows, "edited_text", "edited_sketch", shingle, k)
    return rows.withColumns({"near_edited": resemblance(F.col("sketch"), F.col("edited_sketch"), k),
                             "near_next": resemblance(F.col("sketch"), F.col("next_sketch"), k)}).withColumnRenamed("key", doc_id)


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprint_edits(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), hex_string(F.col("sketch")).alias("fingerprint"),
        hex_string(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLES: dict[str, str] = {}
