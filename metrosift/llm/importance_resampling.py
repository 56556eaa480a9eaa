"""Importance resampling towards a target distribution, with exact ranks by parallel sorting.

Words are hashed to buckets, whose counts in the documents and in the target texts give
each bucket a gain; a document weighs the mean gain of its words. Weights are worked out on
whole arrays: a batch's words are hashed together, byte by byte.

A Gumbel-like draw is added and the highest scores are taken. They are ranked by regular
sampling: every locally sorted run gives rows at regular distances, which yield splitters;
rows between two splitters are exchanged and merged in one task; counts of the parts
before it give each part its first rank. Parts beyond the draw are not exchanged at all.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.llm.common import table
from metrosift.llm.segments import utf8
from metrosift.session import stage

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Rows of a part, about, and rows that all runs together give as samples, at most (besides one for each run).
PART_ROWS, SAMPLES = 500_000, 1 << 18
_CHUNK = 1 << 22
#: Longer words are hashed one by one.
_SHORT = 32
#: Digits and letters a to z, A to Z as a to z, and all bytes beyond ASCII; everything else separates words.
_WORD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def _crc_table() -> np.ndarray:
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, (rest >> 1) ^ np.uint32(0xEDB88320), rest >> 1)
    return rest


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each segment: one byte of all short segments at a time."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    long = int(np.searchsorted(-sizes[order], -_SHORT, "left"))
    short = order[long:]
    at, n = starts[short], sizes[short]
    rest = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for i in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -i, "left"))  # sizes fall, so those with a byte i come first
        rest[:live] = _CRC[(rest[:live] ^ data[at[:live] + i]) & 0xFF] ^ (rest[:live] >> 8)
    out = np.empty(len(starts), np.uint32)
    out[short] = ~rest
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes())
    return out


def word_buckets(texts: pa.Array, grams: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words of each text, text of each feature, bucket of each feature), for one step of whole texts after another."""
    data, offsets = utf8(texts)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
        part = np.zeros(int(offsets[last] - offsets[first]) + last - first + 1, np.uint8)
        begins = offsets[first:last + 1] - offsets[first] + np.arange(last - first + 1)
        inside = np.ones(len(part), bool)
        inside[begins] = False
        part[inside] = _WORD[data[offsets[first]:offsets[last]]]  # a separator stands before each text
        solid = part != 0
        starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1, np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        words = np.diff(np.searchsorted(starts, begins))
        text = np.repeat(np.arange(last - first), words)
        feature_texts, found = [text], [crc32s(part, starts, ends)]
        for n in range(2, grams + 1):
            whole = np.flatnonzero(text[n - 1:] == text[:len(text) - n + 1]) if len(text) >= n else np.zeros(0, np.int64)
            # a run's words, one space between them
            runs = [b" ".join(part[starts[i + k]:ends[i + k]].tobytes() for k in range(n)) for i in whole]
            feature_texts.append(text[whole])
            found.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)))
        yield words, np.concatenate(feature_texts), np.concatenate(found).astype(np.int64) % buckets
        first = last


def bucket_counts(rows: DataFrame, text: str = "text", grams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket. A task sends at most one row for each bucket."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in word_buckets(batch.column(0), grams, buckets):
                held += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    found = rows.select(text).mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in found.collect():  # at most ``buckets`` rows
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) of each bucket."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + k)) / ((s + 1) * (t_all + k))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def draw_of(key: int | None, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln u)), u from the id's hash; a null id is hashed as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def scored(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", grams: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one long for each bucket

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, n, total = [], [], []
            for own, of_text, bucket in word_buckets(batch.column(1), grams, len(gain)):
                words.append(own)
                n.append(np.bincount(of_text, minlength=len(own)))
                sums = np.zeros(len(own), np.int64)
                np.add.at(sums, of_text, gain[bucket])
                total.append(sums)
            words, n, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, n, total))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            drawn = np.array([draw_of(key, seed) for key in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (n, words, weight, weight + drawn))],
                                             ["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(of, _SCORED)


def _key() -> list[Column]:
    """The total order of the draw: score, then id (null last), then a number of the row's own."""
    return [(-F.col("score")).alias("k0"), F.col("doc_id").isNull().cast("long").alias("k1"),
            F.coalesce("doc_id", F.lit(0)).alias("k2"), F.col("row").alias("k3")]


def part_numbers(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """For each row of ``keys``, how many splitters come before it or are it; both have columns in order of weight."""
    both = np.concatenate((splitters, keys))
    order = np.lexsort(both.T[::-1])  # stable, so a splitter comes before the row it was taken from
    before = np.cumsum(order < len(splitters))
    out = np.empty(len(both), np.int64)
    out[order] = before
    return out[len(splitters):]


def regular_splitters(rows: DataFrame, n_rows: int, parts: int, samples: int = SAMPLES) -> np.ndarray:
    """``parts`` - 1 keys at regular places among regular samples of the locally sorted runs."""
    if parts < 2:
        return np.zeros((0, 4), np.int64)
    step = max(1, -(-n_rows // samples))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange(-passed % step, batch.num_rows, step)))
            passed += batch.num_rows

    runs = rows.select(*_key()).sortWithinPartitions("k0", "k1", "k2", "k3")
    found = runs.mapInArrow(of, "k0 long, k1 long, k2 long, k3 long").toPandas().to_numpy(np.int64)  # at most ``samples`` and one a run
    found = found[np.lexsort(found.T[::-1])]
    return found[[len(found) * i // parts for i in range(1, parts)]]


def ranked(rows: DataFrame, n_rows: int, n_drawn: int, part_rows: int = PART_ROWS, samples: int = SAMPLES) -> DataFrame:
    """``rows`` (doc_id, n_features, weight, score, row) with the exact rank of the first ``n_drawn``, null after them.

    ``rows`` have to be stored, as they are read again. A part holds about ``part_rows``
    rows and at most the samples' distance times the number of runs more, whatever repeats:
    the row number splits rows of one score and id as well.
    """
    parts = max(1, -(-n_rows // part_rows))
    shared = rows.sparkSession.sparkContext.broadcast(regular_splitters(rows, n_rows, parts, samples))
    names = ["doc_id", "n_features", "weight", "score", "row"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(5, 9)], axis=1)
            part = pa.array(part_numbers(keys, shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], part], [*names, "part"])

    placed = stage(rows.select(*names, *_key()).mapInArrow(
        dealt, "doc_id long, n_features long, weight long, score long, row long, part long"), "placed")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part
    starts = np.concatenate(([0], np.cumsum([sizes.get(i, 0) for i in range(parts)])))
    cut = int(np.searchsorted(starts[:-1], n_drawn, "left"))  # parts that start before the draw ends

    def merge(part: pa.Table) -> pa.Table:
        number = part["part"][0].as_py()
        doc, score, row = part["doc_id"].combine_chunks(), part["score"].to_numpy(), part["row"].to_numpy()
        order = np.lexsort((row, doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), -score))
        rank = starts[number] + 1 + np.arange(len(order))
        return part.take(pa.array(order)).select(names[:4]).append_column("rank", pa.array(rank, mask=rank > n_drawn))

    first = placed.where(F.col("part") < cut).groupBy("part").applyInArrow(
        merge, "doc_id long, n_features long, weight long, score long, rank long")
    return first.unionByName(placed.where(F.col("part") >= cut).select(*names[:4], F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", grams: int = 1,
             buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
             part_rows: int = PART_ROWS, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of ``docs``.

    Of the rows with at least ``least_words`` words, ``percent`` percent (rounded down) have
    a rank. Null and empty texts have no features, weigh 0 and are never drawn. Equal scores
    go by doc_id, null last; rows that repeat an id and score are ranked one by one, in the
    order they are stored. An empty target leaves only the smoothing; no rows give no rows.
    Other columns are not carried.
    """
    gains = bucket_gains(bucket_counts(docs, text, grams, buckets), bucket_counts(target, target_text, grams, buckets))
    own = stage(scored(docs, gains, doc_id, text, grams, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= least_words
    n_rows = own.where(enough).count()
    drawn = ranked(own.where(enough), n_rows, n_rows * percent // 100, part_rows, samples)
    rest = own.where(~enough).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_CUT = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = rf"""
WITH RECURSIVE steps(c, i, rest) AS (
  SELECT c, 0, c FROM range(256) t(c)
  UNION ALL SELECT c, i + 1, CASE WHEN rest & 1 = 1 THEN xor(rest >> 1, 3988292384) ELSE rest >> 1 END FROM steps WHERE i < 8),
crc AS (SELECT list(rest ORDER BY c) AS t FROM steps WHERE i = 8),
d AS (SELECT row_number() OVER () AS line, doc_id, {_CUT} AS words FROM documents),
b AS (SELECT {_CUT} AS words FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM d UNION ALL SELECT unnest(words) FROM b)),
bytes AS (
  SELECT word, list_transform(range(1, length(hex(encode(word))), 2),
    lambda i: CAST('0x' || substr(hex(encode(word)), i, 2) AS BIGINT)) AS v FROM vocabulary),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, v),
    lambda r, x: xor(r >> 8, t[CAST(xor(r, x) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
in_d AS (SELECT line, bucket FROM (SELECT line, unnest(words) AS word FROM d) JOIN hashed USING (word)),
in_b AS (SELECT bucket FROM (SELECT unnest(words) AS word FROM b) JOIN hashed USING (word)),
s AS (SELECT bucket, count(*) AS s FROM in_d GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM in_b GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM in_d) AS s_all, (SELECT count(*) FROM in_b) AS t_all),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE)) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT line, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM in_d JOIN gains USING (bucket) GROUP BY line),
scored AS (
  SELECT line, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (line)),
ordered AS (
  SELECT line, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (10 * n) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ordered USING (line)
"""

QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLES = {"op12_importance_resampling": SQL}
