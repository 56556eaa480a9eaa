"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``COORDINATES`` places. In each of the first rounds every shingle is put into
one hashed place; in as many further rounds, round i puts all shingles into place i. A
place keeps its least value of the earliest round, so after twice as many rounds as places
every place is filled, and the share of equal places estimates the resemblance with the
concentration of independent draws. Filled places never change, so rounds end early.

Texts that share a band of equal places and whose one-bit summaries agree are candidates;
components of candidates are then compared on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.llm.common import mixed, runs, table
from metrosift.llm.simhash import connecting, exact_links, shingle_set
from metrosift.operators.graph import components
from metrosift.operators.joins import join_lookup
from metrosift.session import stage

SHINGLE, RESEMBLANCE = 5, 0.85
#: Texts of resemblance 0.85 share no band with probability 2e-7: (1 - 0.85**7)**40.
BANDS, ROWS = 40, 7
COORDINATES = BANDS * ROWS
#: One bit of each of the first places, and how many may differ: at 0.85, 14 do on average and over 40 with probability 4e-8.
SUMMARY_BITS, MOST_BITS = 192, 40
#: Banded texts that one task compares, about, and texts from which on a band counts as hot.
PER_BUCKET, HOT = 20_000, 100_000
#: One text in so many tells which bands are hot; this plans the work and decides no link.
_PROBE = 64
_CELLS = 1 << 16
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROUNDS = mixed(np.arange(2 * COORDINATES), 21)
_LOW = np.uint64(32)


def _placed(hashed: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    return mixed(hashed[None, :] + _ROUNDS[rounds][:, None], 22)


def sketch(hashed: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The ``t`` places of a set of shingle hashes that is not empty; t is at most ``COORDINATES``."""
    places = np.full(t, _EMPTY)
    at = 0
    while at < t and (places == _EMPTY).any():
        # a few rounds at once where the set is small, a part of the set at once where it is large
        number = np.arange(at, min(t, at + max(1, min(_CELLS // len(hashed), 2 * t // len(hashed) + 1))))
        for low in range(0, len(hashed), _CELLS):
            drawn = _placed(hashed[low:low + _CELLS], number)
            place = ((drawn >> _LOW) * np.uint64(t)) >> _LOW
            value = (number.astype(np.uint64) << _LOW)[:, None] | (drawn & np.uint64(0xFFFFFFFF))
            np.minimum.at(places, place.reshape(-1).astype(np.int64), value.reshape(-1))
        at = int(number[-1]) + 1
    for place in np.flatnonzero(places == _EMPTY):
        least = min(int((_placed(hashed[low:low + _CELLS], np.array([t + place])) & np.uint64(0xFFFFFFFF)).min())
                    for low in range(0, len(hashed), _CELLS))
        places[place] = ((t + int(place)) << 32) | least
    return places


def band_keys(places: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = mixed(np.arange(bands), 23)
    with np.errstate(over="ignore"):
        for column in places.reshape(bands, rows).T:
            key = mixed(key + mixed(column, 24), 25)
    return key


def summary(places: np.ndarray) -> bytes:
    return np.packbits((mixed(places[:SUMMARY_BITS], 26) & np.uint64(1)).astype(np.uint8)).tobytes()


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    return [shingle_set(t.as_py(), shingle) for t in texts]


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), 13) for s in sets], np.uint64).view(np.int64))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, node, bands, bits) of every row; bands and bits are null for an empty set.

    ``node`` names the set, so that rows of one set are compared once.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(1), shingle)
            found = [sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _nodes(sets),
                pa.array([None if p is None else band_keys(p).tobytes() for p in found], pa.binary()),
                pa.array([None if p is None else summary(p) for p in found], pa.binary())],
                ["doc_id", "n_shingles", "node", "bands", "bits"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(
        of, "doc_id long, n_shingles long, node long, bands binary, bits binary")


def _keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their band keys, a row each)."""
    return batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)


def _key_rows(distinct: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, node) for every band of every set, or for the ``wanted`` keys only."""
    shared = None if wanted is None else distinct.sparkSession.sparkContext.broadcast(wanted)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = _keys_of(batch)
            nodes, keys = np.repeat(nodes, BANDS), keys.reshape(-1)
            if shared is not None:
                hit = np.isin(keys, shared.value)
                nodes, keys = nodes[hit], keys[hit]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes)], ["key", "node"])

    return distinct.select("node", "bands").mapInArrow(of, "key long, node long")


def hot_bands(distinct: DataFrame, n: int, hot: int = HOT) -> np.ndarray:
    """Sorted keys that more than about ``hot`` sets share, told from a probe of the sets.

    Each has some hundred thousand rows, and ``hot`` grows with the table, so there are at most about 2 million.
    """
    least = max(hot, n * BANDS // 1_000_000) // _PROBE // 2
    probe = distinct.where(F.pmod(F.xxhash64("node"), F.lit(_PROBE)) == 0)
    found = _key_rows(probe).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("key")
    return np.sort(np.array([r["key"] for r in found.collect()], np.int64).view(np.uint64))


def band_links(distinct: DataFrame, hot: int = HOT, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(a, b): links between nodes of ``distinct`` (node, bands, bits) that share a band.

    All pairs under a key count whose summaries agree. A hot key's nodes are all linked to
    the least of them instead, unseen: nothing is lost by a link too many, as links only
    choose what is compared in full.
    """
    n = distinct.count()
    buckets = max(1, -(-n * BANDS // per_bucket))
    hot_keys = hot_bands(distinct, n, hot)
    shared = distinct.sparkSession.sparkContext.broadcast(hot_keys)
    dealt_schema = pa.schema([("bucket", pa.int64()), ("nodes", pa.binary()), ("keys", pa.binary()), ("bits", pa.binary())])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    words = SUMMARY_BITS // 64

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = _keys_of(batch)
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, words)
            row, key = np.repeat(np.arange(len(nodes)), BANDS), keys.reshape(-1)
            if len(shared.value):
                cold = ~np.isin(key, shared.value)
                row, key = row[cold], key[cold]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            row, key, bucket = row[order], key[order], bucket[order]
            cuts = runs(bucket)
            spans = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *(
                pa.array([x[s:e].tobytes() for s, e in spans], pa.binary()) for x in (nodes[row], key, bits[row]))], schema=dealt_schema)

    def link(rows: pa.Table) -> pa.Table:
        nodes, keys, bits = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("nodes", np.int64), ("keys", "<u8"), ("bits", "<u8")))
        order = np.argsort(keys, kind="stable")
        order = order[np.repeat(np.diff(runs(keys[order])) > 1, np.diff(runs(keys[order])))]  # a key of its own links nothing
        keys, bits = keys[order], bits.reshape(-1, words)[order]
        own, number = np.unique(nodes[order], return_inverse=True)
        label = connecting(number, keys, lambda a, b: np.flatnonzero(
            np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= MOST_BITS))
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table([pa.array(own[linked]), pa.array(own[label[linked]])], schema=link_schema)

    dealt = distinct.select("node", "bands", "bits").mapInArrow(deal, "bucket long, nodes binary, keys binary, bits binary")
    links = dealt.groupBy("bucket").applyInArrow(link, "a long, b long")
    if not len(hot_keys):
        return links
    members = stage(_key_rows(distinct, hot_keys), "hot-bands")
    least = members.groupBy("key").agg(F.min("node").alias("b"))  # a row for each hot key
    return links.unionByName(members.join(F.broadcast(least), "key").select(F.col("node").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    resemblance: float = RESEMBLANCE, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Rows link if their sets share at least ``resemblance`` of their union; component_id is
    the least doc_id reachable and kept whether it is the row's own. Rows of one set are one
    node, whatever their number. Null, empty and blank texts have no shingles and link with
    nothing, not even each other. Null ids never name a component unless all its ids are
    null; such rows are kept. Rows that repeat an id share its verdict if they are in one
    component. Other columns are not carried; no rows give no rows. Shingles and sets are
    told apart by 64-bit hashes. ``resemblance`` should be 0.85 or more, for which the bands are made.
    """
    own = stage(sketches(docs, doc_id, text, shingle), "sketches")
    distinct = stage(own.where("n_shingles > 0").groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.min("doc_id").alias("least")), "distinct")
    near = stage(components(band_links(distinct, hot)), "candidates")
    # the rows of a candidate's least id hold its text; the sets they give that are no candidates are left out again
    name = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    chosen = stage(near.join(distinct.select("node", F.col("least").alias("_id")), "node").select("component", "node", name.alias("_name")), "chosen")
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).select(name.alias("_name"), "_text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(0), shingle)
            yield pa.RecordBatch.from_arrays([
                _nodes(sets), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "size", "hashes"])

    compared = join_lookup(texts, stage(chosen.select("_name").distinct(), "names"), ["_name"], "left_semi").select("_text").mapInArrow(
        sets_of, "node long, size long, hashes binary")
    compared = join_lookup(compared, chosen.select("component", "node"), ["node"])
    sets = stage(compared.groupBy("component", "node").agg(F.max("size").alias("size"), F.first("hashes").alias("hashes")), "sets")
    linked = stage(components(exact_links(sets, resemblance)), "components")
    members = linked.join(distinct.select("node", "least"), "node")
    least = members.groupBy("component").agg(F.min("least").alias("_least"))
    named = stage(members.join(least, "component").select("node", "_least")
                  .unionByName(distinct.join(linked.select("node"), "node", "left_anti").select("node", F.col("least").alias("_least"))), "named")
    found = join_lookup(own.where("n_shingles > 0").select("doc_id", "n_shingles", "node"), named, ["node"]).select(
        "doc_id", "n_shingles", F.col("_least").alias("component_id"))
    alone = own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT line, doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles FROM cut),
nodes AS (SELECT min(line) AS node, min(doc_id) AS least, len(shingles) AS n, shingles FROM sets WHERE len(shingles) > 0 GROUP BY shingles),
tokens AS (SELECT node, n, unnest(shingles) AS s FROM nodes),
shared AS (
  SELECT a.node AS a, b.node AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM tokens a JOIN tokens b ON a.s = b.s AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.node, b.node),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT r.a AS node, min(n.least) AS component_id FROM reach r JOIN nodes n ON r.b = n.node GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE c.component_id END AS component_id,
  s.doc_id IS NOT DISTINCT FROM CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE c.component_id END AS kept
FROM sets s LEFT JOIN nodes n ON n.shingles = s.shingles LEFT JOIN named c ON c.node = n.node
"""

QUERIES = {"op13_minhash": op13_minhash}
ORACLES = {"op13_minhash": SQL}
