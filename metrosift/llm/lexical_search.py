"""Ranked lexical search by scanning the texts with an Aho-Corasick automaton.

All terms of the items, each between two guards, make one automaton, which is broadcast
and counts term frequencies straight from the texts; there is no index of documents. The
first scan gives the corpus counts (documents, terms, document frequencies), the second
turns each match into scores of the items whose terms it is. Items come in blocks of
bounded size, and every block scans all documents.

Documents and items are never cut. Null and empty texts have no terms, count nowhere and
are found by nothing. Items of one id, null included, are one item with the terms of all
its rows. Repeated document rows are documents of their own; a null doc_id comes after
all others among equal scores. No documents or no items give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrosift.llm.common import parts_for, table
from metrosift.llm.segments import first_of_each, utf8

K = 10
#: Bytes of item texts per block, about; a block holds at least one whole item. Its automaton is what is broadcast.
BLOCK_BYTES = 4 << 20
#: Documents x items scored at a time.
_CELLS = 1 << 20
_MATCHES = 1 << 18
#: Tasks' best rows of an item are merged in this many groups first.
_MERGES = 64
_GUARD = 0x20
#: Digits, letters and all bytes beyond ASCII stay, A to Z as a to z; everything else is a guard.
_TERM = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else _GUARD for c in range(256)], np.uint8)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM.tobytes()).split() if text else []


@dataclass(frozen=True)
class ItemBlock:
    """Items of one block. ``postings`` holds, term after term, the items with it and how often; ``starts`` tells where."""

    ids: list[int | None]
    automaton: ahocorasick.Automaton
    n_terms: int
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray


def item_block(items: list[tuple[int | None, str | None]]) -> ItemBlock | None:
    """Automaton and postings of the items' terms; None where no item has any."""
    by_id: dict[int | None, Counter] = {}
    for key, text in items:
        by_id.setdefault(key, Counter()).update(terms_of(text))
    ids = [key for key, terms in by_id.items() if terms]
    postings: dict[bytes, list[tuple[int, int]]] = {}
    for place, key in enumerate(ids):
        for term, n in by_id[key].items():
            postings.setdefault(term, []).append((place, n))
    if not ids:
        return None
    automaton = ahocorasick.Automaton()
    for number, term in enumerate(postings):
        automaton.add_word(f" {term.decode('latin-1')} ", number)
    automaton.make_automaton()
    sizes = [len(found) for found in postings.values()]
    flat = np.array([pair for found in postings.values() for pair in found], np.int64)
    return ItemBlock(ids, automaton, len(sizes), np.concatenate(([0], np.cumsum(sizes))), flat[:, 0], flat[:, 1])


def scan(texts: pa.Array, block: ItemBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, then of each pair found: text, term, frequency). Pairs come by text."""
    data, offsets = utf8(texts)
    # one guard before each text keeps terms of two texts apart
    rows = len(offsets) - 1
    guarded = np.full(len(data) + rows + 1, _GUARD, np.uint8)
    begins = offsets + np.arange(rows + 1)
    inside = np.ones(len(guarded), bool)
    inside[begins] = False
    guarded[inside] = _TERM[data]
    solid = guarded != _GUARD
    ends = np.flatnonzero(solid[:-1] & ~solid[1:])
    n = np.diff(np.searchsorted(ends, begins))
    matches, pairs, counts = block.automaton.iter(guarded.tobytes().decode("latin-1")), [], []
    while True:
        found = np.fromiter(chain.from_iterable(islice(matches, _MATCHES)), np.int64).reshape(-1, 2)
        if not len(found):
            break
        text = np.searchsorted(begins, found[:, 0] - 1, "right") - 1  # the last byte is the guard after the term
        key, count = np.unique(text * block.n_terms + found[:, 1], return_counts=True)
        pairs.append(key)
        counts.append(count)
    if not pairs:
        none = np.zeros(0, np.int64)
        return n, none, none, none
    key, place = np.unique(np.concatenate(pairs), return_inverse=True)
    tf = np.zeros(len(key), np.int64)
    np.add.at(tf, place, np.concatenate(counts))
    return n, key // block.n_terms, key % block.n_terms, tf


def document_lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """25 + (75 * n * documents) div terms, exact however large the product gets."""
    if int(n.max(initial=0)) * 75 * documents < 2**63:
        return 25 + (75 * documents * n.astype(np.int64)) // max(terms, 1)
    return np.array([25 + 75 * int(x) * documents // terms for x in n], np.int64)


class Best:
    """The k best (score, doc_id) of each item so far; null ids come last among equal scores."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.least = k, np.zeros(n_items, np.int64)
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``scores``: documents x items; only scores above 0 count."""
        row, item = np.nonzero((scores >= self.least) & (scores > 0))
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[row, item]))
        doc, null = np.concatenate((self.doc, doc[row])), np.concatenate((self.null, null[row]))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        first = first_of_each(item)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        kept = place < self.k
        self.item, self.score, self.doc, self.null = item[kept], score[kept], doc[kept], null[kept]
        full = place == self.k - 1
        self.least[item[full]] = score[full]


def score_block(n: np.ndarray, text: np.ndarray, term: np.ndarray, tf: np.ndarray, block: ItemBlock, weights: np.ndarray,
                documents: int, terms: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, their scores for every item) for consecutive rows of a batch, few enough at a time."""
    length = document_lengths(n, documents, terms)
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[text]))
    step = max(1, _CELLS // len(block.ids))
    for at in range(0, len(n), step):
        stop = min(len(n), at + step)
        low, high = np.searchsorted(text, (at, stop))
        scores = np.zeros((stop - at, len(block.ids)), np.int64)
        for begin in range(low, high, _MATCHES):
            some = slice(begin, min(high, begin + _MATCHES))
            sizes = block.starts[term[some] + 1] - block.starts[term[some]]
            posting = np.arange(sizes.sum()) + np.repeat(block.starts[term[some]] - (np.cumsum(sizes) - sizes), sizes)
            np.add.at(scores.reshape(-1), np.repeat((text[some] - at) * len(block.ids), sizes) + block.items[posting],
                      np.repeat(impact[some], sizes) * block.repeats[posting])
        yield slice(at, stop), scores


def corpus_counts(docs: DataFrame, block: ItemBlock, text: str = "text") -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents holding each of the block's terms)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held = np.zeros(own.n_terms + 2, np.int64)
        for batch in batches:
            n, _, term, _ = scan(batch.column(0), own)
            held[:-2] += np.bincount(term, minlength=own.n_terms)
            held[-2:] += np.count_nonzero(n), n.sum()
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "n"])

    found = docs.select(text).mapInArrow(of, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = np.zeros(block.n_terms + 2, np.int64)
    for row in found.collect():  # at most one row for each term of the block
        held[row["term"]] = row["n"]
    return int(held[-2]), int(held[-1]), held[:-2]


def _search_block(docs: DataFrame, block: ItemBlock, doc_id: str, text: str, k: int) -> DataFrame:
    documents, terms, held = corpus_counts(docs, block, text)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((block, weights))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        best = Best(len(own.ids), k)
        for batch in batches:
            doc, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            n, *pairs = scan(batch.column(1), own)
            for rows, scores in score_block(n, *pairs, own, weight, documents, terms):
                best.add(scores, doc[rows], null[rows])
        ids = pa.array([own.ids[i] for i in best.item], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(best.doc, mask=best.null), pa.array(best.score)], ["item_id", "doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(of, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0.

    A term weighs floor(1000 ln((2N+2)/(2df+1))) and counts (10^9 tf) div (1000 tf + 8m) in a
    document of relative length m; equal scores rank by ascending doc_id. Other columns are
    not carried. Each task keeps only the best ``k`` of each item, so what is shuffled does
    not grow with the length of documents.
    """
    asked = items.select(F.col(item_id).cast("long").alias("key"), F.col(item_text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    parts = parts_for(asked, size, block_bytes)
    part, found = F.pmod(F.xxhash64("key"), F.lit(parts)), None
    for number in range(parts):
        block = item_block([tuple(r) for r in asked.where(part == number).collect()])
        if block is not None:
            own = _search_block(docs, block, doc_id, text, k)
            found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item_id", "merge").orderBy(*order)
    found = found.withColumn("merge", F.pmod(F.xxhash64("doc_id"), F.lit(_MERGES)))
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return found.where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL = r"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS line, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, line, CAST(len(terms) AS BIGINT) AS n, terms FROM cut WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
lengths AS (SELECT doc_id, line, 100 - 75 + ((75 * n * docs) // all_terms) AS m FROM d, totals),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY ALL),
words AS (SELECT line, unnest(terms) AS term FROM d),
tf AS (SELECT line, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, totals GROUP BY term, docs),
scored AS (
  SELECT item_id, line, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN lengths USING (line) GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLES = {"op11_lexical_search": SQL}
