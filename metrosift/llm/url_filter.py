"""URL rules judged by Bloom filter cascades.

A cascade answers "is this key listed?" exactly for every key of a known universe, with
no join: level 0 holds the listed keys, level 1 the universe's keys that pass level 0
without being listed, level 2 the listed keys that pass level 1, and so on until no
false positive is left. The first level that refuses a key decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrosift.llm.common import lower_ascii, mixed, table
from metrosift.session import stage

#: A cascade is sent to every task only up to this size; longer lists are joined instead.
MAX_CASCADE_BYTES = 64 << 20
_MAX_LEVELS = 64

RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@dataclass(frozen=True)
class Cascade:
    """Bitmaps of 64-bit words, one per level, with the number of probes of each."""

    levels: tuple[tuple[np.ndarray, int], ...] = ()

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Membership of keys given by two 64-bit hashes each."""
        listed = np.zeros(len(a), bool)
        open_rows = np.arange(len(a))
        for depth, (words, probes) in enumerate(self.levels):
            passed = passes(words, probes, depth, a[open_rows], b[open_rows])
            open_rows = open_rows[passed]
            listed[open_rows] = depth % 2 == 0
        return listed


def _probe(depth: int, j: int, n_bits: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(a + np.uint64(j) * (b | np.uint64(1)), depth + 1) % np.uint64(n_bits)


def passes(words: np.ndarray, probes: int, depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ok = np.ones(len(a), bool)
    for j in range(probes):
        at = _probe(depth, j, len(words) * 64, a, b)
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def hash_pair(key: Column) -> tuple[Column, Column]:
    """Two hashes of the key from different seeds: the text's, and the hash of a word before it."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _level(keys: DataFrame, n: int, depth: int) -> tuple[np.ndarray, int]:
    """The bitmap of hashed keys (a, b): each task makes one, and only bitmaps travel."""
    per_key = 12.0 if depth == 0 else 2.0
    n_words = max(1, math.ceil(n * per_key / 64))
    probes = max(1, round(per_key * math.log(2)))

    def fill(batches):
        words = np.zeros(n_words, np.uint64)
        for part in batches:
            a, b = (part[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
            for j in range(probes):
                at = _probe(depth, j, n_words * 64, a, b)
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pd.DataFrame({"at": at, "bits": words[at].view(np.int64)})

    rows = keys.mapInPandas(fill, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()
    words = np.zeros(n_words, np.uint64)
    for row in rows:
        words[row["at"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    return words, probes


def _passing(keys: DataFrame, level: tuple[np.ndarray, int], depth: int) -> DataFrame:
    words, probes = level

    def keep(batches):
        for part in batches:
            a, b = (part[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
            yield part[passes(words, probes, depth, a, b)]

    return keys.mapInPandas(keep, "a long, b long")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """The cascade of ``listed`` over ``universe``, both DataFrames of a ``key`` column.

    The universe may hold repeated keys and must hold every key asked for later. Null
    keys are ignored. Level 0 is tested where the keys are made, so only its few false
    positives are shuffled. Returns None where the list is too long to send to every
    task; an empty list gives a cascade that holds nothing.
    """
    hashed = [d.where("key is not null").select(*[h.alias(c) for h, c in zip(hash_pair(F.col("key")), "ab")])
              for d in (listed, universe)]
    inside = hashed[0].distinct()
    n = inside.count()
    if n == 0:
        return Cascade()
    if n * 12 / 8 > MAX_CASCADE_BYTES:
        return None
    levels = [_level(inside, n, 0)]
    outside = stage(_passing(hashed[1], levels[0], 0).distinct().join(inside, ["a", "b"], "left_anti"), "outside")
    sides = [inside, outside]
    while (n := sides[len(levels) % 2].count()) > 0:
        depth = len(levels)
        if depth == _MAX_LEVELS:
            raise ValueError("Two different keys share both hashes")
        levels.append(_level(sides[depth % 2], n, depth))
        sides[(depth + 1) % 2] = stage(_passing(sides[(depth + 1) % 2], levels[-1], depth), "passing")
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is absent."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix + path prefix) a rule could have, longest first.

    ``lengths`` are the path lengths that occur among the rules, so their number is a
    property of the rule list and not of the pages.
    """
    labels = F.split(host, "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]),
                        lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.array_sort(F.array_distinct(keys), lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x))
                        .when(x < y, -1).when(x > y, 1).otherwise(0))


def _first_listed(block: Cascade, allow: Cascade):
    """A function of the two hash arrays of a row's keys: +i if its i-th key is the first
    listed one and allowed, -i if blocked, 0 if none is listed."""

    @F.pandas_udf(T.IntegerType())
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in a], np.int64)
        result = np.zeros(len(a), np.int32)
        if not sizes.sum():
            return pd.Series(result)
        ha, hb = (np.concatenate(list(x)).astype(np.int64).view(np.uint64) for x in (a, b))
        signs = np.where(block.contains(ha, hb), -1, np.where(allow.contains(ha, hb), 1, 0))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        hits = np.flatnonzero(signs)
        row, first = np.unique(rows[hits], return_index=True)
        at = hits[first]
        result[row] = (at - starts[row] + 1) * signs[at]
        return pd.Series(result)

    return find


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with columns host, path, rule and verdict added (same names are replaced).

    ``rules`` has (verdict, host, path): verdict is 'allow' or 'block', path starts with
    '/' or is empty. A rule fits its host and all subdomains where the url's path starts
    with its own; the longest host + path wins, of equally long ones the first in text
    order, and a key listed both ways is blocked. Urls
    that no rule fits get ``default`` and a null rule. Null, empty and malformed urls
    have an empty host and path. Every row of ``pages`` is returned once, repeated ones
    too; no pages or no rules is no error.
    """
    rules = rules.select("verdict", F.concat(lower_ascii(F.col("host")), F.coalesce("path", F.lit(""))).alias("key"),
                         F.length(F.coalesce("path", F.lit(""))).alias("n")).where("key is not null")
    lengths = sorted(r["n"] for r in rules.select("n").distinct().collect())
    host, path = url_parts(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    keyed = parts.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("__keys").alias("key"))
    cascades = [build_cascade(rules.where(F.col("verdict") == v).select("key"), universe) for v in ("block", "allow")]
    if any(c is None for c in cascades):
        return _judge_by_join(pages, keyed, rules, default)
    first = F.transform("__keys", lambda k: hash_pair(k)[0])
    second = F.transform("__keys", lambda k: hash_pair(k)[1])
    found = keyed.withColumn("__at", _first_listed(*cascades)(first, second))
    return found.withColumns({
        "rule": F.when(F.col("__at") != 0, F.element_at("__keys", F.when(F.col("__at") == 0, 1).otherwise(F.abs("__at")))),
        "verdict": F.when(F.col("__at") < 0, "block").when(F.col("__at") > 0, "allow").otherwise(default),
    }).drop("__keys", "__at")


def _judge_by_join(pages: DataFrame, keyed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same answer for rule lists too long for a cascade that every task holds."""
    listed = rules.groupBy("key").agg(F.max("verdict").alias("verdict"))
    rows = keyed.withColumn("__row", F.struct(*keyed.columns))
    rows = rows.withColumn("__id", F.sha2(F.to_json("__row"), 256))
    best = rows.select("__id", F.explode("__keys").alias("key")).distinct().join(listed, "key").groupBy("__id").agg(
        F.min_by(F.struct("key", "verdict"), F.struct(-F.length("key"), F.col("key"))).alias("__best"))
    return rows.join(best, "__id", "left").withColumns({
        "rule": F.col("__best.key"), "verdict": F.coalesce("__best.verdict", F.lit(default)),
    }).drop("__keys", "__row", "__id", "__best")


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_FIT = " OR ".join(
    f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') AND rule = '{h}{p}')" for _, h, p in RULES)
SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(verdict, rule) AS (VALUES {', '.join(f"('{v}', '{h}{p}')" for v, h, p in RULES)}),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON {_FIT} GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": SQL}
