"""Lexical search, importance resampling and MinHash against brute force, and on odd and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrosift.llm import importance_resampling as resampling
from metrosift.llm import lexical_search, minhash
from odd_rows import none, odd  # noqa: F401

rng = random.Random(11)
WORDS = ["alpha", "Beta", "gam-ma", "δέλτα", "x1", "x", "1", "the", "THE", "naïve", "ne", "vernal", "漢字", "y_z"]


def sentence(n):
    return rng.choice(["", " ", "\n"]) + "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "--", ".\n", "\x7f"]) for _ in range(n))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_scan(docs, items, k=10):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    bags = [(key, collections.Counter(term.findall(lower(text)))) for key, text in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    asked = collections.defaultdict(collections.Counter)
    for key, text in items:
        asked[key].update(term.findall(lower(text)))
    out = set()
    for item, want in asked.items():
        found = []
        for key, bag in bags:
            score, m = 0, 25 + (75 * sum(bag.values()) * n_docs // total if total else 0)
            for t, repeats in want.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += repeats * w * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out |= {(item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)}
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_search_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical_search, "_MATCHES", 7)
    monkeypatch.setattr(lexical_search, "_CELLS", 40)
    docs = [(i, sentence(rng.randrange(30))) for i in range(150)] + [(3, "naïve"), (3, "naïve"), (None, "naïve x"), (None, None), (2**60, "naïve")]
    items = [(i, sentence(rng.randrange(8))) for i in range(12)] + [(4, "x1 x1"), (50, None), (51, "unknown"), (None, "naïve"), (52, "...")]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert {tuple(r) for r in found.collect()} == by_scan(docs, items)


def test_search_on_odd_and_empty(spark, odd, none):
    items = [(1, "one"), (2, "wort brown"), (2, "fox"), (3, None)]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in lexical_search.search(odd, asked).collect()} == by_scan(rows, items)
    assert lexical_search.search(none, asked).count() == 0 == lexical_search.search(odd, asked.limit(0)).count()


def test_relative_length_is_exact_beyond_64_bits():
    n, docs, terms = np.array([10**8, 3]), 10**12, 10**13
    assert lexical_search.document_lengths(n, docs, terms).tolist() == [25 + 75 * int(x) * docs // terms for x in n]


def by_sorting(docs, target, least=20, percent=10, k=10_000):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    buckets = lambda text: [zlib.crc32(w.encode()) % k for w in word.findall(lower(text))]
    s, t = (collections.Counter(b for text in texts for b in buckets(text)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for key, text in docs:
        own = buckets(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + k) / ((s[b] + 1) * (t_all + k)))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((i for i, r in enumerate(rows) if r[1] >= least), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0, i))
    rank = {i: n for n, i in enumerate(enough[:len(enough) * percent // 100], 1)}
    return sorted(((*r, rank.get(i)) for i, r in enumerate(rows)), key=repr)


def resampled(docs, target, **how):
    return sorted((tuple(r) for r in resampling.resample(docs, target, **how).collect()), key=repr)


@pytest.mark.parametrize("part_rows,samples,percent", [(500_000, 1 << 18, 10), (30, 60, 10), (7, 1000, 60)])
def test_resampling_equals_brute_force(spark, part_rows, samples, percent):
    docs = [(i, sentence(rng.randrange(60))) for i in range(400)] + [(None, "the " * 30)] * 3 + [(2**60 + 1, None), (2**60 + 1, "x " * 25)]
    docs += [(777, "the same row again " * 9)] * 250  # one key on a third of all rows
    target = [sentence(20) for _ in range(9)]
    found = resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                      spark.createDataFrame([(x,) for x in target], "text string"), part_rows=part_rows, samples=samples, percent=percent)
    assert found == by_sorting(docs, target, percent=percent)


def test_parts_of_one_repeated_key_stay_small(spark):
    keys = np.stack([np.zeros(1000, np.int64), np.zeros(1000, np.int64), np.full(1000, 5), np.arange(1000)], axis=1)
    parts = resampling.part_numbers(keys, keys[::100][1:])
    assert np.bincount(parts).tolist() == [100] * 10


def test_word_hashes_equal_the_library(spark):
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(1, 70), 3, 3, 5000]]
    ends = np.cumsum([len(w) for w in words])
    found = resampling.crc32s(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert found.tolist() == [zlib.crc32(w) for w in words]


def test_pairs_of_words_as_features(spark):
    docs = spark.createDataFrame([(1, "A b, c"), (2, "b c"), (3, "c")], "doc_id long, text string")
    counts = resampling.bucket_counts(docs, grams=2, buckets=1 << 20)
    want = collections.Counter(zlib.crc32(w) % (1 << 20) for w in [b"a", b"b", b"c", b"a b", b"b c", b"b", b"c", b"b c", b"c"])
    assert {i: int(counts[i]) for i in np.flatnonzero(counts)} == want


def test_resampling_on_odd_and_empty(spark, monkeypatch, odd, none):
    monkeypatch.setattr(resampling, "_CHUNK", 64)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert resampled(odd, odd.limit(2), percent=50) == by_sorting(docs, [r.text for r in odd.limit(2).collect()], percent=50)
    assert resampled(odd, none) == by_sorting(docs, [])
    assert resampled(none, odd) == []


def by_sets(docs, resemblance=85):
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", lower(text))
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    sets, label = [shingles(t) for _, t in docs], list(range(len(docs)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= resemblance * len(a | sets[j]):
                label[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    out = []
    for i, (key, _) in enumerate(docs):
        own = least[find(i)] if sets[i] else key
        out.append((key, len(sets[i]), own, key == own))
    return sorted(out, key=repr)


def edited(words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"w{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("hot", [minhash.HOT, 1])
def test_minhash_equals_brute_force(spark, monkeypatch, hot):
    if hot == 1:
        monkeypatch.setattr(minhash, "_PROBE", 1)
    docs = []
    for n in (5, 8, 20, 60, 200, 700):
        base = [f"v{rng.randrange(10**9)}" for _ in range(n)]
        docs += [(" ".join(base))] * 3 + [edited(base, rng.randrange(1 + max(1, n // 45))) for _ in range(12)]
        docs += [" ".join(base[:n - k]) for k in range(1, n // 6 + 2)]
    docs += ["one two", "One  two", "three", "", " \n", None, "\x0b"]
    docs = [(i if i % 7 else None, t) for i, t in enumerate(rng.sample(docs, len(docs)))] + [(11, "one two"), (12, "lone")] * 2
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_sets(docs)


def test_sketches_are_the_published_ones():
    """Round by round, one shingle at a time."""
    t = 16
    for n in (1, 3, 40):
        hashed = np.array([rng.randrange(2**63) for _ in range(n)], np.uint64)
        want = [None] * t
        for i in range(2 * t):
            for x in hashed:
                drawn = int(minhash.mixed(np.array([x + minhash._ROUNDS[i]], np.uint64), 22)[0])
                place = ((drawn >> 32) * t) >> 32 if i < t else i - t
                value = (i << 32) | (drawn & 0xFFFFFFFF)
                want[place] = value if want[place] is None else min(want[place], value)
        assert minhash.sketch(hashed, t).tolist() == want


def test_sketch_in_parts_equals_the_whole(monkeypatch):
    hashed = np.array([rng.randrange(2**63) for _ in range(900)], np.uint64)
    whole = minhash.sketch(hashed)
    monkeypatch.setattr(minhash, "_CELLS", 100)
    assert (minhash.sketch(hashed) == whole).all()


def test_minhash_on_odd_and_empty(odd, none):
    found = sorted((tuple(r) for r in minhash.near_duplicates(odd).collect()), key=repr)
    assert found == by_sets([(r.doc_id, r.text) for r in odd.collect()])
    assert minhash.near_duplicates(none).count() == 0
