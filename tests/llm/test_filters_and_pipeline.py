"""URL rules, vector search, the registered queries' SQL twins and the pipeline."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from metrosift.llm import simhash, topk_search, url_filter
from metrosift.llm.queries import ORACLES, QUERIES
from odd_rows import none, odd  # noqa: F401

FOLDER = os.path.join(os.environ.get("METROSIFT_DATA", "/root/testdata"), os.environ.get("METROSIFT_TEST_SF", "sf0.01"))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), ORACLES[name]) is None


def test_rules_on_odd_urls(spark):
    urls = ["http://www.Example.COM/en/x?a#b", "https://a.example.com/en/", "http://example.com", "ftp://x.net/es/1", None, "",
            "no scheme", "http://notexample.com/", "http://x.net/es", "//x", "http://h.net/fr/?q", "http://h.net/fr/?q"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("example.com", "", None, "allow") and got[3] == ("x.net", "/es/1", "net/es/", "block")
    assert all(got[i] == ("", "", None, "allow") for i in (4, 5, 6, 9))
    assert got[7] == ("notexample.com", "/", "com/", "allow") and got[8] == ("x.net", "/es", None, "allow")
    assert got[10] == got[11] == ("h.net", "/fr/", "net/fr/", "block")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("key like '%7'")
    cascade = url_filter.build_cascade(listed, keys.union(keys))
    import numpy as np

    a, b = (np.array(c, np.int64).view(np.uint64) for c in zip(*keys.select(*url_filter.hash_pair(F.col("key"))).collect()))
    want = [r.key.endswith("7") for r in keys.collect()]
    assert cascade.contains(a, b).tolist() == want and len(cascade.levels) > 1
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("block", "com", "/")], "verdict string, host string, path string")
    monkeypatch.setattr(url_filter, "MAX_CASCADE_BYTES", 0)
    assert url_filter.judge_urls(pages, rules).first().rule == "com/"


def test_search_on_odd_vectors(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(300)]
    rows += [(300, None), (301, [None] * 20), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (304, []), (None, [1.0] * 20),
             (305, rows[40][1]), (306, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, candidates_per_block=64, queries_per_block=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    import math

    import numpy as np

    own = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in own if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q)[:20]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spoken = corpus_pipeline.keep_languages(spark, docs, "")
    assert spoken.columns == docs.columns
    copies = spark.createDataFrame(
        [(i, " ".join(f"w{j}" for j in range(300)) + f" end{i}", "en", "a", 10) for i in (3, 5)]
        + [(9, " ".join(f"v{j}" for j in range(300)), "en", "b", 10)], docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, copies, "").collect()) == [3, 9]
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, copies, "").collect()}
    assert cut[5].n_chars < 110 and cut[3].text.endswith("end3") and cut[9].n_chars == len(cut[9].text)
    mixed = corpus_pipeline.mix_sources(spark, copies, "")
    assert mixed.columns == docs.columns and mixed.count() >= 2
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, none.select(*docs.columns), "").count() == 0


def test_one_row_of_each_group_stays(spark):
    def text(k, end=""):
        return " ".join(f"{k}{j}" for j in range(300)) + end

    rows = [(1, text("a")), (2, text("a", " z")), (2, text("b")),  # the copy goes, the other text of its id stays
            (3, text("c", " y")), (3, text("c", " x")), (3, text("c", " x")),  # one id, tied by text and then any
            (None, text("d")), (None, text("d")), (None, text("e")), (7, text("e", " z")), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == [
        (0, text("d")), (1, text("a")), (2, text("b")), (3, text("c", " x")), (7, text("e", " z"))]


def test_near_copies_meet_in_chains_on_rings(spark, monkeypatch):
    import numpy as np

    rings, links = [], simhash.wide_links
    monkeypatch.setattr(simhash, "wide_links", lambda fps, ring, *more: rings.append(ring) or links(fps, ring, *more))
    docs = spark.createDataFrame([(1, "a b", "en", "a", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 1  # the stage's own ring
    ring, own = rings[0], np.random.default_rng(6)
    edges = np.concatenate([64 * w + np.array([64 * i // 6 for i in range(6)]) for w in range(6)])
    size = np.diff(np.append(edges, 384))

    def labels(bits):
        packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
        df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(packed)], "node long, fp binary")
        found = links(df, ring, 500).collect()
        return simhash._joined(np.arange(len(bits)), np.array([r.a for r in found], int), np.array([r.b for r in found], int))

    # one bit in each segment but one: pigeonring's rule finds every such pair
    first = own.integers(0, 2, (2000, 384))
    second, free = first.copy(), own.integers(0, 36, len(first))
    for i, kept in enumerate(free):
        at = (edges + own.integers(0, size))[np.arange(36) != kept]
        second[i, at] ^= 1
    both = labels(np.concatenate((first, second)))
    assert (both == np.tile(np.arange(len(first)), 2)).all()
    # farther copies: linked as the chains of all rings say, up to 96 bits
    start = own.integers(0, 2, (300, 384))
    copies = start ^ (own.random(start.shape) < own.uniform(0.1, 0.3, (300, 1)))
    per = np.add.reduceat(start ^ copies, edges, axis=1)
    near = np.zeros(300, bool)
    for step in (1, 5, 7, 11):
        for i in range(36):
            chain = np.cumsum(per[:, (i + step * np.arange(6)) % 36], axis=1)
            near |= (chain[:, 0] == 0) & (chain[:, 1] <= 1) & (chain[:, 2:] <= np.arange(3, 7) * 96 // 36).all(1)
    near &= per.sum(1) <= 96
    assert 30 < near.sum() < 270
    assert (labels(np.concatenate((start, copies))) == np.concatenate((np.arange(300), np.where(near, np.arange(300), np.arange(300, 600))))).all()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
