"""Names of units, ids beside null ones, equally long rules and rare labels."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metrosift.llm import language_id, packing, segments, token_counts, url_filter


def thue_morse(n, x, y):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join((x, y)[b] for b in bits[:n]), "".join((y, x)[b] for b in bits[:n])


WORDS = [w for x, y in (("lo", "la"), ("ab", "ba"), ("q", "z"), ("one", "two")) for w in thue_morse(1024, x, y)]


def test_segments_are_told_apart():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 30_000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 29_000, 8000))
    ends = starts + rng.integers(0, 40, len(starts))
    ends[7] = starts[7] + 900
    texts = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    for n in (1, 2):
        names = list(zip(*[h.tolist() for h in segments.hashes(data, starts, ends, n)]))
        assert len(set(names)) == len(set(zip(names, texts))) == len(set(texts))
    repeated = np.frombuffer("".join(WORDS).encode(), np.uint8)
    edges = np.cumsum([0, *map(len, WORDS)])
    for found in segments.hashes(repeated, edges[:-1], edges[1:]):
        assert len(set(found.tolist())) == len(WORDS)


def test_words_of_repeated_syllables_are_counted_apart(spark):
    library = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))
    docs = [(i, w) for i, w in enumerate(WORDS)] + [(100, " ".join(WORDS))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in docs}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert counts == {k: len(v) for k, v in ids.items()}
    whole = [r for r in packing.pack_documents(df, keep_ids=True).collect()]
    for key, want in ids.items():
        pieces = sorted((r for r in whole if r.doc_id == key), key=lambda r: r.piece)
        assert [i for r in pieces for i in r.ids] == [*want, 0]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)


def test_large_ids_stay_whole_beside_null_ones(spark):
    ids = [2**60 + 1, 2**60 + 3, None, 2**62 + 1, -(2**60) - 1]
    df = spark.createDataFrame([(i, "a few words " * n) for n, i in enumerate(ids)], "doc_id long, text string")
    found = packing.pack_documents(df).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted(ids, key=repr)
    assert all(r.length <= packing.LENGTH for r in found)


def test_packing_goes_on_while_pieces_get_fewer(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(300, 900, 4000)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing._PIECE)
    packed = packing.pack_pieces(pieces, 2048, per_part=200).toPandas()
    assert sorted(packed["doc_id"]) == list(range(4000))
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 2048
    bound, used = packing.lower_bound(lengths, 2048), packed["sequence_id"].nunique()
    assert used <= 1.03 * bound


def test_equally_long_rules_win_alike_by_both_ways(spark, monkeypatch):
    rules = spark.createDataFrame([("allow", "com", "/abcde"), ("block", "a.com", "/abc"), ("allow", "b.com", "/x"), ("block", "b.com", "/x")],
                                  "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/abcde"), (2, "http://b.com/xy"), (3, None), (4, "http://z.org/"),
                                   (5, "http://" + "a." * 40 + "com/" + "abcde" * 3000)], "page_id long, url string")
    rows = lambda: sorted(tuple(r) for r in url_filter.judge_urls(pages, rules).select("page_id", "rule", "verdict").collect())
    cascade = rows()
    monkeypatch.setattr(url_filter, "MAX_CASCADE_BYTES", 0)
    assert rows() == cascade
    assert cascade[:4] == [(1, "a.com/abc", "block"), (2, "b.com/x", "block"), (3, None, "allow"), (4, None, "allow")]
    assert cascade[4][1:] == ("a.com/abc", "block")


def test_hashes_of_keys_are_independent(spark):
    first, second = url_filter.hash_pair(F.col("k"))
    chained = spark.createDataFrame([("a",), ("b",), ("c",)], "k string").select(
        (F.xxhash64("k", F.lit("second")) == second).alias("same"), (first == second).alias("equal"))
    assert [tuple(r) for r in chained.distinct().collect()] == [(False, False)]


def test_rare_languages_and_letterless_rows(spark):
    docs = [(i, f"the house stands by the road number {i}", "en") for i in range(3000)]
    docs += [(5000 + i, "das kleine Haus steht neben der Straße", "de") for i in range(3)] + [(6000 + i, f"{i} 123 !!!", "xx") for i in range(500)]
    docs += [(None, "one row many times over", "en")] * 1000
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(df, sample_rows=100)
    assert model.languages == ("de", "en")
    found = language_id.predict(spark.createDataFrame([("das kleine Haus",), ("the road by the house",)], "text string"), model)
    assert [r.lang_pred for r in found.collect()] == ["de", "en"]
