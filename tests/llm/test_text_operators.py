"""Each text operator against brute force, and on odd and empty tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metrosift.llm import fingerprints, language_id, mixing, packing, pitman_yor, simhash, suffix_dedup, token_counts
from metrosift.llm.common import words_of
from odd_rows import none, odd  # noqa: F401

rng = random.Random(5)
ALPHABET = "abcdefghij klmno"


def letters(n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def by_windows(docs, length=100):
    seen, out = set(), collections.defaultdict(list)
    for key, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i:i + length]
            if window in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(window)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(data)))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[key].append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def found_repeats(df, **how):
    out = collections.defaultdict(list)
    for r in suffix_dedup.find_repeats(df, **how).collect():
        out[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("crowded,range_bytes", [(4096, 1 << 20), (32, 20_000)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowded, range_bytes):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    line, passage = letters(130), letters(400)
    docs = [(i, letters(rng.randrange(150)) + line[rng.randrange(8):] + letters(rng.randrange(200))) for i in range(400)]
    docs += [(1000 + i, passage[rng.randrange(300):][:rng.randrange(350)] + letters(50)) for i in range(60)]
    docs += [(2000 + i, "ab" * rng.randrange(200)) for i in range(20)] + [docs[3], docs[3], (None, line), (None, line), (9000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_repeats(df, range_bytes=range_bytes) == by_windows(docs)


def test_interval_bounds_are_common_prefixes():
    symbols = np.array([rng.choice([1, 2]) for _ in range(300)] + [0], np.int16)
    order = suffix_dedup.suffix_order(symbols, 12)
    bound = suffix_dedup.interval_bounds(symbols[order - 1], 12)
    prefix = [tuple(symbols[i:i + 12]) for i in order]
    assert prefix == sorted(prefix)
    assert bound[1:-1].tolist() == [a != b for a, b in zip(prefix, prefix[1:])]


def test_repeats_on_odd_and_empty(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found_repeats(odd) == by_windows(docs)
    left = suffix_dedup.remove_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert suffix_dedup.find_repeats(none).count() == 0


def test_tokens_equal_the_library(odd, none):
    path = token_counts.tokenizer_path(token_counts.TOKENIZER)
    library = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in odd.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 1024)] += 1
    got = token_counts.count_tokens(odd)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    assert token_counts.count_tokens(none).count() == 0


def test_packing_is_whole_and_exact(odd, none):
    library = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))
    got = packing.pack_documents(odd).collect()
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    want = collections.Counter()
    for r in odd.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        start, stop, piece = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            want[(r.doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()))] += 1
            start, stop, piece = stop, stop + 2048, piece + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.pack_documents(none).count() == 0


def test_packing_bound_and_exchange(spark):
    lengths = np.array([rng.randrange(1, 2049) for _ in range(3000)])
    bins, offsets = packing.best_fit_decreasing(lengths, 2048)
    assert np.bincount(bins, lengths).max() <= 2048
    assert packing.lower_bound(lengths, 2048) <= bins.max() + 1
    assert packing.lower_bound(np.full(9, 700), 2048) == 5 and packing.lower_bound(np.full(7, 1100), 2048) == 7
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing._PIECE)
    packed = packing.pack_pieces(pieces, per_part=100)
    assert packed.count() == 3000
    used = packed.select("sequence_id").distinct().count()
    assert packing.lower_bound(lengths, 2048) <= used <= packing.lower_bound(lengths, 2048) * 1.05


def plain_simhash(text, k):
    import xxhash

    words = words_of(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_bits():
    for text in ("", "one two", "A b C d e f g h", "x " * 500 + "y z"):
        assert simhash.fingerprint(text) == plain_simhash(text, 3)


@pytest.mark.parametrize("distance", [3, 7])
def test_links_connect_what_all_pairs_would(spark, distance):
    own = np.random.default_rng(distance)
    fps = [int(x) for x in own.integers(0, 2**63, 80)]
    for x in fps[:40]:
        for _ in range(5):
            for bit in own.choice(64, own.integers(1, distance + 2), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance)
    want = simhash._joined(np.arange(len(fps)), a, b)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    links = simhash.near_links(df, distance, per_bucket=500).collect()
    got = simhash._joined(np.arange(len(fps)), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert (want == got).all()


def test_near_duplicates_on_odd_and_empty(odd, none):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(2, 2), (3, 2), (4, 2), (6, 6)} <= got
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(none).count() == 0


def test_wide_links_connect_what_the_rule_says(spark):
    own = np.random.default_rng(4)
    ring = simhash.WideRing(2, 6, 0.16)
    fps = [own.integers(0, 2, 128) for _ in range(30)]
    for start in fps[:20]:
        for _ in range(6):
            copy = start.copy()
            copy[own.choice(128, own.integers(0, 30), replace=False)] ^= 1
            fps.append(copy)
    bits = np.unique(np.array(fps), axis=0)
    edges = np.concatenate([64 * w + np.array([64 * i // 6 for i in range(6)]) for w in range(2)])
    per = np.add.reduceat(bits[:, None, :] ^ bits[None, :, :], edges, axis=2)
    linked = np.zeros(per.shape[:2], bool)
    for i in range(12):
        chain = np.cumsum(np.roll(per, -i, axis=2), axis=2)
        linked |= (chain[..., 0] == 0) & (chain[..., 1] <= 1) & (chain[..., 2] <= 3 * 20 // 12) & (chain[..., 3] <= 4 * 20 // 12)
    linked &= per.sum(2) <= 20
    want = simhash._joined(np.arange(len(bits)), *np.nonzero(linked))
    packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(packed)], "node long, fp binary")
    links = simhash.wide_links(df, ring, per_bucket=300).collect()
    got = simhash._joined(np.arange(len(bits)), np.array([r.a for r in links]), np.array([r.b for r in links]))
    assert len(set(want)) < len(want) and (want == got).all()


def test_near_copies_by_resemblance(spark, odd, none):
    words = [f"w{i}" for i in range(3000)]
    rows, cases = [], 40
    for c in range(cases):
        text = [rng.choice(words) for _ in range(200)]
        close, far = list(text), list(text)
        for at in (30, 90, 150):  # 15 of 196 shingles change: resemblance 0.86
            close[at] = "changed"
        far[:100] = [rng.choice(words) for _ in range(100)]  # about a third is left in common
        rows += [(10 * c + i, " ".join(t)) for i, t in enumerate((text, close, far, text))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert all(got[10 * c + 3] == 10 * c and got[10 * c + 2] == 10 * c + 2 for c in range(cases))
    assert sum(got[10 * c + 1] == 10 * c for c in range(cases)) >= 0.9 * cases
    found = {(r.doc_id, r.component_id) for r in simhash.near_copies(odd).collect()}
    assert {(2, 2), (3, 2), (4, 2), (6, 6)} <= found
    assert simhash.near_copies(odd).count() == odd.count()
    assert simhash.near_copies(none).count() == 0


def resemblance(a, b, k=5):
    a, b = ({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} for w in (words_of(a), words_of(b)))
    return len(a & b) / len(a | b)


def changed(words, places):
    return [f"new{i}" if i in places else w for i, w in enumerate(words)]


def test_near_copies_are_exactly_those_of_resemblance(spark):
    own, rows, want = random.Random(3), [], {}
    # 400 shingles, of which 9 words change 45 (0.798) or 8 words 40 (0.818); then 0.80 to 0.82 and 0.75 by an own tail
    for c, tail in enumerate([40, 42, 44, 57] * 40):
        words = [f"{c}-{own.randrange(10**6)}" for _ in range(404)]
        other = words[:404 - tail] + [f"{c}-own{i}" for i in range(tail)]
        if c % 8 > 3:
            other = changed(words, [20 + 40 * i for i in range(8 if tail < 44 else 9 if tail == 44 else 12)])
        rows += [(2 * c, " ".join(words)), (2 * c + 1, " ".join(other))]
        want[2 * c + 1] = 2 * c if resemblance(rows[-1][1], rows[-2][1]) >= 0.8 else 2 * c + 1
    few = [(1000 + i, " ".join(f"few{j}" for j in range(8 + i))) for i in range(2)]  # 4 of 5 shingles
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows + few, "doc_id long, text string")).collect()}
    true = {k for k, v in want.items() if v != k}
    assert 80 <= len(true) <= 130
    assert all(got[k] == k for k in want if k not in true)
    assert sum(got[k] == want[k] for k in true) >= len(true) - 1


@pytest.mark.parametrize("per_block", [1000, 7])
def test_exact_links_connect_what_all_pairs_would(spark, per_block):
    own, rows, texts = np.random.default_rng(9), [], {}
    for c in range(4):
        start = [f"{c}w{i}" for i in range(124)]
        for i in range(40):  # chains: each a few words from an earlier one
            source = texts[c * 100 + own.integers(0, i)] if i else start
            texts[c * 100 + i] = changed(source, {}) if not i else [
                f"{c}x{i}-{j}" if j in own.choice(124, own.integers(1, 6), replace=False) else w for j, w in enumerate(source)]
    for node, words in texts.items():
        s = simhash.shingle_set(" ".join(words))
        rows.append((node // 100, node, len(s), bytearray(s.astype("<u8").tobytes())))
    nodes = sorted(texts)
    pairs = [(i, j) for i in range(len(nodes)) for j in range(i) if nodes[i] // 100 == nodes[j] // 100
             and resemblance(" ".join(texts[nodes[i]]), " ".join(texts[nodes[j]])) >= 0.8]
    want = simhash._joined(np.arange(len(nodes)), *np.array(pairs).T)
    df = spark.createDataFrame(rows, "component long, node long, size long, hashes binary")
    at = {n: i for i, n in enumerate(nodes)}
    links = simhash.exact_links(df, 0.8, per_block).collect()
    got = simhash._joined(np.arange(len(nodes)), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert 4 < len(set(want)) < len(nodes) and (want == got).all()


def test_mix_meets_targets(odd, none):
    docs, draws = mixing.draw_mix(odd, per_block=1, per_shard=20_000)
    rows, drawn = docs.collect(), draws.collect()
    sizes = {r.row: r.size for r in rows}
    assert len(rows) == odd.count()
    assert sum(sizes.values()) == sum(len(words_of(r.text)) for r in odd.collect())
    taken, per_source = collections.Counter(), collections.Counter()
    for r in drawn:
        taken[r.row] += r.n_words
        per_source[r.source] += r.n_words
    assert all(taken[k] <= 2 * n for k, n in sizes.items())
    for r in rows:
        assert per_source[r.source] == math.floor(r.target) and r.target <= 2 * r.source_size
    assert len({(r.shard, r.position) for r in drawn}) == len(drawn)
    assert sorted(map(tuple, mixing.draw_mix(odd, per_block=1, per_shard=20_000)[1].drop("row").collect()), key=str) == sorted(
        map(tuple, draws.drop("row").collect()), key=str)
    assert mixing.mix_documents(odd, share=1.0).columns == odd.columns
    assert [d.count() for d in mixing.draw_mix(none)] == [0, 0]


def test_quota_tree_is_exact_and_fair(spark):
    quotas = [7, 400, 0, 93]
    root = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    leaves = np.array([r.quotas for r in mixing.split_quotas(root, 3, seed=1).collect()])
    assert leaves.shape == (8, 4) and leaves.sum(0).tolist() == quotas
    assert leaves.sum(1).max() - leaves.sum(1).min() <= 3
    shares = [mixing.split_quotas(root, 1, seed=s).where("shard = 0").first().quotas[1] for s in range(12)]
    assert len(set(shares)) > 3 and abs(np.mean(shares) - 200) < 10


def test_language_model_counts_and_base(odd, none):
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    docs = [((r.text or "").encode().translate(low).split() + [0], r.doc_id) for r in odd.collect()]
    counts = collections.Counter()
    for words, key in docs:
        if key is None or zlib.crc32(str(key).encode()) % 10:
            counts.update(words)
    total, types = sum(counts.values()), len(counts)
    want = sorted((len(w), sum(counts[x] > 0 for x in w), total,
                   round(sum(math.log10((counts[x] + .1) / (total + .1 * (types + 1))) for x in w), 6)) for w, _ in docs)
    got = pitman_yor.score_texts(odd, held, part_bytes=40_000, bucket_bytes=60_000).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert pitman_yor.score_texts(none, held).count() == 0


def test_seating_follows_the_restaurant():
    own = np.random.default_rng(0)
    c = np.array([1, 2, 10, 1000, 0])
    tables = np.mean([pitman_yor.seat(c, np.full(5, 0.5), 0.5, own) for _ in range(300)], axis=0)
    assert tables[0] == 1 and tables[4] == 0
    assert abs(tables[1] - (1 + 0.5 / (0.5 + 1 - 0.5))) < 0.1  # the second opens a table with odds 0.5 : 0.5
    assert tables[1] < tables[2] < tables[3] < 50


def test_contexts_are_the_words_before():
    ids, before, text = pitman_yor.token_pairs(pa.array(["a b A", None, "b a"]))
    assert text.tolist() == [0, 0, 0, 0, 1, 2, 2, 2]
    assert before.tolist() == [pitman_yor._START, *ids[:3], pitman_yor._START, pitman_yor._START, *ids[5:7]]
    many, _, _ = pitman_yor.token_pairs(pa.array([" ".join(f"w{i}" for i in range(3000))]))
    _, before, _ = pitman_yor.token_pairs(pa.array([" ".join(f"w{i} x" for i in range(3000))]))
    assert len(set(before.tolist()) - {int(many[0])}) == 3001  # before: 32 classes


def test_tables_are_drawn_by_their_exact_distribution():
    rng, d = np.random.default_rng(1), 0.4
    ways = [[0.0] * 7 for _ in range(7)]
    ways[1][1] = 1.0
    for c in range(1, 6):
        for t in range(1, c + 2):
            ways[c + 1][t] = ways[c][t - 1] + (c - d * t) * ways[c][t]
    odds = np.array([ways[6][t] * math.prod(0.7 + d * k for k in range(t)) for t in range(1, 7)])
    drawn = pitman_yor.draw_tables(np.full(40_000, 6), d, lambda rows, k: 0.7 + d * k + 0.0 * rows, rng)
    share = np.bincount(drawn.astype(int), minlength=7)[1:] / 40_000
    assert np.abs(share - odds / odds.sum()).max() < 0.01
    some = pitman_yor.draw_tables(np.array([0, 1, 2, 5000]), d, lambda rows, k: 0.7 + d * k + 0.0 * rows, rng)
    assert some[:2].tolist() == [0, 1] and some[2] <= 2 and 1 < some[3] < 500


def test_language_model_learns_word_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    follows = rng.permutation(300)  # each word has one that mostly follows, far more than 32 classes tell
    docs = []
    for i in range(240):
        at, text = int(rng.integers(300)), []
        for _ in range(80):
            text.append(words[at])
            at = int(follows[at]) if rng.random() < 0.9 else int(rng.integers(300))
        docs.append((i, " ".join(text)))
    ends = [(1000 + i, f"w7 {w}") for i, w in enumerate(words)] + [(2000, "w7"), (2001, "w7 unseen")]
    table = spark.createDataFrame(docs + ends, "doc_id long, text string")
    held = (F.col("doc_id") >= 1000) | (F.col("doc_id") % 10 == 0)
    scores = []
    for bucket_bytes in (1 << 30, 60_000):
        got = {r.doc_id: r for r in pitman_yor.score_texts(table, held, part_bytes=60_000, bucket_bytes=bucket_bytes).collect()}
        out = [got[i] for i in range(0, 240, 10)]
        scores.append(sum(r.score for r in out) / sum(r.n_tokens for r in out))
        assert scores[-1] > sum(r.base_score for r in out) / sum(r.n_tokens for r in out) + 1.0
        best = max(range(300), key=lambda i: got[1000 + i].score)
        assert best == follows[7]
    assert abs(scores[0] - scores[1]) < 0.02  # totals are exact, whatever the buckets


def test_edits_and_sketches(odd, none):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    want = collections.Counter()
    for i, (key, text) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        want[(key, len(text), text[:len(text) - half] + following[:half])] += 1
    got = fingerprints.fingerprint_edits(odd).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_text) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[1000:]), " ".join(words))], "a string, b string, c string")
    for c in "abc":
        rows = fingerprints.with_sketch(rows, c, f"s{c}", 1)
    r = rows.select(
        (fingerprints.merged(F.col("sa"), F.col("sb")) == F.col("sc")).alias("merges"),
        fingerprints.resemblance(F.col("sa"), F.col("sb")).alias("alike"),
        fingerprints.containment(F.col("sa"), F.col("sc")).alias("inside"),
        fingerprints.distinct_shingles(F.col("sc")).alias("n")).first()
    assert r.merges and abs(r.alike - 1 / 3) < 0.2 and r.inside > 0.7 and 2000 < r.n < 4500


def test_languages(spark, odd, none):
    said = {"en": "the of and to that with house", "de": "der die und nicht mit haus ich"}
    docs = [(i, " ".join(rng.choice(said[k].split()) for _ in range(30)), k) for i in range(200) for k in said]
    train = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(train)
    got = language_id.predict(train, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    rest = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (7, "und", 0.0)} <= rest
    assert all(0 <= s <= 1 for _, _, s in rest)
    unknown = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(odd, unknown).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0
