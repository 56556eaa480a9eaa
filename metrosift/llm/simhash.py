"""Near duplicates by SimHash, with candidates found by pigeonring filtering.

Two fingerprints within t bits, cut into m = t + 1 segments on a ring, must have a
segment from which every chain of l segments differs in at most l * t / m bits. So its
first segment is equal and the first two differ in one bit at most: those rows share the
key (segment, next segment without one bit). Longer chains prune the pairs under a key
before the whole distance is counted.

A resemblance of 0.8 lies about 15 percent of the bits apart, where t + 1 segments leave
keys of no use. ``near_copies`` is the form for such distances: fingerprints of several
words in fewer segments, on several rings that order the same segments differently. Its
keys and chains are those above, so pairs that differ in fewer bits than there are
segments are all found; farther ones have many such chains and are found by one of the
rings with high probability. They are candidates; texts link if the exact resemblance of
their shingle sets says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import gcd

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.llm.common import mixed, runs, table, words_of
from metrosift.operators.graph import components
from metrosift.operators.joins import join_lookup
from metrosift.session import stage

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Keyed rows of a bucket, about; the number of buckets grows with the fingerprints.
PER_BUCKET = 1_000_000
_BLOCK = 1 << 16
#: Near copies: the least resemblance of their shingle sets.
RESEMBLANCE = 0.8
#: Wide fingerprints: words of 64 bits, segments in each, and the share of bits in which candidates may differ. A
#: resemblance of 0.8 lies 15 percent apart on average, and 19 percent where sets hold four or five shingles.
WIDTH, CUTS, SHARE = 6, 6, 0.25
#: Rings of candidates: each goes round all segments in steps of its own, prime to their number. Chains are pruned up to
#: this length. Four rings miss 0.3 percent of the pairs that lie 15 percent apart, and 5 percent at 19 (simulated).
STEPS, CHAIN = (1, 5, 7, 11), 6
#: Segments of wide fingerprints that one task compares, about.
PER_WIDE_BUCKET = 20_000
#: Texts and shingles of candidates that one block of an exact comparison holds, about, and hubs every block meets.
BLOCK_TEXTS, BLOCK_SHINGLES, HUBS = 1000, 1_000_000, 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text's word shingles, repeats included; no words give 0."""
    words = words_of(text)
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return digest(join(words), SEED)
    tally = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, _BLOCK):
        part = words[at:at + _BLOCK + shingle - 1]
        hashed = np.array([digest(s, SEED) for s in map(join, zip(*(part[i:] for i in range(shingle))))], "<u8")
        tally += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(tally * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``, the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(of, "doc_id long, fp long")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a whole text's distinct word shingles; a text with fewer words is one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return np.array([digest(join(words), SEED)], np.uint64)
    return np.unique(np.fromiter((digest(s, SEED) for s in map(join, zip(*(words[i:] for i in range(shingle))))),
                                 np.uint64, len(words) - shingle + 1))


def wide_fingerprint(hashed: np.ndarray, width: int = WIDTH) -> bytes:
    """SimHash of a shingle set, ``width`` words of 64 bits; each word has a hash of its own. An empty set gives zeros."""
    tally = np.zeros(64 * width, np.int64)
    for at in range(0, len(hashed), 4096):
        own = np.stack([mixed(hashed[at:at + 4096], 100 + k) for k in range(width)], axis=1).astype("<u8")
        tally += np.unpackbits(own.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(tally * 2 > len(hashed), bitorder="little").tobytes()


class Ring:
    """The segments of a 64-bit fingerprint for distances up to ``distance`` (1 to 20)."""

    def __init__(self, distance: int) -> None:
        self.distance, self.m = distance, distance + 1
        bounds = [64 * i // self.m for i in range(self.m + 1)]
        self.segments = [((1 << bounds[i + 1]) - (1 << bounds[i])) for i in range(self.m)]
        self.kinds = []  # (first segment, mask of the bits the key takes)
        for i in range(self.m):
            after = (i + 1) % self.m
            for bit in range(bounds[after], bounds[after + 1]):
                self.kinds.append((i, self.segments[i] | (self.segments[after] & ~(1 << bit))))
        self.first = np.array([i for i, _ in self.kinds])
        self.masks = np.array([m for _, m in self.kinds], np.uint64)
        # chains[l - 1][i]: the bits of l segments from i on
        self.chains = [np.array([sum(self.segments[(i + k) % self.m] for k in range(length)) for i in range(self.m)], np.uint64)
                       for length in range(1, self.m + 1)]

    def keys(self, fps: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((fps & self.masks[kinds]) + mixed(kinds.astype(np.uint64), 5))

    def near(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of the pairs within the distance whose chains from ``first`` keep to their budgets.

        A pair that fails here passes under another key, or is too far apart.
        """
        differing, at = a ^ b, np.arange(len(a))
        for length in range(2, self.m + 1):
            budget = length * self.distance // self.m
            ok = np.bitwise_count(differing & self.chains[length - 1][first]) <= budget
            differing, first, at = differing[ok], first[ok], at[ok]
        return at


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows a and b: the least number of each component."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            higher = label[label]
            if (higher == label).all():
                break
            label = higher
    return label


def connecting(number: np.ndarray, keys: np.ndarray, near: Callable, label: np.ndarray | None = None) -> np.ndarray:
    """Label of each number after all near pairs under a common key are linked; rows are sorted by key.

    Numbers of one ``label`` are linked already; without it none are.

    All pairs under a key are compared, at growing offsets, but only pairs not yet
    connected are kept, so memory stays in proportion to the rows. Keys whose rows are all
    connected are left out from then on, so a group of near copies costs a few offsets.
    ``near(rows, others)`` gives the places of the pairs that link.
    """
    label = np.arange(int(number.max()) + 1 if len(number) else 0) if label is None else label
    starts = runs(keys)
    size = np.repeat(np.diff(starts), np.diff(starts))
    place = np.arange(len(keys)) - np.repeat(starts[:-1], np.diff(starts))
    offset, check, rows = 1, 2, np.arange(len(keys))
    while True:
        rows = rows[place[rows] + offset < size[rows]]
        if not len(rows):
            return label
        if offset == check:
            own = label[number]
            apart = np.minimum.reduceat(own, starts[:-1]) != np.maximum.reduceat(own, starts[:-1])
            rows, check = rows[np.repeat(apart, np.diff(starts))[rows]], check * 2
        for at in range(0, len(rows), 1 << 18):
            part = rows[at:at + (1 << 18)]
            part = part[label[number[part]] != label[number[part + offset]]]
            hit = part[near(part, part + offset)]
            label = _joined(label, number[hit], number[hit + offset])
        offset += 1


def links_within(fps: np.ndarray, keys: np.ndarray, kinds: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all near fingerprints under a common key: at most one per fingerprint.

    Distinct fingerprints alone come here, and those of one key lie within few bits of each other.
    """
    order = np.lexsort((fps, keys))
    fps, keys, first = fps[order], keys[order], ring.first[kinds[order]]
    own, number = np.unique(fps, return_inverse=True)
    label = connecting(number, keys, lambda a, b: ring.near(fps[a], fps[b], first[a]))
    linked = np.flatnonzero(label != np.arange(len(own)))
    return own[linked], own[label[linked]]


def near_links(fps: DataFrame, distance: int = DISTANCE, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fp`` as all pairs within ``distance`` would.

    Tasks send arrays per bucket of keys, nine bytes a key. There are no caps: under every
    key all pairs count.
    """
    ring, n = Ring(distance), fps.count()
    buckets = max(1, -(-n * len(ring.kinds) // per_bucket))
    dealt_schema = pa.schema([("bucket", pa.int64()), ("fps", pa.binary()), ("kinds", pa.binary())])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(own), 8192):
                part = np.repeat(own[at:at + 8192], len(ring.kinds))
                kinds = np.tile(np.arange(len(ring.kinds)), len(part) // len(ring.kinds))
                bucket = (ring.keys(part, kinds) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                part, kinds, bucket = part[order], kinds[order].astype(np.uint8), bucket[order]
                cuts = runs(bucket)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cuts[:-1]]),
                    pa.array([part[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([kinds[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary())], schema=dealt_schema)

    def link(rows: pa.Table) -> pa.Table:
        own = np.frombuffer(b"".join(rows["fps"].to_pylist()), np.uint64)
        kinds = np.frombuffer(b"".join(rows["kinds"].to_pylist()), np.uint8).astype(np.int64)
        a, b = links_within(own, ring.keys(own, kinds), kinds, ring)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=link_schema)

    dealt = fps.select("fp").mapInArrow(deal, "bucket long, fps binary, kinds binary")
    return dealt.groupBy("bucket").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``.

    component_id is the smallest doc_id reachable by links of at most ``distance`` bits,
    the row's own included. Rows of one fingerprint, such as exact copies, are met by one
    representative, so a group of any size adds one fingerprint. Null and empty texts
    have fingerprint zero and are linked like any other. Null ids never name a component
    unless all its ids are null. Other columns are not carried; no rows give no rows.
    """
    own = stage(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    if distance == 0:
        named = distinct.select("fp", F.col("least").alias("component_id"))
    else:
        linked = stage(components(near_links(distinct, distance)), "components")
        members = linked.join(distinct, linked["node"] == distinct["fp"]).select("fp", "component", "least")
        groups = members.groupBy("component").agg(F.min("least").alias("component_id"))
        joined = members.join(groups, "component").select("fp", "component_id")
        named = distinct.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return join_lookup(own, stage(named, "named"), ["fp"]).select("doc_id", "fp", "component_id")


class WideRing:
    """Segments of fingerprints of several words; none crosses a word's end.

    Each of ``steps`` orders all segments on a ring of its own, so it must be prime to
    their number. On every ring pigeonring's rule holds.
    """

    def __init__(self, width: int, cuts: int, share: float, steps: tuple[int, ...] = (1,), chain: int = 4) -> None:
        bounds = [64 * i // cuts for i in range(cuts + 1)]
        self.m, self.width, self.most = width * cuts, width, int(64 * width * share)
        self.steps, self.chain = steps, chain
        if any(gcd(step, self.m) > 1 for step in steps):
            raise ValueError(f"Steps {steps} do not all go round {self.m} segments")
        self.word = np.repeat(np.arange(width), cuts)
        self.low = np.tile(np.array(bounds[:-1], np.uint64), width)
        self.bits = np.tile(np.diff(bounds), width)
        self.mask = np.array([((1 << int(n)) - 1) << int(at) for n, at in zip(self.bits, self.low)], np.uint64)

    def segment(self, fps: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (fps[np.arange(len(fps)), self.word[at]] & self.mask[at]) >> self.low[at]

    def keys(self, fps: np.ndarray, first: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(keys, rows): a key per bit left out of the segment after ``first`` on the ring of ``step``."""
        after = (first + step) % self.m
        begun = mixed((first.astype(np.uint64) << np.uint64(32)) | self.segment(fps, first), 7)
        following, n = self.segment(fps, after), self.bits[after]
        rows = np.repeat(np.arange(len(fps)), n)
        bit = (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        left = following[rows] & ~(np.uint64(1) << bit)
        with np.errstate(over="ignore"):
            return mixed(begun[rows] + mixed((bit << np.uint64(32)) | left, 8)), rows

    def near(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, step: int = 1) -> np.ndarray:
        """Places of the pairs that keep to the budgets of chains of 3 segments and more and to the whole distance."""
        at = np.arange(len(a))
        counted = np.zeros(len(a), np.int64)
        for length in range(1, self.chain + 1):
            part = (first[at] + (length - 1) * step) % self.m
            counted = counted + np.bitwise_count((a[at, self.word[part]] ^ b[at, self.word[part]]) & self.mask[part])
            if length > 2:
                ok = counted <= length * self.most // self.m
                at, counted = at[ok], counted[ok]
        return at[np.bitwise_count(a[at] ^ b[at]).sum(1, dtype=np.int64) <= self.most]


def wide_links(fps: DataFrame, ring: WideRing, per_bucket: int = PER_WIDE_BUCKET) -> DataFrame:
    """(a, b): links between ``node`` numbers of distinct wide fingerprints ``fp``.

    A row is sent once for every segment, to the bucket of that segment's bits; the keys
    of all rings are made there, one ring after another. All pairs under a key count.
    """
    buckets = max(1, -(-fps.count() * ring.m // per_bucket))
    size = 8 * ring.width
    dealt_schema = pa.schema([("bucket", pa.int64()), ("nodes", pa.binary()), ("fps", pa.binary()), ("firsts", pa.binary())])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, ring.width)
            for at in range(0, len(nodes), 8192):
                some = fps[at:at + 8192]
                first = np.tile(np.arange(ring.m), len(some))
                row = np.repeat(np.arange(len(some)), ring.m)
                own = mixed((first.astype(np.uint64) << np.uint64(32)) | ring.segment(some[row], first), 9)
                bucket = (own % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                row, first, bucket = row[order], first[order].astype("<u2"), bucket[order]
                cuts = runs(bucket)
                spans = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cuts[:-1]]),
                    pa.array([nodes[at + row[s:e]].tobytes() for s, e in spans], pa.binary()),
                    pa.array([some[row[s:e]].tobytes() for s, e in spans], pa.binary()),
                    pa.array([first[s:e].tobytes() for s, e in spans], pa.binary())], schema=dealt_schema)

    def link(rows: pa.Table) -> pa.Table:
        nodes, fps, first = (np.frombuffer(b"".join(rows[c].to_pylist()), t)
                             for c, t in (("nodes", np.int64), ("fps", "<u8"), ("firsts", "<u2")))
        fps, first = fps.reshape(len(nodes), size // 8), first.astype(np.int64)
        own, number = np.unique(nodes, return_inverse=True)
        label = np.arange(len(own))
        for step in ring.steps:
            keys, row = ring.keys(fps, first, step)
            order = np.argsort(keys, kind="stable")
            keys, row = keys[order], row[order]
            many = np.repeat(np.diff(runs(keys)) > 1, np.diff(runs(keys)))  # a key of its own links nothing
            keys, row = keys[many], row[many]
            label = connecting(number[row], keys, lambda a, b: ring.near(
                fps[row[a]], fps[row[b]], first[row[a]], step), label)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table([pa.array(own[linked]), pa.array(own[label[linked]])], schema=link_schema)

    dealt = fps.select("node", "fp").mapInArrow(deal, "bucket long, nodes binary, fps binary, firsts binary")
    return dealt.groupBy("bucket").applyInArrow(link, "a long, b long")


def resembling(sets: list[np.ndarray], label: np.ndarray, probes: np.ndarray, least: Fraction) -> np.ndarray:
    """Labels after linking every probe with all sets of at least the resemblance ``least``, counted exactly.

    Sets of one label are linked already; counting ends when all are.
    """
    label, sizes = label.copy(), np.array([len(x) for x in sets])
    _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(token, kind="stable")]
    begins, ends = np.cumsum(held) - held, np.cumsum(sizes)
    for i in probes:
        if (label == label[0]).all():
            break
        own = token[ends[i] - sizes[i]:ends[i]]
        own = own[held[own] > 1]
        n = held[own]
        places = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[places], minlength=len(sets))
        hit = np.flatnonzero((common * least.denominator >= (sizes + sizes[i] - common) * least.numerator) & (common > 0))
        label = _joined(label, np.full(len(hit), i), hit)
    return label


def _exact_links(rows: DataFrame, least: Fraction) -> DataFrame:
    """(a, b): links between ``node`` values whose sets resemble, within each component of each unit.

    ``rows``: unit, component, node, label, probe, hashes. Pairs without a probe are left out.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(unit: pa.Table) -> pa.Table:
        component, node, label, probe = (unit[c].to_numpy() for c in ("component", "node", "label", "probe"))
        order = np.lexsort((~probe, node, component))
        component, node, label, probe = component[order], node[order], label[order], probe[order]
        kept = np.concatenate(([True], (node[1:] != node[:-1]) | (component[1:] != component[:-1])))
        order, component, node, label, probe = order[kept], component[kept], node[kept], label[kept], probe[kept]
        hashes, a, b, cuts = unit["hashes"], [], [], runs(component)
        for s, e in zip(cuts, cuts[1:]):
            sets = [np.frombuffer(hashes[int(i)].as_py(), "<u8") for i in order[s:e]]
            before = np.unique(label[s:e], return_index=True, return_inverse=True)
            start = before[1][before[2]]
            after = resembling(sets, start, np.flatnonzero(probe[s:e]), least)
            linked = np.flatnonzero(after != start)
            a.append(node[s:e][linked])
            b.append(node[s:e][after[linked]])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    return rows.groupBy("unit").applyInArrow(link, "a long, b long")


def exact_links(sets: DataFrame, resemblance: float = RESEMBLANCE, per_block: int = BLOCK_TEXTS) -> DataFrame:
    """(a, b): links that connect the nodes of each ``component`` as all pairs of at least ``resemblance`` would.

    ``sets``: component, node, size, hashes. A component of many texts is cut into blocks.
    Each block is compared within and with a few hubs; after that, only texts outside
    their component's largest linked group still meet the other blocks, all of them.
    """
    least, row = Fraction(str(resemblance)), lambda n, s: F.greatest(
        F.lit(1), F.ceil(n / per_block), F.ceil(s / BLOCK_SHINGLES)).cast("long")
    hubs = F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(k)), "node"))["node"] for k in range(HUBS)]))
    parts = stage(sets.groupBy("component").agg(row(F.count(F.lit(1)), F.sum("size")).alias("parts"), hubs.alias("hubs")), "parts")
    total = sets.agg(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count(F.lit(1)) / per_block).alias("t")).first()["t"] or 0
    units = max(1, int(-(-total * 4 // 1)))
    placed = stage(join_lookup(sets, parts.select("component", "parts"), ["component"]).withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts"))), "blocks")
    names = ["unit", "component", "node", "label", "probe", "hashes"]
    own = placed.select("*", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(units))).otherwise(
        F.xxhash64("component", "block")).alias("unit"), F.col("node").alias("label"), F.lit(True).alias("probe"))
    central = parts.where("parts > 1").select(F.explode("hubs").alias("node"))
    met = join_lookup(placed.where("parts > 1"), stage(central, "hubs"), ["node"], "left_semi").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "*", F.xxhash64("component", "block").alias("unit"), F.col("node").alias("label"), F.lit(True).alias("probe"))
    links = stage(_exact_links(own.select(*names).unionByName(met.select(*names)), least), "links")
    large = placed.where("parts > 1")
    if large.isEmpty():
        return links
    linked = stage(components(links).withColumnRenamed("component", "label"), "linked")
    labelled = stage(join_lookup(large, linked, ["node"], "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    groups = labelled.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    groups = stage(groups, "groups")
    main = groups.groupBy("component").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    rest = groups.join(main, "component").where("label <> main").groupBy("component", "main").agg(
        row(F.sum("n"), F.sum("s")).alias("rests"))
    open_ = join_lookup(labelled, stage(rest, "rest"), ["component"])
    outer = F.col("label") != F.col("main")
    probes = open_.where(outer).withColumn("turn", F.pmod(F.xxhash64("node", F.lit("turn")), F.col("rests"))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("probe", F.lit(True))
    others = open_.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1))).withColumn("probe", F.lit(False))
    both = probes.unionByName(others, allowMissingColumns=True).withColumn("unit", F.xxhash64("component", "turn", "block"))
    return links.unionByName(_exact_links(both.select(*names), least))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, resemblance: float = RESEMBLANCE,
            per_block: int = BLOCK_TEXTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, names, docs), for groups of near copies.

    rows: _key (a number of the row's own), _id, _node. names: _node, _group, _least (the
    group's least id), one row per distinct shingle set. docs: _key, and all columns of
    ``docs`` as _row.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = stage(docs.select(F.monotonically_increasing_id().alias("_key"), row.alias("_row")), "numbered")
    texts = numbered.select("_key", F.col("_row")[doc_id].cast("long").alias("_id"), F.col("_row")[text].alias("_text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(2)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fps = pa.array([wide_fingerprint(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), fps],
                                             ["_key", "_id", "_node", "fp"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["component", "node", "size", "hashes"])

    own = stage(texts.mapInArrow(
        of, "_key long, _id long, _node long, fp binary"), "wide-fingerprints")
    distinct = stage(own.groupBy(F.col("_node").alias("node")).agg(
        F.first("fp").alias("fp"), F.min("_id").alias("least"), F.min("_key").alias("_key")), "wide-distinct")
    near = stage(components(wide_links(distinct, WideRing(WIDTH, CUTS, SHARE, STEPS, CHAIN))), "candidates")
    chosen = stage(near.join(distinct.select("node", "_key"), "node"), "chosen")
    compared = join_lookup(texts.select("_key", "_text"), chosen, ["_key"]).select("component", "node", "_text")
    sets = stage(compared.mapInArrow(sets_of, "component long, node long, size long, hashes binary"), "sets")
    linked = stage(components(exact_links(sets, resemblance, per_block)), "components")
    members = linked.join(distinct.select("node", "least"), "node")
    least = members.groupBy("component").agg(F.min("least").alias("_least"))
    joined = members.join(least, "component").select("node", "component", "_least")
    names = distinct.select("node", "least").join(joined, "node", "left").select(
        F.col("node").alias("_node"), F.coalesce("component", "node").alias("_group"), F.coalesce("_least", "least").alias("_least"))
    return own.select("_key", "_id", "_node"), stage(names, "named"), numbered


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                resemblance: float = RESEMBLANCE) -> DataFrame:
    """(doc_id, component_id), one row per row of ``docs``.

    Rows link if the sets of their texts' word shingles share at least ``resemblance`` of
    their union, counted exactly. Which texts are compared is told by wide fingerprints of
    the sets, in pigeonring's chains: two of resemblance 0.8 are missed with a probability
    of about 0.003, more alike ones more seldom. component_id, copies, nulls, empty texts
    and empty tables are as in ``near_duplicates``. Shingles and sets are told apart by
    64-bit hashes.
    """
    rows, names, _ = grouped(docs, doc_id, text, shingle, resemblance)
    return join_lookup(rows, names, ["_node"]).select(F.col("_id").alias("doc_id"), F.col("_least").alias("component_id"))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                  resemblance: float = RESEMBLANCE) -> DataFrame:
    """One row of ``docs`` for each group of near copies: the least id, null last, then the least text.

    Rows have numbers of their own, so ids may repeat or be null, with the same text or others.
    """
    rows, names, numbered = grouped(docs, doc_id, text, shingle, resemblance)
    rows = stage(join_lookup(rows, names.select("_node", "_group"), ["_node"]).select("_key", "_id", "_group"), "rows")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    many = stage(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).where("_n > 1"), "many")
    copies = stage(join_lookup(rows, many.select("_group", "_first"), ["_group"]), "copies")
    first = copies.where(F.col("_id").eqNullSafe(F.col("_first")["id"])).select("_key", "_group")
    alone = first.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_key"))
    alone = stage(alone, "alone")
    tied = stage(join_lookup(first, alone.where("_n > 1").select("_group"), ["_group"], "left_semi"), "tied")
    texts = join_lookup(numbered.select("_key", F.col("_row")[text].alias("_text")), tied, ["_key"])
    least = texts.groupBy("_group").agg(F.min(F.struct(F.col("_text").isNull().alias("none"), "_text", "_key"))["_key"].alias("_key"))
    kept = alone.where("_n = 1").select("_key").unionByName(least.select("_key"))
    gone = stage(join_lookup(copies.select("_key"), stage(kept, "kept"), ["_key"], "left_anti"), "gone")
    return join_lookup(numbered, gone, ["_key"], "left_anti").select("_row.*")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
