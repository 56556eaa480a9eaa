"""Removal of repeated passages: every byte covered by a string of 100 bytes that starts earlier too.

Each 100-byte window has an anchor, the gram in it with the least hash, so equal windows
meet under their anchor's key. Runs of neighbouring windows with one anchor are a
context. Contexts that are equal as a whole are settled by their hashes: all but the
first repeat. Where one key has different contexts, their texts are gathered into
blocks, and a block's equal windows are found on its Burrows-Wheeler transform: breadth-
first backward extension of intervals sets the common prefixes in rising order and stops
at the length asked for, so that what is left unset between two suffixes is a repeat.

The corpus is cut into ranges of doc_id. A range's texts are shuffled once; what travels
besides are arrays of hashes, flags for them in the same order, and contexts of blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.llm.common import mixed, range_bounds, range_of, runs, table
from metrosift.llm.segments import utf8

LENGTH = 100
GRAM = 32
_PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: Bytes of text in a range, of the corpus per bucket of keys and per block of contexts.
RANGE_BYTES, BUCKET_BYTES, BLOCK_BYTES = 4 << 20, 24 << 20, 24 << 20
MAX_RANGES = 10_000
#: Different contexts of a key in one range, and in all, from which on its windows are dealt singly.
CROWDED_IN_RANGE, CROWDED = 16, 4096
#: Symbols of one transform.
_TRANSFORM = 1 << 20
_REPEATED, _MIXED, _CROWDED = 1, 2, 4
#: Grams are hashed by a polynomial modulo 2**64; they are far shorter than what collides for every base.
_BASE = 0x9E3779B97F4A7C15
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64), 11)


class _Powers:
    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, _PIECE)
            self.pair = tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(self.n, b, np.uint64)), dtype=np.uint64)
                              for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.pair


_POWERS = _Powers()


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows that share an anchor: (start, number of windows, key, context hash) of each."""
    out: list[tuple] = []
    spread = length - gram + 1
    doc = 0
    n_docs = len(offsets) - 1
    while doc < n_docs:
        last = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + _PIECE, "right")) - 1)
        low, high = int(offsets[doc]), int(offsets[last])
        # a document longer than a piece is cut at window starts; a run cut in two is still found by its key
        for at in range(low, high, _PIECE) if last == doc + 1 else [low]:
            stop = min(high, at + _PIECE + length - 1) if last == doc + 1 else high
            edges = np.clip(offsets[doc:last + 1], at, stop) - at
            out += _anchors(data[at:stop], edges, at, length, gram, spread)
        doc = last
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _anchors(block, edges, base, length, gram, spread):
    n = len(block)
    if n < length:
        return []
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[block] * up[:n], out=sums[1:])
        grams = (sums[gram:] - sums[:-gram]) * down[:n - gram + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= spread:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < spread:
        least = np.minimum(least[:len(least) - (spread - width)], least[spread - width:])
    anchor = (least & _PLACE).astype(np.int32)
    valid = np.zeros(len(anchor) + 1, np.int8)
    ends = edges[1:] - length + 1
    full = ends > edges[:-1]
    np.add.at(valid, edges[:-1][full], 1)
    np.add.at(valid, ends[full], -1)
    inside = np.cumsum(valid[:-1]) > 0
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    at_edge = edges[:-1][full]
    new[at_edge] = True
    starts = np.flatnonzero(new & inside)
    if not len(starts):
        return []
    stops = np.zeros(len(anchor) + 1, bool)
    stops[:-1] = new | ~inside
    stops[-1] = True
    marks = np.flatnonzero(stops)
    after = marks[np.searchsorted(marks, starts, "right")]
    with np.errstate(over="ignore"):
        e = after - 1 + length
        context = mixed((sums[e] - sums[starts]) * down[starts] + (e - starts).astype(np.uint64), 3)
    # the least hash of a window is small: mixed again, keys spread evenly over ranges
    return [(starts + base, after - starts, mixed(grams[anchor[starts]], 4), context)]


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places of all suffixes, sorted by at least their first ``length`` symbols (0 to 256)."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = key << 9 | padded[i:n + i]
    order = np.argsort(key, kind="stable")
    reach = 7
    ordered = key[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    open_rows = np.flatnonzero(~(head & np.append(head[1:], True)))
    while reach < length and len(open_rows):
        own = order[open_rows]
        group = rank[own]
        by = np.argsort(group * (n + 2) + rank[np.minimum(own + reach, n)] + 1, kind="stable")
        own, group = own[by], group[by]
        tail = rank[np.minimum(own + reach, n)]
        order[open_rows] = own
        head = np.concatenate(([True], (group[1:] != group[:-1]) | (tail[1:] != tail[:-1])))
        rank[own] = open_rows[np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))]
        open_rows = open_rows[~(head & np.append(head[1:], True))]
        reach *= 2
    return order


def interval_bounds(transform: np.ndarray, length: int) -> np.ndarray:
    """True where a sorted suffix shares fewer than ``length`` symbols with the one before it.

    Starting from the interval of the empty string, every interval of a string w is
    extended to the left by each symbol c before its suffixes, giving the interval of cw.
    If the boundary at its end is not set yet, the suffixes there share exactly |w|
    symbols, and the new interval is extended in the next round. After ``length`` rounds
    the boundaries left unset are between suffixes that share more.
    """
    n = len(transform)
    by_symbol = np.argsort(transform, kind="stable")  # row whose backward step leads here
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    ordered = transform[by_symbol]
    new_symbol = np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))
    after = np.append(by_symbol, n)[1:]
    after[new_symbol[1:]] = n  # next row with the same symbol, for the row that leads here
    before = np.insert(by_symbol, 0, -1)[:-1]
    before[new_symbol[:-1]] = -1
    next_same, last_same = after[step], before[step]
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        rows = np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)
        end = step[rows[next_same[rows] >= np.repeat(high, size)]] + 1
        start = step[rows[last_same[rows] < np.repeat(low, size)]]
        end.sort()
        start.sort()
        fresh = ~bound[end]
        low, high = start[fresh], end[fresh]
        bound[high] = True
    return bound


def repeats_in(contexts: list[bytes], places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context number, window) of each window that an earlier place holds too.

    ``places`` are the contexts' places in the whole corpus; a window's is that of its
    context plus its start in it. Contexts end in a symbol of their own, which no window
    counted here reaches.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    symbols = np.zeros(total, np.int16)
    text = np.ones(total, bool)
    text[begins + sizes] = False
    symbols[text] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int16) + 1
    order = suffix_order(symbols, length)
    bound = interval_bounds(symbols[order - 1], length)
    group = np.cumsum(bound[:-1]) - 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)[order]
    inside = order - begins[owner]
    counted = np.flatnonzero(inside + length <= sizes[owner])
    group, owner, inside = group[counted], owner[counted], inside[counted]
    place = places[owner] + inside
    first = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, place)
    later = place > first[group]
    return owner[later], inside[later]


class _Range:
    """One range's texts, its contexts and the distinct (key, context) entries it asks about."""

    def __init__(self, rows: pa.Table, length: int) -> None:
        texts = pa.concat_arrays(rows["text"].chunks) if rows.num_rows else pa.array([], pa.string())
        self.length = length
        sorted_by = pa.table({"doc_id": rows["doc_id"], "text": texts})
        self.order = pc.sort_indices(sorted_by, sort_keys=[("doc_id", "ascending"), ("text", "ascending")],
                                     null_placement="at_start").to_numpy()
        self.data, self.offsets = utf8(texts.take(pa.array(self.order)))
        self.start, self.windows, key, context = anchors(self.data, self.offsets, length)
        by = np.lexsort((self.start, context, key))
        key, context = key[by], context[by]
        new_key = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        new = new_key | np.concatenate(([True], context[1:] != context[:-1])) if len(key) else new_key
        of_key = np.cumsum(new_key) - 1
        crowded = np.bincount(of_key, new) > CROWDED_IN_RANGE if len(key) else np.zeros(0, bool)
        shown = np.where(crowded[of_key], new_key, new)  # a crowded key is asked about once
        entry = np.cumsum(shown) - 1
        self.keys = key[shown]
        self.contexts = np.where(crowded[of_key], np.uint64(0), context)[shown]
        self.crowded_here = crowded[of_key[shown]]
        self.entry, self.first = np.empty(len(key), np.int64), np.empty(len(key), bool)
        self.entry[by], self.first[by] = entry, new
        self.key = np.empty(len(key), np.uint64)
        self.key[by] = key

    def cuts(self, buckets: int) -> np.ndarray:
        return _cuts(self.keys, buckets)

    def window_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the contexts ``at``: start, key, and whether it is the range's first with that key."""
        start = np.repeat(self.start[at], self.windows[at]) + np.arange(self.windows[at].sum()) - np.repeat(
            np.cumsum(self.windows[at]) - self.windows[at], self.windows[at])
        start.sort()
        key = np.array([int.from_bytes(hashlib.blake2b(self.data[s:s + self.length], digest_size=8).digest(), "little")
                        for s in start.tolist()], np.uint64)
        order = np.argsort(key, kind="stable")
        first = np.zeros(len(start), bool)
        first[order[runs(key[order])[:-1]]] = True
        return start, key, first


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    bounds = np.array([(b << 64) // parts for b in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


_ASKED = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("contexts", pa.binary())])
_TOLD = pa.schema([("part", pa.int64()), ("kind", pa.int64()), ("bucket", pa.int64()), ("values", pa.binary())])
_SENT = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("starts", pa.binary()),
                   ("sizes", pa.binary()), ("texts", pa.binary())])
_FLAGS, _WINDOWS = 0, 1


def _ask(buckets: int, length: int):
    def ask(rows: pa.Table) -> pa.Table:
        own, part = _Range(rows, length), rows["part"][0].as_py()
        at = own.cuts(buckets)
        cells = [(b, s, e) for b, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s]
        return pa.table([
            pa.array([b for b, _, _ in cells], pa.int64()), pa.array([part] * len(cells), pa.int64()),
            pa.array([own.keys[s:e].tobytes() for _, s, e in cells], pa.binary()),
            pa.array([own.contexts[s:e].tobytes() for _, s, e in cells], pa.binary())], schema=_ASKED)

    return ask


def _tell(rows: pa.Table) -> pa.Table:
    """Flags of each entry: an earlier range has it, its key has other contexts, its key is crowded."""
    parts, blobs = rows["part"].to_pylist(), rows["keys"].to_pylist()
    sizes = np.array([len(b) // 8 for b in blobs])
    keys = np.frombuffer(b"".join(blobs), np.uint64)
    contexts = np.frombuffer(b"".join(rows["contexts"].to_pylist()), np.uint64)
    order = np.lexsort((np.repeat(np.array(parts), sizes), contexts, keys))
    k, c = keys[order], contexts[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new = new_key | np.concatenate(([True], c[1:] != c[:-1]))
    of_key = np.cumsum(new_key) - 1
    different = np.bincount(of_key, new)[of_key]
    marked = np.bincount(of_key, c == 0)[of_key] > 0
    flags = np.where(new, 0, _REPEATED) | np.where(different > 1, _MIXED, 0) | np.where(marked | (different > CROWDED), _CROWDED, 0)
    out = np.empty(len(keys), np.uint8)
    out[order] = flags
    ends = np.cumsum(sizes)
    return pa.table([
        pa.array(parts, pa.int64()), pa.array([_FLAGS] * len(parts), pa.int64()), rows["bucket"],
        pa.array([out[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], schema=_TOLD)


def _flags(own: _Range, told: pa.Table) -> np.ndarray:
    """The flags of every context of a range."""
    rows = sorted((r for r in told.to_pylist() if r["kind"] == _FLAGS), key=lambda r: r["bucket"])
    values = np.frombuffer(b"".join(r["values"] for r in rows), np.uint8)
    return values[own.entry] if len(values) else np.zeros(0, np.uint8)


def _send(blocks: int, length: int):
    """From a range, the texts of contexts that must be compared, and single windows of crowded keys."""

    def send(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _SENT.empty_table()
        own, part = _Range(rows, length), rows["part"][0].as_py()
        flags = _flags(own, told)
        whole = np.flatnonzero((flags & (_CROWDED | _REPEATED) == 0) & (flags & _MIXED > 0) & own.first)
        start, key, first = own.window_keys(np.flatnonzero(flags & _CROWDED > 0))
        starts = np.concatenate((own.start[whole], start[first]))
        keys = np.concatenate((own.key[whole], key[first]))
        sizes = np.concatenate((own.windows[whole], np.ones(int(first.sum()), np.int64))) + length - 1
        order = np.argsort(keys, kind="stable")
        starts, keys, sizes = starts[order], keys[order], sizes[order]
        at, raw = _cuts(keys, blocks), own.data.tobytes()
        cells = [(b, s, e) for b, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s]
        return pa.table([
            pa.array([b for b, _, _ in cells], pa.int64()), pa.array([part] * len(cells), pa.int64()),
            *[pa.array([v[s:e].tobytes() for _, s, e in cells], pa.binary()) for v in (keys, starts, sizes)],
            pa.array([b"".join(raw[i:i + n] for i, n in zip(starts[s:e].tolist(), sizes[s:e].tolist())) for _, s, e in cells],
                     pa.binary())], schema=_SENT)

    return send


def _compare(length: int):
    """A block's repeated windows, by transforms over whole keys of about ``_TRANSFORM`` symbols."""

    def compare(rows: pa.Table) -> pa.Table:
        blobs = rows["keys"].to_pylist()
        part = np.repeat(np.array(rows["part"].to_pylist()), [len(b) // 8 for b in blobs])
        keys, starts, sizes = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in
                               (("keys", np.uint64), ("starts", np.int64), ("sizes", np.int64)))
        raw = b"".join(rows["texts"].to_pylist())
        begins = np.cumsum(sizes) - sizes
        places = part.astype(np.int64) << 40 | starts
        order = np.lexsort((places, keys))
        heads = runs(keys[order])
        filled = np.cumsum(sizes[order] + 1)
        found: dict[int, list[np.ndarray]] = {}
        at, n_keys = 0, len(heads) - 1
        while at < n_keys:
            done = filled[heads[at] - 1] if heads[at] else 0
            stop = max(at + 1, int(np.searchsorted(filled[heads[1:] - 1], done + _TRANSFORM, "right")))
            own = order[heads[at]:heads[stop]]
            lone = heads[at + 1:stop + 1] - heads[at:stop] == 1
            own = own[~np.repeat(lone, np.diff(heads[at:stop + 1]))]  # a key met once here repeats nothing
            for group in _portions(own, sizes):
                texts = [raw[b:b + n] for b, n in zip(begins[group].tolist(), sizes[group].tolist())]
                which, window = repeats_in(texts, places[group], length)
                owner = part[group][which]
                for p in np.unique(owner):
                    mine = owner == p
                    found.setdefault(int(p), []).append(starts[group][which[mine]] + window[mine])
            at = stop
        named = sorted(found)
        return pa.table([
            pa.array(named, pa.int64()), pa.array([_WINDOWS] * len(named), pa.int64()),
            pa.array([rows["block"][0].as_py()] * len(named), pa.int64()),
            pa.array([np.sort(np.concatenate(found[p])).astype(np.int64).tobytes() for p in named], pa.binary())], schema=_TOLD)

    return compare


def _portions(rows: np.ndarray, sizes: np.ndarray):
    """All rows at once, unless one key alone is far larger than a transform.

    Only single windows, all equal under their key, can be so many; the earliest is put
    before each portion, as it is what all others repeat.
    """
    if not len(rows):
        return
    if sizes[rows].sum() <= 4 * _TRANSFORM or len(set(sizes[rows].tolist())) > 1:
        yield rows
        return
    step = max(1, _TRANSFORM // int(sizes[rows[0]]))
    for i in range(0, len(rows), step):
        yield rows[:step] if i == 0 else np.concatenate((rows[:1], rows[i:i + step]))


def _finish(columns: list[str], schema: pa.Schema, length: int, doc_id: str, text: str):
    """A range's documents with what is removed from each."""

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        own = _Range(rows, length)
        flags = _flags(own, told)
        cover = np.zeros(len(own.data) + 1, np.int32)
        crowded = flags & _CROWDED > 0
        gone = ~crowded & ((flags & _REPEATED > 0) | ~own.first)
        start, _, first = own.window_keys(np.flatnonzero(crowded))
        single = [start[~first]] + [np.frombuffer(r["values"], np.int64) for r in told.to_pylist() if r["kind"] == _WINDOWS]
        for begin, size in ((own.start[gone], own.windows[gone] + length - 1), (np.concatenate(single), length)):
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + size, -1)
        removed = np.cumsum(cover[:-1]) > 0
        # neighbouring documents' runs are runs of their own
        new_run = removed & ~np.concatenate(([False], removed[:-1])) if len(removed) else removed
        firsts = own.offsets[:-1][own.offsets[:-1] < own.offsets[1:]]
        new_run[firsts] = removed[firsts]
        lost = np.diff(np.concatenate(([0], np.cumsum(removed)))[own.offsets])
        spans = np.diff(np.concatenate(([0], np.cumsum(new_run)))[own.offsets])
        kept, digests = [], []
        for s, e, n in zip(own.offsets[:-1].tolist(), own.offsets[1:].tolist(), lost.tolist()):
            piece = own.data[s:e]
            piece = (piece if n == 0 else piece[~removed[s:e]]).tobytes()
            digests.append(hashlib.sha256(piece).hexdigest())
            kept.append(piece)
        taken = rows.take(pa.array(own.order))
        made = {"n_bytes": pa.array(np.diff(own.offsets)), "n_removed": pa.array(lost.astype(np.int64)),
                "n_spans": pa.array(spans.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())}
        if "__kept" in schema.names:
            made["__kept"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.table([made[n] if n in made else taken[n] for n in schema.names], schema=schema)

    return finish


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: list[str] | None = None,
                 with_text: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and the columns ``keep``.

    With ``with_text`` the remaining text is ``__kept``; a character that removal cuts
    through is left out there. Earlier means a smaller id, or an earlier start in one
    text; null ids come first and rows with equal ids go in order of their texts, so of
    repeated rows all but one are removed. Null texts are empty. A text shorter than
    ``length`` bytes is never touched. No rows give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = keep or []
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
                      *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)])
    keyed = own.withColumn("__at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    total = own.agg(F.sum(F.octet_length("text").cast("long")).alias("s")).first()["s"] or 0
    parts, buckets, blocks = (max(1, -(-total // n)) for n in (range_bytes, BUCKET_BYTES, BLOCK_BYTES))
    bounds = range_bounds(keyed, "__at", min(parts, MAX_RANGES))
    dealt = keyed.withColumn("part", range_of(bounds, F.col("__at")).cast("long")).drop("__at").repartition(
        max(1, len(bounds)), "part")
    told_type = "part long, kind long, bucket long, values binary"
    asked = dealt.groupBy("part").applyInArrow(_ask(buckets, length), "bucket long, part long, keys binary, contexts binary")
    told = asked.groupBy("bucket").applyInArrow(_tell, told_type)
    sent = dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(
        _send(blocks, length), "block long, part long, keys binary, starts binary, sizes binary, texts binary")
    windows = sent.groupBy("block").applyInArrow(_compare(length), told_type)
    result = ", ".join(["doc_id long", "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"]
                       + [f"__keep_{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(keep)] + ["__kept string"] * with_text)
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], result).schema)
    found = dealt.groupBy("part").cogroup(told.unionByName(windows).groupBy("part")).applyInArrow(
        _finish(keep, schema, length, doc_id, text), result)
    return found.withColumnsRenamed({f"__keep_{i}": c for i, c in enumerate(keep)})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages taken out of the text; all other columns stay."""
    others = [c for c in docs.columns if c not in (doc_id, text)]
    found = find_repeats(docs, doc_id, text, length, others, with_text=True)
    return found.withColumnsRenamed({"doc_id": doc_id, "__kept": text}).select(*docs.columns)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return find_repeats(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
