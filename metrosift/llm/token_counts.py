"""Byte-level BPE by rank-synchronous merging of ragged arrays, and token counts.

A text is cut into units, each a word with the blank before it, where the tokenizer's
own split must fall as well. A batch's distinct new units are merged together: in each
round every sequence applies all places of its lowest-ranked pair at once, and sequences
without a pair left drop out. A pair's rank is higher than that of any pair that made
its parts, so a round does what one-by-one merging would do.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrosift.llm.common import table
from metrosift.llm.segments import KeyTable, first_of_each, hashes, utf8

TOKENIZER = "byte_bpe_50k.json"
#: Distinct units a worker keeps; beyond it the store is emptied, which costs time only.
MAX_UNITS = 600_000
#: Bytes of text taken at a time.
_CHUNK = 2_000_000
_NONE = np.int32(2**31 - 1)
#: A blank before one of these always starts a new token, whatever stands before it.
_STARTS = "!-~À-ɿ"
_CUT = re.compile(f" (?=[{_STARTS}])")
#: The same by the first byte of UTF-8: U+00C0 to U+027F begin with C3 to C9.
_AFTER_BLANK = np.zeros(256, bool)
_AFTER_BLANK[0x21:0x7F] = _AFTER_BLANK[0xC3:0xCA] = True
#: Here the two regex engines' character classes are known to agree.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")


def tokenizer_path(name: str) -> str:
    """A file path as it is; a bare name is looked up among the installed vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Merge table of a byte-level BPE file, as arrays."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printable} | {
            b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.char_ids = {c: ids[c] for c in letters.values()}
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], np.int32)
        keys = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.slots = np.full(1 << 20, -1, np.int32)
        at = self._slot(self.keys)
        self.slots[at] = np.arange(len(keys), dtype=np.int32)
        crowded = np.bincount(at, minlength=1 << 20) > 1
        self.slots[crowded] = -2

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        crowded = np.flatnonzero(at == -2)
        if len(crowded):
            at[crowded] = np.minimum(np.searchsorted(self.keys, keys[crowded]), len(self.keys) - 1)
        found = (at >= 0) & (self.keys[at] == keys)
        return np.where(found, self.ranks[at], _NONE)

    def pieces(self, unit: str) -> list[np.ndarray]:
        """Symbols of each pre-token; a special string is one finished symbol."""
        if self.special_cut and "<" in unit and self.special_cut.search(unit):
            return [s for part in self.special_cut.split(unit) if part
                    for s in ([np.array([self.special[part]], np.int32)] if part in self.special else self.pieces(part))]
        if _PLAIN.fullmatch(unit):
            return [self.byte_ids[np.frombuffer(p.encode(), np.uint8)] for p in self.pattern.findall(unit)]
        return [np.array([self.char_ids[c] for c in p], np.int32)
                for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and the number of each.

        Units that begin with a blank cut themselves off when they are joined, so all
        plain ones are split by one pass of the pattern.
        """
        plain = np.fromiter((_CUT.match(u) is not None and "<" not in u and _PLAIN.fullmatch(u) is not None for u in units),
                            bool, len(units))
        at = np.flatnonzero(plain)
        joined = [units[i] for i in at]
        tokens = self.pattern.findall("".join(joined))
        ends = np.cumsum([len(u) for u in joined])
        of = np.searchsorted(ends, np.cumsum([len(t) for t in tokens]))
        symbols = [self.byte_ids[np.frombuffer("".join(joined).encode(), np.uint8)]]
        sizes, owner = [np.fromiter((len(t.encode()) for t in tokens), np.int64, len(tokens))], [at[of]]
        for i in np.flatnonzero(~plain):
            own = self.pieces(units[i])
            symbols += own
            sizes.append(np.array([len(p) for p in own], np.int64))
            owner.append(np.full(len(own), i))
        size, owner = np.concatenate(sizes), np.concatenate(owner).astype(np.int64)
        ids, seq = self.merge(np.concatenate(symbols), np.repeat(np.arange(len(size)), size))
        owners = owner[seq]
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(units))

    def merge(self, symbols: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all sequences; ``seq`` rises and names the sequence of each symbol."""
        done_ids, done_seq = [], []
        ranks = self._pair_ranks(symbols, seq)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            sizes = np.diff(np.append(starts, len(seq)))
            low = np.minimum.reduceat(ranks, starts)
            live = low != _NONE
            if not live.all():
                keep = np.repeat(live, sizes)
                done_ids.append(symbols[~keep])
                done_seq.append(seq[~keep])
                symbols, seq, ranks, sizes, low = symbols[keep], seq[keep], ranks[keep], sizes[live], low[live]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(low, sizes)
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]  # in a a a the first two merge
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, seq, ranks, at = symbols[keep], seq[keep], ranks[keep], moved[at]
            touched = np.zeros(len(symbols), bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(touched)
            ranks[changed] = self._pair_ranks(symbols, seq, changed)
        if not done_ids:
            return symbols, seq
        ids, owners = np.concatenate(done_ids), np.concatenate(done_seq)
        order = np.argsort(owners, kind="stable")
        return ids[order], owners[order]

    def _pair_ranks(self, symbols: np.ndarray, seq: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of each symbol with its right neighbour in the same sequence."""
        at = np.arange(len(symbols)) if at is None else at
        right = np.minimum(at + 1, len(symbols) - 1)
        inside = (at + 1 < len(symbols)) & (seq[at] == seq[right])
        out = np.full(len(at), _NONE, np.int32)
        out[inside] = self.rank_of(symbols[at[inside]].astype(np.int64) << 20 | symbols[right[inside]])
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts through a store of units, each merged once while it is kept."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self.reset()

    def reset(self) -> None:
        self.known = KeyTable()
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts one after another, and how many each text has."""
        data, offsets = utf8(texts)
        if self.known.n > MAX_UNITS:
            self.reset()
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 32) & _AFTER_BLANK[data[1:]] if len(data) else False
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        a, b = hashes(data, starts, ends)
        at = self.known.find(a, b)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = new[first_of_each(a[new], b[new])]  # one word alone names the first eight bytes only
            self.known.add(a[fresh], b[fresh])
            at[new] = self.known.find(a[new], b[new])
            raw = data.tobytes()
            ids, counts = self.vocabulary.encode(
                [raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts[fresh].tolist(), ends[fresh].tolist())])
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        return at, np.diff(np.searchsorted(starts, offsets))

    def count(self, texts: pa.Array) -> np.ndarray:
        at, sizes = self.units(texts)
        return _sums(self.counts[at], sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and the number of each text."""
        at, sizes = self.units(texts)
        n = self.counts[at]
        begins = (np.cumsum(self.counts) - self.counts)[at]
        place = np.cumsum(n) - n
        return self.ids[np.repeat(begins - place, n) + np.arange(n.sum())], _sums(n, sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total, ends = np.concatenate(([0], np.cumsum(values))), np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process, so that its store serves later tasks too."""
    return Encoder(path)


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``_CHUNK`` bytes, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        reach = (ends[start - 1] if start else 0) + _CHUNK
        stop = max(start + 1, int(np.searchsorted(ends, reach, "right")))
        yield texts[start:stop]
        start = stop


def token_count(tokenizer: str = TOKENIZER):
    """A column function: tokens of a text without added ones; null and empty have none."""

    @F.arrow_udf(T.LongType())
    def count(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(tokenizer_path(tokenizer))
        for texts in arrays:
            yield pa.array(np.concatenate([own.count(part) for part in chunks(texts)] or [np.zeros(0, np.int64)]), pa.int64())

    return count


def count_tokens(docs: DataFrame, text: str = "text", limit: int = 1024, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) added.

    Whole texts are counted, of any length. Null texts count as empty. Rows, repeated
    ones too, and other columns stay; columns of the added names are replaced.
    """
    return docs.withColumn("n_tokens", token_count(tokenizer)(F.col(text))).withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
