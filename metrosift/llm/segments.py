"""Cutting a batch of texts into segments and naming them, as whole arrays.

A batch's UTF-8 is taken as one byte array, and no string is made for a segment seen
before. Segments of up to 15 bytes are named by their bytes and length themselves. Longer
ones are hashed through prefix sums of random polynomials over a prime field: modulo a
power of two, long words of two repeated syllables would collide for every base; over a
field of p values two segments of n bytes share a polynomial for n of p bases at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from metrosift.llm.common import mixed

#: Bytes hashed at a time; a longer segment is taken whole.
_CHUNK = 1 << 16
_FIELD = (1 << 31) - 1
#: Two polynomials a hash: their bases and what each byte counts.
_BASES = [int(b) % (_FIELD - 2) + 2 for b in mixed(np.arange(4), 10)]
_VALUES = [mixed(np.arange(1, 257, dtype=np.uint64), s) % np.uint64(_FIELD - 1) + np.uint64(1) for s in (11, 12, 13, 14)]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins and ends; null is empty."""
    binary = pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset:binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[offsets[0]:offsets[-1]], offsets - offsets[0]) if len(binary) else (whole[:0], np.zeros(1, np.int64))


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the field's prime, but for a multiple of it; ``x`` is below 2**62."""
    x = (x & np.uint64(_FIELD)) + (x >> np.uint64(31))
    return (x & np.uint64(_FIELD)) + (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate((out, _reduced(out * np.uint64(step))))
        step = step * step % _FIELD
    return out[:n]


class _Powers:
    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n > self.n:
            self.n = max(n, _CHUNK + 1)
            self.pairs = [tuple(_powers(b, self.n) for b in (base, pow(base, -1, _FIELD))) for base in _BASES]
        return self.pairs


_POWERS = _Powers()


#: Bytes that two words hold beside the length, and segments named at a time.
_SHORT, _SEGMENTS = 15, 1 << 16
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1] * 8, np.uint64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int = 2) -> list[np.ndarray]:
    """``n`` (1 or 2) words that name each segment; starts must rise.

    Two words tell all segments of up to 15 bytes apart, one word those of up to 7.
    """
    out = [np.zeros(len(starts), np.uint64) for _ in range(n)]
    for at in range(0, len(starts), _SEGMENTS):
        s, e = starts[at:at + _SEGMENTS], ends[at:at + _SEGMENTS]
        size = e - s
        short = np.flatnonzero(size <= _SHORT)
        if len(short):
            for named, found in zip(out, _packed(data, s[short], size[short], n)):
                named[at + short] = found
        long = np.flatnonzero(size > _SHORT)
        if len(long):
            for named, found in zip(out, _polynomials(data, s[long], e[long], n)):
                named[at + long] = found
    return out


def _packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int) -> list[np.ndarray]:
    """The bytes and length of segments of up to 15 bytes, as ``n`` words."""
    low, high = int(starts[0]), min(len(data), int(starts[-1]) + 16)
    block = np.concatenate((data[low:high], np.zeros(16, np.uint8)))
    eight = np.ndarray((len(block) - 8,), "<u8", block, strides=(1,))  # the eight bytes from each place on
    s = starts - low
    first = eight[s] & _KEEP[sizes]
    rest = np.where(sizes > 8, eight[np.minimum(s + 8, len(eight) - 1)] & _KEEP[np.maximum(sizes - 8, 0)], np.uint64(0))
    rest |= sizes.astype(np.uint64) << np.uint64(56)
    if n == 2:
        return [mixed(first, 15), mixed(rest, 16)]
    with np.errstate(over="ignore"):
        whole = mixed(first, 15) + rest
    return [mixed(np.where(sizes < 8, first | rest, whole), 17)]


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """``n`` independent 62-bit hashes of each segment, spread over 64 bits."""
    out = [np.zeros(len(starts), np.uint64) for _ in range(n)]
    for part in _slices(starts, ends):
        s, e = starts[part], ends[part]
        # only the segments' own bytes, one segment after another
        size = e - s
        e = np.cumsum(size)
        block = data[np.arange(e[-1]) + np.repeat(s - (e - size), size)]
        s, field, found = e - size, np.uint64(_FIELD), []
        for values, (up, down) in zip(_VALUES[:2 * n], _POWERS.upto(len(block) + 1)):
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_reduced(values[block] * up[:len(block)]), out=sums[1:])
            found.append((sums[e] - sums[s]) % field * down[s] % field)
        for k, result in enumerate(out):
            with np.errstate(over="ignore"):
                result[part] = mixed(mixed(found[2 * k] << np.uint64(31) | found[2 * k + 1]) + (e - s).astype(np.uint64))
    return out


def _slices(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        yield slice(i, j)
        i = j


class KeyTable:
    """Numbers 128-bit keys in order of arrival, by open addressing in arrays."""

    def __init__(self) -> None:
        self.bits, self.n = 16, 0
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for unknown ones."""
        out = np.full(len(a), -1, np.int32)
        at = (a >> np.uint64(64 - self.bits)).astype(np.int64)
        rows = None
        while True:
            own = self.slots[at]
            full = own >= 0
            hit = full.copy()
            hit[full] = (self.a[own[full]] == (a if rows is None else a[rows])[full]) & (
                self.b[own[full]] == (b if rows is None else b[rows])[full])
            out[hit if rows is None else rows[hit]] = own[hit]
            left = np.flatnonzero(full & ~hit)
            if not len(left):
                return out
            rows = left if rows is None else rows[left]
            at = (at[left] + 1) & (len(self.slots) - 1)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Number new, distinct keys."""
        self.a, self.b = np.concatenate((self.a, a)), np.concatenate((self.b, b))
        first, self.n = self.n, self.n + len(a)
        if self.n * 3 > len(self.slots):
            self.bits = int(self.n * 3).bit_length()
            self.slots, first = np.full(1 << self.bits, -1, np.int32), 0
        numbers = np.arange(first, self.n, dtype=np.int32)
        at = (self.a[first:] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            left = self.slots[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) & (len(self.slots) - 1)


def first_of_each(a: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Places of the first row of each distinct value (or of all the columns' values together), in order of place."""
    keys = (*more, a)
    order = np.lexsort(keys)
    new = np.zeros(len(a), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return np.sort(order[new])


#: space and \x09-\x0D
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text number) of the blank-separated words of all texts."""
    data = _LOWER[data] if lower else data
    solid = ~BLANK[data]
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's first byte never continues the text before
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, "right") - 1
