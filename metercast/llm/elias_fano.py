"""Elias-Fano sequences over numpy arrays that can be memory-mapped.

A sorted sequence keeps the low bits of its values packed; the high bits are
unary: for each bucket of equal high bits as many ones as it has values, then
a zero. So the zero before a bucket points to its first value.
"""

from __future__ import annotations

import os

import numpy as np

_ONE = np.uint64(1)


def _to_words(bits: np.ndarray) -> np.ndarray:
    """Bits (0/1 bytes, lowest first) as 64-bit words, with one word to spare."""
    data = np.packbits(bits, bitorder="little")
    out = np.zeros(len(data) // 8 + 2, np.uint64)
    out.view(np.uint8)[:len(data)] = data
    return out


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, end to end."""
    bits = np.empty((len(values), width), np.uint8)
    for j in range(width):
        bits[:, j] = (values >> j) & 1
    return _to_words(bits.ravel())


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    k, place = k.astype(np.uint8), np.zeros(len(word), np.uint8)
    for half in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & np.uint64((1 << half) - 1))
        up = k >= ones
        k -= ones * up
        step = up * np.uint8(half)
        place += step
        word = word >> step
    return place.astype(np.int64)


class EliasFano:
    """A sorted sequence of distinct integers below ``universe``."""

    NAMES = ("high", "zeros", "low")

    def __init__(self, n: int, width: int, high: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.width = n, width
        self.high, self.zeros, self.low = high, zeros, low

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        width = max(0, (int(universe) // max(1, n)).bit_length() - 1)
        bits = np.zeros(n + (int(universe) >> width) + 2, np.uint8)
        bits[(values >> width) + np.arange(n)] = 1
        high = _to_words(bits)
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        zeros = 64 * np.arange(len(high), dtype=np.int64)   # zeros before each word
        zeros[1:] -= ones[:-1]
        return cls(n, width, high, zeros, _pack(values, width))

    def save(self, folder: str) -> None:
        for name in self.NAMES:
            np.save(os.path.join(folder, f"{name}.npy"), getattr(self, name))

    @classmethod
    def open(cls, folder: str, n: int, width: int) -> "EliasFano":
        # plain arrays over the mapped files: slices of a memmap are costly
        return cls(n, width, *(np.asarray(np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")) for name in cls.NAMES))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, off = at >> 6, (at & 63).view(np.uint64)
        out = self.low.take(word) >> off
        # two shifts: by 64 - off, which may be 64
        word += 1
        out |= (self.low.take(word) << (np.uint64(63) - off)) << _ONE
        out &= np.uint64((1 << self.width) - 1)
        return out

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) zero of the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return 64 * word + _select(~self.high.take(word), k - self.zeros.take(word))

    def _buckets(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first index, number of values) of each bucket of the universe: each ends in a zero."""
        start = self._zero(np.maximum(bucket - 1, 0)) + 1
        start[bucket == 0] = 0
        off = start & 63
        w = self.high.take(start >> 6) >> off.view(np.uint64)
        count = np.bitwise_count(w & ~(w + _ONE)).astype(np.int64)
        on = np.flatnonzero(count == 64 - off)  # they go on in the next word
        if len(on):
            count[on] = self._zero(bucket[on]) - start[on]
        return start - bucket, count

    def values(self) -> np.ndarray:
        """The whole sequence."""
        bits = np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little")
        upper = np.flatnonzero(bits)[:self.n] - np.arange(self.n)
        return (upper << self.width) | self._low(np.arange(self.n)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: its bucket by the pointers, then the successor of its low bits there.

        Values in order are found faster: those of one bucket share its pointers.
        """
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        bucket = x >> self.width
        fresh = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        if 2 * len(fresh) < len(x):
            runs = np.diff(fresh, prepend=0, append=len(x))
            at, count = (np.repeat(a, runs) for a in self._buckets(bucket[np.concatenate(([0], fresh))]))
        else:
            at, count = self._buckets(bucket)
        want = (x & ((1 << self.width) - 1)).view(np.uint64)
        live = np.flatnonzero(count > 1)
        lo, left, low = at[live], count[live], want[live]
        while len(live):  # successor search: half of the bucket's rest goes; a last value needs no search
            half = left >> 1
            mid = lo + half
            lo = np.where(self._low(mid - 1) < low, mid, lo)
            left -= half
            more = left > 1
            if 4 * np.count_nonzero(more) < 3 * len(live):
                at[live] = lo
                live, lo, left, low = live[more], lo[more], left[more], low[more]
        return np.where((count > 0) & (self._low(at) == want), at, -1)
