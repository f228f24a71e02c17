"""Monotone integer sequences in Elias-Fano form, on numpy arrays that may be mapped from a file."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A sorted sequence of 64-bit numbers.  The low bits (whole bytes) lie in an array, the
    high bits in a bit string: for every number a 1, and a 0 where the high part goes up by one."""

    def __init__(self, low: np.ndarray, words: np.ndarray, zeros: np.ndarray, size: int, width: int):
        self.low, self.words, self.zeros, self.size, self.width = low, words, zeros, size, width
        self.ones = (np.arange(len(words) + 1, dtype=np.int64) * 64) - zeros

    @classmethod
    def of(cls, values: np.ndarray, place: Callable[[np.ndarray], np.ndarray] = lambda a: a) -> "EliasFano":
        """``place`` stores an array and gives the stored one back (a mapped file, say)."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(values[-1]).bit_length() - max(1, n).bit_length() + 1) if n else 0
        width = -(-bits // 8)
        if width == 8:
            width = 7
        low = np.zeros((n, width), np.uint8)
        for k in range(width):
            low[:, k] = (values >> np.uint64(8 * k)).astype(np.uint8)
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        length = n + (int(high[-1]) if n else 0) + 1
        flags = np.zeros(-(-length // 64) * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        words = np.packbits(flags, bitorder="little").view("<u8")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
        return cls(place(low.ravel()).reshape(n, width), place(words), place(zeros), n, width)

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th (from 0) 1 bit, or 0 bit if ``flip``."""
        at = np.searchsorted(counts, k, "right") - 1
        word = self.words[at]
        word = ~word if flip else word.copy()
        left = k - counts[at]
        place = at * 64
        for half in (32, 16, 8, 4, 2, 1):
            lower = word & ((_ONE << np.uint64(half)) - _ONE)
            inside = np.bitwise_count(lower).astype(np.int64)
            up = left >= inside
            left = np.where(up, left - inside, left)
            word = np.where(up, word >> np.uint64(half), lower)
            place = place + np.where(up, half, 0)
        return place

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(self.width):
            out |= self.low[at, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, self.ones, False) - at).astype(np.uint64)
        return high << np.uint64(8 * self.width) | self._lows(at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Place of the first number that is not smaller than each value."""
        values = np.asarray(values, np.uint64)
        if self.size == 0:
            return np.zeros(len(values), np.int64)
        high = values >> np.uint64(8 * self.width)
        top = np.uint64(int(self.zeros[-1]) - 1)
        beyond = high > top
        high = np.minimum(high, top).astype(np.int64)
        end = np.minimum(self._select(high, self.zeros, True) - high, self.size)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - high + 1, 0)
        start = np.minimum(start, end)
        low = values & ((_ONE << np.uint64(8 * self.width)) - _ONE)
        stop = end.copy()
        while (open_ := start < stop).any():
            middle = (start + stop) // 2
            smaller = np.zeros(len(values), bool)
            smaller[open_] = self._lows(middle[open_]) < low[open_]
            start = np.where(open_ & smaller, middle + 1, start)
            stop = np.where(open_ & ~smaller, middle, stop)
        return np.where(beyond, self.size, start)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it is not in the sequence."""
        values = np.asarray(values, np.uint64)
        if self.size == 0:
            return np.full(len(values), -1)
        at = self.successor(values)
        near = np.minimum(at, self.size - 1)
        return np.where((at < self.size) & (self[near] == values), near, -1)
