"""FM-index over whole numbers: suffix array, Burrows-Wheeler transform, wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; the last symbol must be smaller than all others."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key)  # equal keys get one rank, so their order does not matter
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step * 2 >= n:
            return order
        step *= 2


class Bits:
    """Packed bits with running counts: the number of ones before a place in two look-ups."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def ones(self, i: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class FMIndex:
    """Counts of patterns in a text of symbols >= 1 by backward search, for many patterns at a time."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0)
        order = suffix_array(text)
        transform = text[order - 1]
        size = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.length, self.levels = len(text), []
        for bit in range(max(int(size - 1).bit_length() - 1, 0), -1, -1):
            ones = (transform >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), int(len(ones) - ones.sum())))
            transform = np.concatenate([transform[~ones], transform[ones]])
        every = np.arange(size)
        # what lies before a symbol in the last level follows from the symbol alone
        self.shift = self.first[every] - self._down(every, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.ones(place)
            place = np.where((symbol >> bit) & 1 == 1, zeros + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that start with ``symbol`` followed by the patterns of rows low to high."""
        return self.shift[symbol] + self._down(symbol, low), self.shift[symbol] + self._down(symbol, high)

    def occurs_again(self, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` symbols from each start of ``text`` are found twice or more.

        The statistic of a place is cut off at ``length``; a pattern found only once is given up as soon as that shows.
        """
        alive, last = np.arange(len(starts)), text[starts + length - 1]
        low, high = self.first[last], self.first[last + 1]
        for k in range(length - 2, -2, -1):
            go_on = high - low > 1
            alive, low, high = alive[go_on], low[go_on], high[go_on]
            if k >= 0:
                low, high = self.extend(text[starts[alive] + k], low, high)
        out = np.zeros(len(starts), bool)
        out[alive] = True
        return out
