"""An FM-index over integer symbols: suffix array, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions.

All queries are answered for many patterns at once with array operations.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the least and occur once."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype("int64")
    k = 1
    while True:
        ahead = np.zeros(n, "int64")
        ahead[:-k] = rank[k:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="quicksort")
        sorted_key = key[order]
        new = np.empty(n, "int64")
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class WaveletTree:
    """Levels of bits, most significant first, each with its counts of ones (the pointerless layout: zeros go left)."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels, self.ones, self.zeros = max(1, int(sigma - 1).bit_length()), [], []
        now = symbols
        for level in range(self.levels):
            bit = (now >> (self.levels - 1 - level)) & 1
            ones = np.zeros(len(now) + 1, "int32")
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.base = self._down(np.arange(sigma, dtype="int64"), np.zeros(sigma, "int64"))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self.ones[level][at]
            at = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbol, at) - self.base[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(at), "int64")
        for level in range(self.levels):
            ones = self.ones[level][at]
            bit = self.ones[level][at + 1] - ones
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return symbol, at - self.base[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, every: int = 8) -> None:
        sa = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[sa - 1].astype("int64"), sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        marked = sa % every == 0
        self.marked, self.marks_before = marked, np.concatenate(([0], np.cumsum(marked)))
        self.samples = sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, from, to): the patterns (rows) that occur and their ranges of suffixes, by backward search."""
        which = np.arange(len(patterns))
        last = patterns[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
            c = patterns[which, k]
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
        alive = lo < hi
        return which[alive], lo[alive], hi[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix: steps back through the text to the nearest sampled one."""
        out, steps, todo = np.empty(len(rows), "int64"), 0, np.arange(len(rows))
        at = rows
        while len(todo):
            hit = self.marked[at]
            out[todo[hit]] = self.samples[self.marks_before[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, rank = self.tree.access(at)
            at = self.first[symbol] + rank
            steps += 1
        return out % self.n
