"""A compressed full-text index over word codes: Burrows-Wheeler transform in a wavelet matrix.

The index is the wavelet matrix, the symbols' counts and a table of the intervals of short patterns to begin
searches with; neither the text nor a suffix array is kept. The transform is sorted to a bounded
depth, which is enough for patterns up to that many words: the suffixes that begin with a pattern
are contiguous, and a step to the left counts suffixes that compare smaller within the depth.
Matching statistics of many ends go on side by side in arrays.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of symbols in a sequence; each level is packed bits with a count per 64 of them."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length()) if symbols > 1 else 1
        self.bits, self.ones, self.zeros = [], [], []
        seq = seq.astype(np.uint32)
        for shift in range(self.levels - 1, -1, -1):
            b = (seq >> np.uint32(shift)) & np.uint32(1)
            padded = np.zeros((len(b) // 64 + 1) * 64, np.uint8)
            padded[: len(b)] = b
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            count = np.bitwise_count(packed).astype(np.uint32)
            self.ones.append(np.cumsum(count, dtype=np.uint32) - count)
            self.zeros.append(int(len(b) - b.sum()))
            seq = np.concatenate([seq[b == 0], seq[b == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first `at` entries end among the symbol's entries on the last level; differences are ranks."""
        at = at.astype(np.int64)
        for level, shift in enumerate(range(self.levels - 1, -1, -1)):
            block = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[level][block].astype(np.int64) + np.bitwise_count(self.bits[level][block] & low)
            at = np.where((symbol >> shift) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index of a sequence of word codes 1, 2, ...; 0 separates texts and is part of no pattern."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, least: int = 1):
        self.depth, self.size, self.least = depth, len(text), least
        self.bits = max(1, int(symbols - 1).bit_length())
        #: Words of the patterns in the table.
        self.head = max(1, min(depth, 62 // self.bits, 3))
        codes = self._codes(text)
        suffixes = sort_suffixes(text, depth, codes, self.head)
        heads = codes[suffixes]
        before = text[suffixes - 1] if len(text) else text
        del suffixes
        self.tree = WaveletMatrix(before, symbols)
        count = np.bincount(text, minlength=symbols)
        first = np.cumsum(count) - count
        #: The first suffix of each symbol, less its place in the tree.
        self.shift = first - self.tree.place(np.arange(symbols), np.zeros(symbols, np.int64))
        new = np.flatnonzero(np.diff(heads, prepend=-1)) if len(heads) else np.zeros(0, np.int64)
        stop = np.append(new, len(heads))[1:]
        often = stop - new >= least
        #: Short patterns with at least `least` occurrences, and their intervals.
        self.heads, self.head_low, self.head_high = heads[new[often]], new[often].astype(np.uint32), stop[often].astype(np.uint32)

    def _codes(self, text: np.ndarray) -> np.ndarray:
        """The next `head` symbols of each place as one number; 0 stands for what is beyond the end."""
        out = text.astype(np.int64)
        for k in range(1, self.head):
            out <<= self.bits
            if k < len(text):
                out[:-k] |= text[k:]
        return out

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns to intervals of the patterns with a symbol before them."""
        return self.shift[symbol] + self.tree.place(symbol, low), self.shift[symbol] + self.tree.place(symbol, high)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, longest: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end (exclusive) in a streamed text: length of the longest match that ends there, up to `longest`, and its interval.

        A match is a run without 0 that occurs in the index at least `least` times; a streamed text that
        is indexed itself asks for 2 to learn what it shares with others. A symbol outside the index
        matches nothing. Ends whose match can't go on are left out of further steps.
        """
        longest = min(longest, self.depth)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        length, active = np.zeros(len(ends), np.int64), np.arange(len(ends))
        done = 0
        if longest >= self.head > 1 and least >= self.least and len(self.heads):
            # Matches of at least `head` words begin from the table; the others are found step by step.
            at = ends - self.head
            codes = self._codes(text)
            known = np.minimum(np.searchsorted(self.heads, codes[np.maximum(at, 0)]), len(self.heads) - 1)
            good = (at >= 0) & (self.heads[known] == codes[np.maximum(at, 0)])
            for k in range(self.head):
                symbol = text[np.maximum(at, 0) + k]
                good &= (symbol > 0) & (symbol < len(self.shift))
            a, z = self.head_low[known].astype(np.int64), self.head_high[known].astype(np.int64)
            good &= z - a >= least
            low[good], high[good], length[good] = a[good], z[good], self.head
            active, rest = np.flatnonzero(good), np.flatnonzero(~good)
            if len(rest):
                length[rest], low[rest], high[rest] = self._grown(text, ends[rest], np.arange(len(rest)), low[rest], high[rest], length[rest], 1, self.head - 1, least)
            done = self.head
        return self._grown(text, ends, active, low, high, length, done + 1, longest, least)

    def _grown(self, text, ends, active, low, high, length, first: int, last: int, least: int):
        for k in range(first, last + 1):
            at = ends[active] - k
            symbol = np.where(at >= 0, text[np.maximum(at, 0)], 0)
            on = (symbol > 0) & (symbol < len(self.shift))
            active, symbol = active[on], symbol[on]
            if not len(active):
                break
            a, z = self.step(symbol, low[active], high[active])
            found = z - a >= least
            active = active[found]
            low[active], high[active], length[active] = a[found], z[found], k
        return length, low, high


def sort_suffixes(text: np.ndarray, depth: int, codes: np.ndarray | None = None, width: int = 1) -> np.ndarray:
    """Suffix positions, sorted by their first `depth` symbols, ties by position; `codes` stand for the first `width` symbols."""
    n = len(text)
    _, rank = np.unique(text if codes is None else codes, return_inverse=True)
    known = width
    while known < depth:
        step = min(known, depth - known)
        known += step
        other = np.zeros(n, np.int64)
        if step < n:
            other[: n - step] = rank[step:] + 1
        key = rank * (int(other.max(initial=0)) + 1) + other
        if known >= depth:
            return np.argsort(key, kind="stable")
        _, rank = np.unique(key, return_inverse=True)
    return np.argsort(rank, kind="stable")
