"""Vectorised word splitting and hashing over the bytes of many texts at once.

A word is a maximal run of word bytes inside one text. Hashes are 64 bits: a
polynomial over random byte values, from prefix sums, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_NEXT = U(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)

#: Bytes of words: all but white space; and only digits, lower-case letters and bytes of other code points.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Powers kept by a worker, at most; longer runs of bytes make theirs anew and drop them.
KEPT_POWERS = 1 << 21
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_powers[0]):
        return _powers[0], _powers[1]
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    made = []
    for f in (_BASE, inverse):
        steps = np.full(max(n, min(2 * n, KEPT_POWERS)), f, U)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps, out=steps))
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the input changes about half of the output's."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


@dataclass
class Words:
    """Words of a run of texts; `first` has n+1 entries, the index of each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its text."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(data: np.ndarray, offs: np.ndarray, table: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Words of texts given as bytes and n+1 offsets."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(offs), np.int64))
    if lower:
        data = LOWER[data]
    word = table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    cut = offs[1:-1]
    before[cut[cut < n]] = False
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    power, inverse = _power_tables(n)
    total = np.empty(n + 1, U)
    total[0] = 0
    values = _BYTE[data]
    values *= power[:n]
    np.cumsum(values, out=total[1:])
    h = total[ends]
    h -= total[starts]
    h *= inverse[starts]
    return Words(mix(h), starts, ends, np.searchsorted(starts, offs).astype(np.int64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, len-k+1 entries; texts' borders are the caller's matter."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    out, done = None, 0
    part, width, power = hashes, 1, int(_NEXT)
    while True:  # binary digits of k: the window is made of blocks whose widths are powers of two
        factor = U(power)
        if k & width:
            piece = part[done : done + m]
            out = piece.copy() if out is None else out * factor + piece
            done += width
        if width * 2 > k:
            break
        part = part[:-width] * factor + part[width:]
        power = power * power % (1 << 64)
        width *= 2
    return mix(out ^ U(k))
