"""Minimal perfect hashing of stored keys, in numpy.

A level is a table of bits, somewhat more than keys are left. Each key falls on one bit of it; keys
that are alone there are placed, the others go on to the next level. A key's slot is the number of
placed keys before its bit, so n keys have the slots 0 to n-1. Any other key gets some slot, or none:
callers compare it with the key that is stored there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words

#: Bits of a level for each key that is left.
ROOM = 2.0


class PerfectHash:
    """Slots of distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, placed = np.asarray(keys, words.U), 0
        while len(left):
            at = self._places(left, len(self.levels), max(8, int(ROOM * len(left))))
            alone = np.bincount(at, minlength=max(8, int(ROOM * len(left)))) == 1
            self.levels.append((alone, placed + np.cumsum(alone) - 1))
            placed += int(alone.sum())
            left = left[~alone[at]]
        self.size = placed

    @staticmethod
    def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (words.mix(keys + words.U(level * 0x9E3779B97F4A7C15 % (1 << 64))) % words.U(bits)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for one that isn't stored."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._places(keys[todo], level, len(alone))
            hit = alone[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out


class StoredKeys:
    """Distinct names, of which each has a 64-bit key; find() answers for names by their keys and compares the names.

    Names whose keys are equal share a slot's key: the first one has the slot, the others are numbered after all slots.
    """

    def __init__(self, keys: np.ndarray, names: pa.Array):
        own, first = np.unique(keys, return_index=True)
        self.hash = PerfectHash(own)
        slot = self.hash.slots(own)
        order = np.empty(len(own), np.int64)
        order[slot] = first
        twins = np.setdiff1d(np.arange(len(keys)), first)
        self.keys, self.names = np.concatenate([keys[order], keys[twins]]), pa.concat_arrays([names.take(pa.array(order)), names.take(pa.array(twins))])
        self.twins = {self.names[k].as_py(): k for k in range(len(own), len(keys))}

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray, names: pa.Array) -> np.ndarray:
        """The number of each name, -1 for one that isn't stored."""
        slot = self.hash.slots(keys)
        same = np.zeros(len(keys), bool)
        some = np.flatnonzero(slot >= 0)
        if len(some):
            same[some] = pc.equal(self.names.take(pa.array(slot[some])), names.take(pa.array(some))).to_numpy(zero_copy_only=False)
        out = np.where(same, slot, -1)
        if self.twins:
            for k in np.flatnonzero(~same).tolist():
                out[k] = self.twins.get(names[k].as_py(), -1)
        return out
