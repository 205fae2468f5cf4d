"""Minimal perfect hashing of whole numbers: n keys to the places 0 to n - 1.

Keys are hashed into a bit array of GAMMA bits a key. A key that falls on a bit alone sets it;
those that meet go on to the next, smaller array. A key's place is the number of bits set
before its own over all arrays, so the function needs a few bits a key and no keys. Other
numbers get some place too: ``PerfectHash`` keeps the keys by place and verifies them.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.5
# After a level about half of its keys are placed; distinct keys are apart long before this.
LEVELS = 200


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64 bits; different keys have different ones."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class PerfectHash:
    """The bit arrays of one set of distinct keys (64-bit, not negative), and the keys by place."""

    def __init__(self, words: np.ndarray, sizes: list[int], keys: np.ndarray):
        self.words, self.sizes, self.keys = words, sizes, keys
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, arrays, sizes = keys.astype(np.int64), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys repeat")
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            counts = np.bincount(at, minlength=size)
            arrays.append(np.packbits(counts == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[counts[at] > 1]
        own = cls(np.concatenate(arrays) if arrays else np.zeros(0, "<u8"), sizes, np.zeros(0, np.int64))
        place = own._places(keys.astype(np.int64))
        own.keys = np.zeros(len(keys), np.int64)
        own.keys[place] = keys
        return own

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys of the set; -1 or any place for others."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left, start = left[~hit], start + size
        return out

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, verified; -1 for numbers that are no keys."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self._places(keys)
        return np.where((out >= 0) & (self.keys[out] == keys), out, -1)
