"""Minimal perfect hashing of distinct 64-bit numbers, with the numbers kept for verification.

Level by level, every number left is hashed to a bit of a table twice as wide as there are numbers; bits hit once are set
and their numbers are done, all others go to the next level. The place of a number is the rank of its bit, so n numbers have
the places 0 to n - 1, at about 3.3 bits each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from linewright.llm.words import mixed

WIDTH = 2
#: Far more levels than distinct numbers need; only repeated ones, which never part, get there.
MOST_LEVELS = 200


def _spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (mixed(keys.astype(np.uint64) ^ salt) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """sizes: bits of each level; bits: all levels, 64 to a number; keys: each number at its place."""

    sizes: np.ndarray
    bits: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray

    @classmethod
    def restored(cls, sizes: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> PerfectHash:
        counts = np.bitwise_count(bits).astype(np.int64)
        return cls(sizes, bits, keys, np.cumsum(counts) - counts)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        keys = np.asarray(keys, np.int64)
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("a perfect hash needs distinct numbers")
            size = -(-WIDTH * len(left) // 64) * 64
            spots = _spots(left, len(sizes), size)
            once = np.bincount(spots, minlength=size) == 1
            levels.append(once)
            sizes.append(size)
            left = left[~once[spots]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        bits = np.packbits(flat, bitorder="little").view("<u8")
        empty = cls.restored(np.array(sizes, np.int64), bits, np.zeros(0, np.int64))
        placed = np.empty(len(keys), np.int64)
        placed[empty.places(keys)] = keys
        return cls(empty.sizes, bits, placed, empty.ranks)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number that was hashed; any place, or -1, for others."""
        keys = np.asarray(keys, np.int64)
        place = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        start = 0
        for level, size in enumerate(self.sizes.tolist()):
            spot = _spots(keys[left], level, size) + start
            word, shift = spot >> 6, (spot & 63).astype(np.uint64)
            here = (self.bits[word] >> shift) & np.uint64(1) == 1
            before = self.bits[word] & ((np.uint64(1) << shift) - np.uint64(1))
            place[left[here]] = (self.ranks[word] + np.bitwise_count(before))[here]
            left = left[~here]
            start += size
        return place

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, or -1 where the number was not hashed."""
        place = self.places(keys)
        known = place >= 0
        known[known] = self.keys[place[known]] == np.asarray(keys, np.int64)[known]
        return np.where(known, place, -1)
