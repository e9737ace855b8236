"""A minimal perfect hash of distinct 64-bit keys in levels of bit arrays: a key sits in the first level where no other key falls on its bit."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * _A
    h = (h ^ (h >> np.uint64(33))) * _B
    return ((h ^ (h >> np.uint64(33))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """find(keys) numbers the n keys it was built from 0 to n-1; for any other key it gives some number or -1."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.5):
        self.n, self.sizes, bits = len(keys), [], []
        rest = keys.astype(np.uint64)
        while len(rest):
            size = max(64, int(gamma * len(rest)) + 1)
            at = _place(rest, len(self.sizes), size)
            hits = np.bincount(at, minlength=size)
            bits.append(hits == 1)
            self.sizes.append(size)
            rest = rest[hits[at] > 1]
            if len(self.sizes) > 200:
                raise ValueError("keys are not distinct")
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.words = np.packbits(np.pad(flat, (0, -len(flat) % 64)), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _place(keys[todo].astype(np.uint64), level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.before[at[hit] >> 6] + below
            todo, base = todo[~hit], base + size
        return out
