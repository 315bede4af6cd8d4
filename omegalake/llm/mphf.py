"""Minimal perfect hashing of 64-bit keys by levels of bit arrays (Limasset et al., 2017)."""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that reaches it.
GAMMA = 2
#: Key seed of the fingerprints, apart from those of the levels.
_FINGERPRINT_SEED = 1 << 20


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Finaliser of splitmix64 over key and seed."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, _FINGERPRINT_SEED) >> np.uint64(32)).astype(np.uint32)


class MinimalPerfectHash:
    """Maps each of n distinct keys to its own number below n; other keys to any number or -1."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """words: the levels' bits, 64 to a word; sizes: words of each level."""
        self.words, self.sizes = words, sizes
        self._starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self._before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        left, words, sizes = keys.astype(np.int64).view(np.uint64), [], []
        while len(left):
            n = max(1, -(-GAMMA * len(left) // 64))
            slot = _mixed(left, len(sizes)) % np.uint64(64 * n)
            alone = np.bincount(slot.astype(np.int64), minlength=64 * n) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(n)
            left = left[~alone[slot.astype(np.int64)]]
        return cls(np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(sizes, np.int64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64).view(np.uint64)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, n in enumerate(self.sizes):
            if not len(open_):
                break
            slot = (_mixed(keys[open_], level) % np.uint64(64 * n)).astype(np.int64)
            at, bit = self._starts[level] + (slot >> 6), (slot & 63).astype(np.uint64)
            word = self.words[at]
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[hit]] = (self._before[at] + below)[hit]
            open_ = open_[~hit]
        return found
