"""A minimal perfect hash over 64-bit keys, as levels of bits with ranks, built and probed by arrays."""

from __future__ import annotations

import numpy as np

from .common import U64, mix

GAMMA = 1.6


class PerfectHash:
    """Each key has its own slot in 0..n-1. Keys that collide at one level go on to the next.

    `slots` of a key that is no member is -1 or the slot of some member: compare fingerprints.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.rank, before = [], 0
        for bits in levels:
            self.rank.append(before + np.cumsum(bits, dtype=np.int64) - bits)
            before += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(8, int(GAMMA * len(keys)))
            at = (mix(keys, 100 + len(levels)) % U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, bits in enumerate(self.levels):
            at = (mix(keys[left], 100 + n) % U64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.rank[n][at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels)
