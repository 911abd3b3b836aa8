"""Minimal perfect hashing of sets of 64-bit keys, in numpy.

Level by level each key is hashed into twice as many cells as there are keys;
keys that are alone in their cell are placed there, the others go on.  The index
of a key is the number of filled cells before its own, so n keys have the
indexes 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

LEVELS = 100


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of keys and seed (two multiplications, three shifts)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, LEVELS) % np.uint64(shards)).astype(np.int64)


class PerfectHash:
    """``cells``: for each level a boolean array of the filled cells."""

    def __init__(self, cells: list[np.ndarray]):
        self.cells = cells
        counts = [np.cumsum(c) - c for c in cells]
        before = np.cumsum([0] + [int(c.sum()) for c in cells])
        self.ranks = [c + b for c, b in zip(counts, before)]
        self.size = int(before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Over distinct keys; a repeated key is an error."""
        cells: list[np.ndarray] = []
        while len(keys):
            if len(cells) == LEVELS:
                raise ValueError("keys are not distinct")
            m = max(64, 2 * len(keys))
            h = (mixed(keys, len(cells)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(h, minlength=m) == 1
            cells.append(alone)
            keys = keys[~alone[h]]
        return cls(cells)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The keys' indexes; a key outside of the set has any index, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (cells, ranks) in enumerate(zip(self.cells, self.ranks)):
            if not len(left):
                break
            h = (mixed(keys[left], level) % np.uint64(len(cells))).astype(np.int64)
            filled = cells[h]
            out[left[filled]] = ranks[h[filled]]
            left = left[~filled]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.cells), *[len(c) for c in self.cells]], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(c).tobytes() for c in self.cells)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        at, cells = 8 * (n + 1), []
        for size in np.frombuffer(data, "<i8", n, 8).tolist():
            width = (size + 7) // 8
            cells.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(cells)


class CountTable:
    """Counts of keys by perfect hash; the stored keys tell a key of the set from others."""

    def __init__(self, function: bytes, keys: bytes, counts: bytes):
        self.hash = PerfectHash.from_bytes(function)
        self.keys, self.counts = np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' counts, 0 for keys that aren't in the set."""
        if not self.hash.size:
            return np.zeros(len(keys), np.int64)
        at = self.hash.index(keys)
        return np.where((at >= 0) & (self.keys[at] == keys), self.counts[at], 0)
