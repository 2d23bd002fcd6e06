"""A cuckoo filter over 128-bit keys: insertion, deletion and lookup of whole arrays."""

from __future__ import annotations

import numpy as np

from .common import U64, mix

SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a fingerprint may lie in either of two buckets.

    Lookups of what was inserted never fail; others are taken for members with a
    probability of about 8 / 2**16.  Only keys that were inserted may be deleted.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(capacity / SLOTS / 0.85)) - 1).bit_length()
            table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.table = table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray):
        print_ = (mix(k2) >> U64(48)).astype(np.int64) | 1
        mask = len(self.table) - 1
        first = (mix(k1).astype(np.int64)) & mask
        return print_, first, (first ^ self._jump(print_)) & mask

    @staticmethod
    def _jump(print_):
        return (mix(np.asarray(print_, dtype=np.int64).astype(U64)) >> U64(8)).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(k1, k2)
        p = print_.astype(np.uint16)[:, None]
        return (self.table[first] == p).any(axis=1) | (self.table[second] == p).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Insert keys that are not members yet.  The table doubles are the caller's: a full one raises."""
        mask = len(self.table) - 1
        rng = np.random.default_rng(len(k1))
        for print_, *both in zip(*self._places(k1, k2), strict=True):
            for _ in range(500):
                free = [(b, s) for b in both for s in range(SLOTS) if not self.table[b, s]]
                if free:
                    self.table[free[0]] = print_
                    break
                at = both[rng.integers(2)], rng.integers(SLOTS)
                print_, self.table[at] = int(self.table[at]), print_
                both = [at[0], int((at[0] ^ self._jump(print_)) & mask)]
                both = both[::-1]
            else:
                raise OverflowError("cuckoo filter is full")

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for print_, *both in zip(*self._places(k1, k2), strict=True):
            at = next((b, s) for b in both for s in range(SLOTS) if self.table[b, s] == print_)
            self.table[at] = 0


def build(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    """A filter of all keys given, in a table that grows until they fit."""
    capacity = max(len(k1), 4)
    while True:
        made = CuckooFilter(capacity)
        try:
            made.insert(k1, k2)
            return made
        except OverflowError:
            capacity *= 2
