"""Text keys, what workers keep, and vectorised byte hashing; shared folders and tables are the session's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, materialize, remove, shared_dir

__all__ = ["U64", "RollingHash", "batches", "cached", "fresh_path", "materialize", "mix", "powers", "release", "remove", "shared_dir", "small_batches", "text_key"]

U64 = np.uint64


#: What a worker process keeps from task to task, one kind at a time.
_CACHE: dict = {}


def cached(kind: str, make):
    """The process's object of this kind; an object of another kind is let go first."""
    if kind not in _CACHE:
        _CACHE.clear()
        _CACHE[kind] = make()
    return _CACHE[kind]


def release() -> None:
    """Let go of what tasks of other operators have left in this process."""
    _CACHE.clear()
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Send texts to Python workers by the thousand and by 4 MB at most: what a worker holds must not grow with the length of texts.

    A session whose user has set a number of rows or of bytes keeps it.
    """
    for name, default, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", f"{size}b")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)


def text_key(text: Column) -> list[Column]:
    """A 128-bit key of a text; equal texts are alike in every operator that uses it."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("second"), text).alias("_t2")]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on an array of uint64."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, dtype=U64)
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


class RollingHash:
    """Polynomial hash of any byte range of a buffer, from one prefix sum.

    hash(i, j) = sum of T[b[k]] * B**(k - i) for i <= k < j, modulo 2**64.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=U64)
        self.base = int(rng.integers(0, 2**60)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self._down = powers(self.inverse, 1)
        self._up = powers(self.base, 1)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            n = 1 << (n - 1).bit_length()
            self._up, self._down = powers(self.base, n), powers(self.inverse, n)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, dtype=U64)
        np.cumsum(self.table[buf] * self._up[: len(buf)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self._down[start]


def batches(rows: list[bytes], limit: int):
    """Consecutive slices of rows of at most limit bytes each, a longer row alone."""
    at, held = 0, 0
    for i, row in enumerate(rows):
        if i > at and held + len(row) > limit:
            yield at, i
            at, held = i, 0
        held += len(row)
    if at < len(rows):
        yield at, len(rows)
