"""Word shingles and SuperMinHash signatures of whole texts, vectorised over many documents."""

from __future__ import annotations

import numpy as np

from .common import U64, RollingHash, batches, mix

_WORD = RollingHash(101)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PLACE = mix(np.arange(1, 65, dtype=U64)) | U64(1)
CHUNK = 1 << 18


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.  A text
    of fewer than ``k`` words is one shingle, a text without words none.
    """
    out: list[np.ndarray] = []
    for lo, hi in batches(texts, CHUNK):
        out += _chunk([t.lower() for t in texts[lo:hi]], k)
    return out


def _chunk(texts: list[bytes], k: int) -> list[np.ndarray]:
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = mix(_WORD.ranges(_WORD.prefix(buf), start, end) + (end - start).astype(U64))
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    at = np.searchsorted(start, first)
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, dtype=U64)
    for i in range(k):
        total += words[i : i + n] * _PLACE[i]
    total = mix(total)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            s = np.sort(total[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def super_minhash(sets: list[np.ndarray], m: int, limit: int = 50_000) -> np.ndarray:
    """SuperMinHash signatures, a row of ``m`` values per set; empty sets keep the largest value.

    Each element walks its own random permutation of the m places (a Fisher-Yates shuffle
    that its hash seeds) and offers level + r at the place it reaches on each level.  A
    place takes its least offer, so what a level fills no later level changes, and a set
    is done when all its places are filled: large sets stop after one or two levels.
    """
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=U64)
    sizes = [s.tobytes() for s in sets]
    for lo, hi in batches(sizes, limit * 8):
        _levels(sets[lo:hi], out[lo:hi], m)
    return out


def _levels(sets: list[np.ndarray], sig: np.ndarray, m: int) -> None:
    h = np.concatenate(sets) if sets else np.empty(0, U64)
    d = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, order = sig.reshape(-1), None
    for level in range(m):
        if not len(h):
            return
        x = mix(h + U64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
        k = (level + (((x & U64(0xFFFFFFFF)) * U64(m - level)) >> U64(32)).astype(np.int64))
        if level == 0:
            place, first = k, k
        else:
            rows = np.arange(len(h))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, level]
        np.minimum.at(flat, d * m + place, (U64(level) << U64(32)) | (x >> U64(32)))
        open_ = (sig == np.iinfo(np.uint64).max).any(axis=1)[d]
        if not open_.any():
            return
        h, d = h[open_], d[open_]
        if level == 0:
            first = first[open_]
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(h), 1))
            order[np.arange(len(h)), first] = 0
        else:
            order = order[open_]


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` neighbouring values, different for each band."""
    bands = sig.shape[1] // rows
    out = np.zeros((len(sig), bands), dtype=U64)
    for r in range(rows):
        out = mix(out + sig[:, r : bands * rows : rows] * _PLACE[r])
    return mix(out + _PLACE[:1] * np.arange(1, bands + 1, dtype=U64))


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        return np.array([(mix(s).sum(dtype=U64), mix(s ^ _PLACE[9]).sum(dtype=U64)) for s in sets], dtype=U64).reshape(-1, 2)
