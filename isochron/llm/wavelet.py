"""A wavelet matrix over the character classes of UTF-8 text."""

from __future__ import annotations

import numpy as np

#: Classes of bytes: the rest of a character, a letter inside a run, a letter that opens one, white space, anything else.
REST, INSIDE, OPENING, SPACE, OTHER = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[0x80:0xC0] = REST
_KIND[[*range(65, 91), *range(97, 123)]] = INSIDE
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE


def classes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte; a letter opens a run unless a letter of the same text precedes it."""
    out = _KIND[buf]
    letter = out == INSIDE
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    first = starts[starts < len(buf)]
    opens[first] = letter[first]
    out[opens] = OPENING
    return out


class Bits:
    """A bit vector with a rank directory: 64 bits a word and the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(self.before[-1] + np.bitwise_count(self.words[-1]))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """A sequence of classes below 2**levels as a bit vector per level, zeros sorted before ones on the way down."""

    def __init__(self, seq: np.ndarray, levels: int = 3):
        self.levels: list[Bits] = []
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.levels.append(Bits(bit))
            if level:
                seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position i (for an array of positions)."""
        lo, hi = np.zeros_like(i), i
        for level, bits in enumerate(self.levels):
            ones_lo, ones_hi = bits.rank(lo), bits.rank(hi)
            if (symbol >> (len(self.levels) - 1 - level)) & 1:
                zeros = bits.n - bits.ones
                lo, hi = zeros + ones_lo, zeros + ones_hi
            else:
                lo, hi = lo - ones_lo, hi - ones_hi
        return hi - lo

    def boundaries(self, i: np.ndarray) -> np.ndarray:
        """Tokens that start before position i: opened runs, white space and other characters."""
        return self.rank(OPENING, i) + self.rank(SPACE, i) + self.rank(OTHER, i)

    def characters(self, i: np.ndarray) -> np.ndarray:
        """Characters that start before position i."""
        return i - self.rank(REST, i)

    def locate(self, k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first position in [lo, hi] with k tokens between lo and the end of that token.

        Bisection on boundary counts: the largest position that no more than k tokens
        precede, so that token k (from 0) starts there, or hi if there are only k.
        """
        base = self.boundaries(lo)
        left, right = lo.copy(), hi.copy()
        while True:
            open_ = left < right
            if not open_.any():
                return left
            mid = (left + right + 1) >> 1
            fits = self.boundaries(mid) - base <= k
            left = np.where(open_ & fits, mid, left)
            right = np.where(open_ & ~fits, mid - 1, right)
