"""Vector best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import ranked
from .common import cached, materialize, small_batches

PIECES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words(dict):
    """Numbers of words whose token ids are known, by word; a new word is tokenised when it is asked for.

    The tokenizer drops white space and never merges across it, so a text's ids are the
    ids of its words in a row.  A lower-cased Latin-1 word of letters is one piece to the
    tokenizer and goes straight to its merge model, as the byte-level characters that the
    model expects; everything else takes the whole way.  At ``keep`` words all are
    forgotten, which bounds a process's memory.
    """

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep = keep
        odd = [*range(33), *range(127, 161), 173]  # bytes without a visible character stand as 256, 257, ...
        self.visible = {b: 256 + i for i, b in enumerate(odd)}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.first, self.size, self.pool = array("q"), array("q"), array("I")
        self._put("", [])

    def _put(self, word: str, ids) -> int:
        self[word] = n = len(self.first)
        self.first.append(len(self.pool))
        self.size.append(len(ids))
        self.pool.extend(ids)
        return n

    def __missing__(self, word: str) -> int:
        if word.isalpha() and word.islower() and max(word) <= "\xff":
            return self._put(word, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.visible))])
        if word[-1] in ".,!?" and word[:-1].isalpha():
            # a mark after letters is a token of its own
            a, b = self[word[:-1]], self[word[-1]]
            return self._put(word, [*self._ids(a), *self._ids(b)])
        return self._put(word, self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _ids(self, n: int) -> array:
        return self.pool[self.first[n] : self.first[n] + self.size[n]]

    def encode(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
            text = text.lower()  # the tokenizer would; more words are known so
        except UnicodeEncodeError:
            pass
        if len(self) > self.keep:
            self.forget()
        words = text.replace("\n", " ").split(" ")
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        first, size = np.frombuffer(self.first, np.int64)[at], np.frombuffer(self.size, np.int64)[at]
        ends = np.cumsum(size)
        return np.frombuffer(self.pool, np.uint32)[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)] if len(self.pool) else np.empty(0, np.uint32)


def pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end: int = 0) -> DataFrame:
    """Token ids of each document with ``end`` after them, cut every ``most`` ids."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cached(f"words {tokenizer}", lambda: Words(tokenizer))
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = np.append(words.encode(text or ""), np.uint32(end)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), most)):
                    own = ids[at : at + most]
                    rows.append((doc_id, i, at, len(own), zlib.crc32(own.tobytes())))
            columns = zip(*rows, strict=True) if rows else [()] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, PIECES.values(), strict=True)], list(PIECES))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, SCHEMA)


class OpenBins:
    """Open bins by what they have left.  Bins filled alike are one run of bin numbers."""

    def __init__(self, caps: np.ndarray, weights: np.ndarray, by: str):
        self.caps, self.weights, self.by = caps, weights, by
        self.left = np.zeros((256, 3), np.int64)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        self.at: dict[tuple, int] = {}
        self.free = list(range(255, -1, -1))

    def put(self, left: tuple[int, int, int], runs: list[tuple[int, int]]) -> None:
        if left not in self.at:
            if not self.free:
                n = len(self.left)
                self.left = np.concatenate([self.left, np.zeros_like(self.left)])
                self.runs += [[] for _ in range(n)]
                self.free = list(range(2 * n - 1, n - 1, -1))
            self.at[left] = i = self.free.pop()
            self.left[i] = left
        self.runs[self.at[left]] += runs

    def best(self, need: np.ndarray) -> tuple[int, int, int] | None:
        fit = np.flatnonzero((self.left >= need).all(axis=1))
        if not len(fit):
            return None
        left = self.left[fit] / self.caps
        demand = need / self.caps
        score = (self.weights * left * demand).sum(axis=1) if self.by == "dot" else (self.weights * (left - demand) ** 2).sum(axis=1)
        order = np.lexsort((*self.left[fit].T, score))
        return tuple(self.left[fit[order[0]]].tolist())

    def take(self, left: tuple[int, int, int], n: int) -> list[tuple[int, int]]:
        i, out = self.at[left], []
        while n and self.runs[i]:
            first, have = self.runs[i].pop()
            got = min(n, have)
            out.append((first, got))
            if got < have:
                self.runs[i].append((first + got, have - got))
            n -= got
        if not self.runs[i]:
            self.left[i] = 0
            self.free.append(i)
            del self.at[left]
        return out


def plan(histogram: dict[int, int], tokens: int = 2048, docs: int = 2048, cost: int = 2048 * 2048,
         weights: tuple[float, float, float] = (1.0, 1.0, 1.0), by: str = "norm") -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Vector best-fit over a histogram of lengths, longest first.

    An item of length n asks for (n tokens, 1 document, n * n attention cost).  It goes to
    an open bin in which every residual suffices: the one whose residual after placing has
    the least weighted norm (``by="norm"``), or whose residual has the least weighted dot
    product with the demand (``by="dot"``).  Residuals and demands count as shares of their
    capacity, so the three weigh alike unless ``weights`` say otherwise.  A bin is opened if
    there is none.  Bins filled alike are one run, so the work depends on the number of
    lengths and of ways to fill a bin, not on that of items.
    Returns rows (length, first rank, count, first bin, offset), where ranks count the
    items of a length, and the number of bins.
    """
    caps = np.array([tokens, docs, cost], dtype=np.int64)
    open_ = OpenBins(caps, np.array(weights), by)
    least = min(histogram, default=0)
    rows, bins = [], 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > caps).any():
            raise ValueError(f"an item of {length} tokens fits no bin")
        n, rank, most = histogram[length], 0, int((caps // need).min())
        while rank < n:
            left = open_.best(need)
            if left:
                got = open_.take(left, n - rank)
            else:
                left = tuple(caps.tolist())
                got = [(bins, max(1, (n - rank) // most))]  # as many as this length fills, or one
                bins += got[0][1]
            for first, count in got:
                rows.append((length, rank, count, first, tokens - left[0]))
                rank += count
            rest = tuple((np.array(left) - need).tolist())
            if rest[0] >= least and rest[1] >= 1 and rest[2] >= least * least:
                open_.put(rest, got)
    return rows, bins


def fewest(histogram: dict[int, int], tokens: int = 2048, **how) -> tuple[list[tuple[int, int, int, int, int]], int, dict[str, int]]:
    """The plan of tightest capacities that needs no more bins than tokens alone would; with these capacities.

    Sequences should be alike in documents and attention cost, not in tokens only, but never
    at the price of more sequences.  So both capacities start near their means, sixteen times
    the documents and twice the cost of an average bin (a longest item must fit), and grow
    fourfold until the count of bins is that of the plan without them.  Where items fill whole bins
    the cost starts at tokens * tokens, which it cannot exceed.
    """
    rows, free = plan(histogram, tokens, tokens, tokens * tokens, **how)
    caps = {"docs": tokens, "cost": tokens * tokens}
    if not free:
        return rows, free, caps
    mean = sum(n * n * k for n, k in histogram.items()) / free
    docs, cost = 16 * -(-sum(histogram.values()) // free), max(max(histogram) ** 2, 2 * int(mean))
    while docs < tokens or cost < tokens * tokens:
        caps = {"docs": min(docs, tokens), "cost": min(cost, tokens * tokens)}
        tight, bins = plan(histogram, tokens, **caps, **how)
        if bins <= free:
            return tight, bins, caps
        docs, cost = 4 * docs, 4 * cost
    return rows, free, {"docs": tokens, "cost": tokens * tokens}


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, **how) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Documents are tokenised once; only their pieces' lengths and checksums are kept.  The
    histogram of lengths (at most ``most`` rows) is packed on the driver; each length's
    items are numbered by exact ranks that bring no hot length to one task, and a table of
    placements maps (length, rank) to sequence and offset.  It has a row for each length and
    way of filling that meet, not for each document: 6,400 rows for 11,000 pieces, 13,900
    for fifty times as many.  Capacities of documents and cost are the tightest that cost no
    further sequence (``fewest``) unless they are given.

    Null text: empty, so the end id alone.  Null or repeated doc_id: each row is packed on
    its own.  Empty table: no rows.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    found = materialize(pieces(docs, tokenizer, most), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan(histogram, tokens=most, **how) if {"docs", "cost"} & how.keys() else fewest(histogram, most, **how)[:2]
    rows.sort()
    columns = [np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else [()] * 5)]
    sent = docs.sparkSession.sparkContext.broadcast(columns)
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "ids_crc32"), 1)
    items = ranked(found.withColumn("_h", h), "length", F.floor(F.col("_h") / F.lit(float(2**63)) * 1024).cast("int"),
                   [F.col("_h"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    names = list(PIECES)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, bin_, offset = sent.value
        key = length * 2**48 + first
        for part in parts:
            rank = part["_rank"].to_numpy()
            at = np.searchsorted(key, part["length"].to_numpy() * 2**48 + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in names), pa.array(bin_[at] + rank - first[at]), pa.array(offset[at])],
                [*names, "sequence_id", "offset"])

    return items.select(*names, "_rank").mapInArrow(place, f"{SCHEMA}, sequence_id long, offset long")
