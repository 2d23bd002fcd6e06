"""Incremental line deduplication: exact reference counts behind sharded cuckoo filters."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, remove, small_batches, text_key
from .cuckoo import CuckooFilter, build

COUNTS = "k1 long, k2 long, n long"
#: Frequent keys whose filters (2.4 bytes a key) go out to all tasks.
FILTER_KEYS = 1_000_000


def line_keys(text: bytes, least: int = 1) -> list[bytes | None]:
    """A 128-bit digest for each line; None for keys of fewer than ``least`` code points.

    Only ASCII white space is stripped and only A-Z lower-cased, as bytes methods do.
    """
    keys = [line.strip() for line in text.lower().split(b"\n")]
    short = (lambda k: len(k) < least) if least <= 1 else (lambda k: len(k.decode()) < least)
    return [None if short(k) else xxhash.xxh3_128_digest(k) for k in keys]


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def count_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """(k1, k2, n): in how many documents each line key stands.

    A task counts its documents first and flushes when it holds 200,000 keys, so a line
    that a third of all documents share reaches the shuffle a few times per task.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            k1, k2 = _longs(list(held))
            out = pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(list(held.values()), pa.int64())], ["k1", "k2", "n"])
            held.clear()
            return out

        for part in parts:
            for text in part["text"]:
                own = set(line_keys((text.as_py() or "").encode(), least))
                own.discard(None)
                held.update(own)
                if len(held) >= 200_000:
                    yield flush()
        if held:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(count, COUNTS).groupBy("k1", "k2").agg(F.sum("n").alias("n"))


class LineIndex:
    """Line counts as exact tables; which keys are frequent, as a cuckoo filter per shard.

    ``insert`` and ``delete`` add and subtract the counts of a batch of documents; a key
    whose count reaches 0 leaves the table, so a deletion undoes an insertion exactly.
    Keys that pass or fall below ``min_docs`` enter or leave the filter of their shard.
    The filters answer for every line; the exact table confirms them beforehand: the keys
    that are not frequent, about 1 in 8000 of which a filter takes for a member, are asked
    once each, and those so mistaken are the filters' ``exceptions``.
    """

    def __init__(self, counts: DataFrame, min_docs: int = 10, least: int = 1, shard_keys: int = 50_000):
        self.counts, self.min_docs, self.least, self.shard_keys = counts, min_docs, least, shard_keys
        self.frequent = counts.where(F.col("n") >= min_docs).select("k1", "k2")
        self.n_frequent = self.frequent.count()
        self.shards = max(1, -(-self.n_frequent // shard_keys))
        self._filters: DataFrame | None = None

    @classmethod
    def create(cls, docs: DataFrame, min_docs: int = 10, least: int = 1, **more) -> LineIndex:
        return cls(materialize(count_lines(docs, least), "line-counts"), min_docs, least, **more)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        change = count_lines(docs, self.least).withColumn("n", F.col("n") * sign)
        merged = (self.counts.unionByName(change).groupBy("k1", "k2").agg(F.sum("n").alias("n")).where(F.col("n") > 0))
        after = LineIndex(materialize(merged, "line-counts"), self.min_docs, self.least, self.shard_keys)
        if after.shards == self.shards:
            after._filters = materialize(self._updated(after), "line-filters")
        return after

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take documents out again; they must have been inserted."""
        return self._changed(docs, -1)

    def _updated(self, after: LineIndex) -> DataFrame:
        """This index's filters with the keys that changed sides inserted or deleted."""
        enter = after.frequent.join(self.frequent, ["k1", "k2"], "left_anti").withColumn("enters", F.lit(True))
        leave = self.frequent.join(after.frequent, ["k1", "k2"], "left_anti").withColumn("enters", F.lit(False))
        shard = F.pmod(F.col("k1"), F.lit(self.shards)).cast("int").alias("shard")
        moved = enter.unionByName(leave).select(shard, "k1", "k2", "enters")

        def update(key, olds, moves):
            moves = moves.sort_values(["k1", "k2"])
            made = CuckooFilter.from_bytes(olds["data"].iloc[0]) if len(olds) else build(*np.empty((2, 0), np.int64))
            gone, new = moves[~moves["enters"]], moves[moves["enters"]]
            made.delete(gone["k1"].to_numpy(), gone["k2"].to_numpy())
            try:
                made.insert(new["k1"].to_numpy(), new["k2"].to_numpy())
            except OverflowError:
                return olds.assign(shard=key[0], data=b"")[["shard", "data"]].head(1)
            return pd.DataFrame({"shard": [key[0]], "data": [made.to_bytes()]})

        out = self.filters().groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(update, "shard int, data binary")
        full = [r["shard"] for r in out.where(F.length("data") == 0).select("shard").collect()]
        return after._built() if full else out

    def _built(self) -> DataFrame:
        shard = F.pmod(F.col("k1"), F.lit(self.shards)).cast("int").alias("shard")

        def make(pdf):
            pdf = pdf.sort_values(["k1", "k2"])
            data = build(pdf["k1"].to_numpy(), pdf["k2"].to_numpy()).to_bytes()
            return pdf.head(1).assign(data=data)[["shard", "data"]]

        return self.frequent.select(shard, "k1", "k2").groupBy("shard").applyInPandas(make, "shard int, data binary")

    def filters(self) -> DataFrame:
        """(shard, data): one filter per shard, each of about ``shard_keys`` keys."""
        if self._filters is None:
            self._filters = materialize(self._built(), "line-filters")
        return self._filters

    def exceptions(self, docs: DataFrame | None = None) -> DataFrame:
        """(k1, k2): keys that are not frequent though a filter says so, of the index or else of ``docs``."""
        shards = self.shards
        shard = F.pmod(F.col("k1"), F.lit(shards)).cast("int").alias("shard")
        if docs is None:
            rest = self.counts.where(F.col("n") < self.min_docs).select("k1", "k2")
        else:
            rest = count_lines(docs, self.least).select("k1", "k2").join(self.frequent, ["k1", "k2"], "left_anti")
        if self.n_frequent <= FILTER_KEYS:
            sent = self.counts.sparkSession.sparkContext.broadcast(self._collected())

            def mistaken(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = unpacked(sent.value)
                for part in parts:
                    k1, k2 = part["k1"].to_numpy(), part["k2"].to_numpy()
                    yield part.filter(pa.array(probe(filters, shards, k1, k2)))

            found = rest.mapInArrow(mistaken, "k1 long, k2 long")
        else:
            # more filters than a task should hold: each meets the keys of its shard in pieces
            pieces = max(1, -(-rest.count() // (shards * 200_000)))
            dealt = rest.select(shard, F.pmod(F.col("k2"), F.lit(pieces)).alias("piece"), "k1", "k2")
            sides = self.filters().select("shard", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("piece"))

            def mistaken_here(key: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
                if not len(filters):
                    return keys.head(0)[["k1", "k2"]]
                held = CuckooFilter.from_bytes(filters["data"].iloc[0])
                return keys[held.contains(keys["k1"].to_numpy().view(np.uint64), keys["k2"].to_numpy().view(np.uint64))][["k1", "k2"]]

            found = dealt.groupBy("shard", "piece").cogroup(sides.groupBy("shard", "piece")).applyInPandas(mistaken_here, "k1 long, k2 long")
        return materialize(found, "line-exceptions")

    def _collected(self) -> dict[int, bytes]:
        return {r["shard"]: bytes(r["data"]) for r in self.filters().collect()}

    def clean(self, docs: DataFrame, broadcast_keys: int = FILTER_KEYS, indexed: bool = False) -> DataFrame:
        """docs with text_kept, n_lines and n_dropped: lines with frequent keys are gone.

        Up to ``broadcast_keys`` frequent keys (2.4 bytes each as filters) and as many
        exceptions (16 bytes each) go out to all tasks, and each document is cleaned where
        it lies, by filters less exceptions.  Beyond that the lines' keys are joined with the
        exact table, and verdicts come back by the text's key.  ``indexed`` says that all
        of docs are in the index, so that its own keys are the only ones to confirm.
        """
        docs = docs.drop("text_kept", "n_lines", "n_dropped", "_gone", "_t1", "_t2")
        if self.n_frequent <= broadcast_keys:
            wrong = self.exceptions(None if indexed else docs)
            if wrong.count() <= broadcast_keys:
                return self._clean_here(docs, wrong.toArrow())
        return self._clean_joined(docs)

    def _clean_here(self, docs: DataFrame, wrong: pa.Table) -> DataFrame:
        order = np.argsort(wrong["k1"].to_numpy())
        sent = docs.sparkSession.sparkContext.broadcast((self._collected(), wrong["k1"].to_numpy()[order], wrong["k2"].to_numpy()[order]))
        shards, least = self.shards, self.least

        def judge(text: bytes, known: dict) -> list[bool]:
            if not known:
                data, k1, k2 = sent.value
                known.update(filters=unpacked(data), wrong={(a, b) for a, b in zip(k1.tolist(), k2.tolist(), strict=True)})
            keys = line_keys(text, least)
            at = [i for i, k in enumerate(keys) if k is not None]
            bad = [False] * len(keys)
            if at and known["filters"]:
                k1, k2 = _longs([keys[i] for i in at])
                for i in np.flatnonzero(probe(known["filters"], shards, k1, k2)):
                    bad[at[i]] = (int(k1[i]), int(k2[i])) not in known["wrong"]
            return bad

        return _with_lines(docs, judge)

    def _clean_joined(self, docs: DataFrame) -> DataFrame:
        least = self.least
        keyed = docs.select("*", *text_key(F.col("text")))

        def explode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for a, b, text in zip(part["_t1"].to_pylist(), part["_t2"].to_pylist(), part["text"].to_pylist(), strict=True):
                    keys = [(i, k) for i, k in enumerate(line_keys((text or "").encode(), least)) if k is not None]
                    if keys:
                        k1, k2 = _longs([k for _, k in keys])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([a] * len(keys)), pa.array([b] * len(keys)), pa.array([i for i, _ in keys]), pa.array(k1), pa.array(k2)],
                            ["_t1", "_t2", "line", "k1", "k2"])

        lines = keyed.select("_t1", "_t2", "text").mapInArrow(explode, "_t1 long, _t2 long, line long, k1 long, k2 long")
        verdicts = (lines.join(self.frequent, ["k1", "k2"]).groupBy("_t1", "_t2")
                    .agg(F.collect_set("line").alias("_gone")))
        joined = keyed.join(verdicts, ["_t1", "_t2"], "left").drop("_t1", "_t2")
        return _with_lines(joined, None)


def probe(filters: dict[int, CuckooFilter], shards: int, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """What the shards' filters say of each key."""
    out = np.zeros(len(k1), dtype=bool)
    for shard, held in filters.items():
        own = np.flatnonzero(k1 % shards == shard) if shards > 1 else np.arange(len(k1))
        out[own] = held.contains(k1[own].view(np.uint64), k2[own].view(np.uint64))
    return out


def unpacked(data: dict[int, bytes]) -> dict[int, CuckooFilter]:
    return {shard: CuckooFilter.from_bytes(x) for shard, x in data.items()}


def _with_lines(docs: DataFrame, judge) -> DataFrame:
    """Drop the lines that ``judge`` names, or those in the column _gone where it is None."""
    columns = [c for c in docs.columns if c != "_gone"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_gone")

    def drop(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for part in parts:
            gone = part["_gone"].to_pylist() if judge is None else [None] * part.num_rows
            kept, lines, dropped = [], [], []
            for text, lost in zip(part["text"].to_pylist(), gone, strict=True):
                data = (text or "").encode()
                split = data.split(b"\n")
                bad = judge(data, known) if judge else [i in lost for i in range(len(split))] if lost else [False] * len(split)
                rest = b"\n".join(x for x, b in zip(split, bad, strict=True) if not b)
                kept.append(rest.decode())
                lines.append(len(split))
                dropped.append(sum(bad))
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in columns), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                [*columns, "text_kept", "n_lines", "n_dropped"])

    return docs.mapInArrow(drop, f"{schema}, text_kept string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, batches: int = 2) -> DataFrame:
    """Every document without the lines whose keys stand in ``min_docs`` documents or more.

    The index takes the documents in ``batches``, told apart by their texts: the first
    builds it, the others are inserted.  A line's key is the line without ASCII white space
    at its ends and with A-Z lower-cased; keys of fewer than ``least`` code points are never
    dropped.  A document counts once for a key however often the line repeats in it.  A
    null or empty text is one empty line.  Repeated rows, also of one doc_id, count as
    documents of their own.  An empty table gives no rows.  Other columns pass through,
    except that columns named as the results (text_kept, n_lines, n_dropped) give way to them.
    """
    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(batches))
    index = LineIndex.create(docs.where(part == 0), min_docs, least)
    for b in range(1, batches):
        before, index = index, index.insert(docs.where(part == b))
        remove(before.counts)
    return index.clean(docs, indexed=True)
