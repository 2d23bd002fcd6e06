"""Long repeated passages by a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, RollingHash, batches, materialize, mix, release, remove, small_batches, text_key

#: Bytes of a window of which one suffix is sampled, of the gram that ranks it, and of a block of offsets.
WINDOW, GRAM, BLOCK = 256, 8, 16
CHUNK = 1 << 18
_HASH = RollingHash(77)


def suffix_runs(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Columns text, lo, a, hi, k, f of the sampled suffixes of each text.

    For every start p of a string of ``width`` bytes, the sampled suffix is the one in
    [p, p + WINDOW) whose first bytes hash lowest (the leftmost of equals).  The string's
    own bytes alone decide which, so equal strings sample suffixes at equal offsets.  All
    starts lo..hi that sample suffix a form one run.  k is the fingerprint of the suffix's
    first width - WINDOW bytes, which all strings of the run contain; f is that of all
    bytes of the run's strings.
    """
    out = [_runs(texts[lo:hi], lo, width) for lo, hi in batches(texts, CHUNK)]
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 6


def _runs(texts: list[bytes], base: int, width: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - width + 1, 0)
    if not windows.any():
        return tuple(np.empty(0, np.int64) for _ in range(6))
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    prefix = _HASH.prefix(buf)
    at = np.arange(len(buf) - GRAM + 1)
    low = (mix(_HASH.ranges(prefix, at, at + GRAM)) & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    step = 1
    while step < WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    text = np.repeat(np.arange(len(texts)), windows)
    p = np.arange(windows.sum()) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    a = (low[p] & U64(0xFFFFFFFF)).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    end = np.append(start[1:], len(a)) - 1
    lo, hi, a, text = p[start], p[end], a[start], text[start]
    k = mix(_HASH.ranges(prefix, a, a + width - WINDOW))
    f = mix(_HASH.ranges(prefix, lo, hi + width) + mix((a - lo).astype(U64) * U64(1 << 20) + (hi - lo).astype(U64)))
    shift = first[text]
    return text + base, lo - shift, a - shift, hi - shift, k.view(np.int64), f.view(np.int64)


def _sampled(docs: DataFrame, width: int) -> DataFrame:
    """The runs of each distinct text, with the number of rows that have it.

    Rows with equal texts are summed up before runs are dealt by k, so copies make no hot k.
    """
    def sample(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in parts:
            text, lo, a, hi, k, f = suffix_runs([(t or "").encode() for t in part["text"].to_pylist()], width)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [part["_t1"].take(rows), part["_t2"].take(rows), *(pa.array(x.astype(np.int32)) for x in (lo, a, hi)), pa.array(k), pa.array(f)],
                ["_t1", "_t2", "lo", "a", "hi", "k", "f"])

    runs = docs.select("_t1", "_t2", "text").mapInArrow(sample, "_t1 long, _t2 long, lo int, a int, hi int, k long, f long")
    return runs.groupBy(*runs.columns).agg(F.count(F.lit(1)).alias("n"))


class SuffixIndex:
    """A family of levels, each a table of suffix fingerprints in order with their counts.

    ``add`` sorts a batch's sampled suffixes, merge-joins them with every level (both sides
    sorted by fingerprint) and so finds what the batch repeats of itself or of any earlier
    batch.  Then the batch becomes a level; two levels of one size class merge into the
    next, so n batches leave at most log2(n) + 1 levels and each entry is rewritten as
    often at most.
    """

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Fingerprints k, each n times in the batch, that occur a second time with this batch."""
        new = materialize(suffixes.groupBy("k").agg(F.sum("n").alias("n")).sortWithinPartitions("k"), "suffix-level")
        repeated = new.where("n > 1").select("k")
        for level in self.levels.values():
            repeated = repeated.unionByName(new.hint("merge").join(level.select("k"), "k").select("k"))
        repeated = materialize(repeated.distinct(), "suffix-matches")
        size = 0
        while size in self.levels:
            old = self.levels.pop(size)
            merged = materialize(new.unionByName(old).groupBy("k").agg(F.sum("n").alias("n")).sortWithinPartitions("k"), "suffix-level")
            remove(old)
            remove(new)
            new, size = merged, size + 1
        self.levels[size] = new
        return repeated

    def drop(self) -> None:
        for level in self.levels.values():
            remove(level)
        self.levels = {}


def _at_texts(docs: DataFrame, small: DataFrame, how: str, bound: int) -> DataFrame:
    """docs joined with a table that has one row per text key and an array column ``own``.

    Up to ``bound`` array items (some tens of bytes each) the table is broadcast; beyond
    that, texts are shuffled by their key.
    """
    held = small.agg(F.coalesce(F.sum(F.size("own")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    return docs.join(F.broadcast(small) if held <= bound else small, ["_t1", "_t2"], how)


def _contexts(docs: DataFrame, reps: DataFrame, width: int, bound: int) -> DataFrame:
    """(k, f, most, least, bytes), a table: one run's bytes for each fingerprint pair of ``reps``."""
    own = materialize(reps.groupBy("_t1", "_t2").agg(F.collect_list(F.struct("k", "f", "lo", "a", "hi")).alias("own")), "suffix-reps")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text, own in zip(part["text"].to_pylist(), part["own"].to_pylist(), strict=True):
                data = text.encode()
                rows += [(r["k"], r["f"], r["a"] - r["lo"], r["a"] - r["hi"], data[r["lo"] : r["hi"] + width]) for r in own]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["k", "f", "most", "least", "bytes"])

    found = _at_texts(docs, own, "inner", bound)
    cuts = found.select("text", "own").mapInArrow(cut, "k long, f long, most int, least int, bytes binary")
    contexts = materialize(cuts.groupBy("k", "f").agg(*(F.first(c).alias(c) for c in ("most", "least", "bytes"))), "suffix-contexts")
    remove(own)
    return contexts


def _hashes(contexts: DataFrame, width: int, blocks: bool) -> DataFrame:
    """Fingerprints of blocks of offsets of each context, or of the offsets of its open blocks.

    The string at offset d starts d bytes before the suffix.  A block's core is what all
    its strings have in common, its hull what they cover together.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data = part["bytes"].to_pylist()
            most, least = (part[c].to_numpy().astype(np.int64) for c in ("most", "least"))
            prefix = _HASH.prefix(np.frombuffer(b"".join(data), dtype=np.uint8))
            sizes = np.array([len(x) for x in data], dtype=np.int64)
            a = np.cumsum(sizes) - sizes + most
            if blocks:
                lo, n = least // BLOCK, most // BLOCK - least // BLOCK + 1
            else:
                lo = np.maximum(part["block"].to_numpy().astype(np.int64) * BLOCK, least)
                n = np.minimum(part["block"].to_numpy().astype(np.int64) * BLOCK + BLOCK - 1, most) - lo + 1
            row = np.repeat(np.arange(len(data)), n)
            d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
            if blocks:
                d1, d2 = np.maximum(d * BLOCK, least[row]), np.minimum(d * BLOCK + BLOCK - 1, most[row])
                core = mix(_HASH.ranges(prefix, a[row] - d * BLOCK, a[row] + width - d * BLOCK - BLOCK + 1) + d.astype(U64))
                hull = mix(_HASH.ranges(prefix, a[row] - d2, a[row] + width - d1) + mix((d1 * 1024 + d2).astype(U64)))
            else:
                d1 = d2 = d
                core = hull = mix(_HASH.ranges(prefix, a[row] - d, a[row] + width - d) + d.astype(U64))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part["k"].take(take), part["f"].take(take), pa.array((d if blocks else d // BLOCK).astype(np.int32)), pa.array(d1.astype(np.int32)),
                 pa.array(d2.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))],
                ["k", "f", "block", "d1", "d2", "core", "hull"])

    return contexts.mapInArrow(run, "k long, f long, block int, d1 int, d2 int, core long, hull long")


def _united(spans: DataFrame) -> DataFrame:
    """The spans of each text with those that touch or overlap made one."""
    before = Window.partitionBy("_t1", "_t2").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    runs = spans.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("_t1", "_t2", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def repeated_spans(docs: DataFrame, width: int = 400, families: int = 4, bound: int = 2_000_000) -> DataFrame:
    """(_t1, _t2, own): per text, by its key, the maximal byte ranges [start, end) that repeated strings cover.

    docs has text, _t1 and _t2.  Exact in four steps that narrow down what is compared:
    sampled suffixes that the index finds repeated; runs that occur twice as a whole; blocks
    of offsets of the others; single strings of blocks that are neither unique nor repeated
    as a whole.  A string with many copies costs one entry per text and aggregate.
    """
    runs = materialize(_sampled(docs, width), "suffixes")
    index, repeated = SuffixIndex(), None
    for b in range(families):
        found = index.add(runs.where(F.pmod("_t1", F.lit(families)) == b).select("k", "n"))
        repeated = found if repeated is None else repeated.unionByName(found)
    index.drop()
    found, repeated = repeated, materialize(repeated.distinct(), "suffix-repeated")
    remove(found)
    own = materialize(runs.join(repeated, "k"), "suffix-own")  # nothing above the join, so that a skewed k can be split
    for used in (runs, repeated):
        remove(used)
    kinds = materialize(own.groupBy("k", "f").agg(F.sum("n").alias("n"), F.min(F.struct("_t1", "_t2", "lo", "a", "hi")).alias("rep")), "suffix-kinds")
    open_ = materialize(
        kinds.groupBy("k").agg(F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("single"))
        .where("kinds > 1 AND single > 0").select("k"), "suffix-open")
    contexts = _contexts(docs, kinds.join(open_, "k").select("k", "f", "rep.*"), width, bound)
    remove(open_)
    single = kinds.where("n = 1").select("k", "f")

    def split(hashes: DataFrame, name: str) -> DataFrame:
        """Rows whose core several runs share, a table, with how many share the hull, how many
        hulls of the core stand alone, and whether the row speaks for its hull."""
        rows = materialize(hashes, name)
        hulls = materialize(rows.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("hulls"), F.min(F.struct("k", "f")).alias("first")), name)
        cores = materialize(hulls.groupBy("core").agg(F.sum("hulls").alias("cores"), F.count(F.when(F.col("hulls") == 1, 1)).alias("alone"))
                            .where("cores > 1"), name)
        many = materialize(hulls.join(cores, "core"), name)
        for used in (hulls, cores):
            remove(used)
        told = materialize(rows.join(many, ["core", "hull"]).select(
            "k", "f", "block", "d1", "d2", "hulls", "alone", (F.struct("k", "f") == F.col("first")).alias("speaks")), name)
        for used in (rows, many):
            remove(used)
        return told

    blocks = split(_hashes(contexts, width, True), "suffix-blocks")
    # a hull that several runs share is settled, but offers its strings to those that stand alone
    asked = blocks.where("alone > 0 AND speaks").select("k", "f", "block")
    strings = split(_hashes(contexts.join(asked, ["k", "f"]), width, False), "suffix-strings")
    remove(contexts)
    part = (blocks.where("hulls > 1").select("k", "f", "d1", "d2").unionByName(strings.where("hulls > 1").select("k", "f", "d1", "d2"))
            .join(single, ["k", "f"]))
    verdicts = materialize(kinds.where("n > 1").select("k", "f", F.lit(None).cast("int").alias("d1"), F.lit(None).cast("int").alias("d2"))
                           .unionByName(part), "suffix-verdicts")
    for used in (kinds, blocks, strings):
        remove(used)
    spans = own.join(verdicts, ["k", "f"]).select(
        "_t1", "_t2",
        F.when(F.col("d1").isNull(), F.col("lo")).otherwise(F.col("a") - F.col("d2")).alias("start"),
        (F.when(F.col("d1").isNull(), F.col("hi")).otherwise(F.col("a") - F.col("d1")) + width).alias("end"))
    united = materialize(_united(spans).groupBy("_t1", "_t2").agg(F.collect_list(F.struct("start", "end")).alias("own")), "suffix-spans")
    for used in (own, verdicts):
        remove(used)
    return united


def dedup_passages(docs: DataFrame, width: int = 400, families: int = 4, bound: int = 2_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept bytes of every document.

    A byte goes if some string of ``width`` bytes that covers it starts anywhere else too,
    in the same or another document (overlaps count; strings never cross documents and are
    judged on the input).  A text with an equal copy of ``width`` bytes or more so loses
    everything.  Null text: no bytes.  Texts shorter than ``width`` lose nothing.  Each row is
    a document, also rows of one doc_id or without any.  Empty table: no rows.  Columns
    other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", *text_key(F.col("text")))
    joined = _at_texts(keyed, repeated_spans(keyed.drop("doc_id"), width, families, bound), "left", bound)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, removed, spans, kept = [], [], [], []
            for text, own in zip(part["text"].to_pylist(), part["own"].to_pylist(), strict=True):
                data, runs = (text or "").encode(), []
                for start, end in sorted((r["start"], r["end"]) for r in own or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(end, runs[-1][1])
                    else:
                        runs.append([start, end])
                edges = [0, *(x for r in runs for x in r), len(data)]
                sizes.append(len(data))
                removed.append(sum(e - s for s, e in runs))
                spans.append(runs)
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                 pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "own").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<array<bigint>>, kept binary")
