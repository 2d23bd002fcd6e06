"""Long signals in blocks: moments, filters, resampling and beats without a row or a task that holds a record.

Blocks are rows (record, lead, idx, fs, n, block, start, samples) of ``block`` samples of a channel from ``start``
on (a multiple of ``block``), the last of a channel's n samples shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import tables, windows

KEY = ["record", "lead", "idx"]
FACTS = ["fs", "n", "block"]


def moments(blocks: DataFrame) -> DataFrame:
    """(record, lead, idx, mean, sd) of each channel: means first, then squares about them; missing samples take no part."""
    total = lambda f: F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.coalesce(f(x), F.lit(0.0)))
    there = F.size(F.filter("samples", lambda x: x.isNotNull()))
    mean = blocks.groupBy(*KEY).agg(F.try_divide(F.sum(total(lambda x: x)), F.sum(there)).alias("mean"))
    about = blocks.join(mean, KEY).select(*KEY, "mean", there.alias("k"), total(lambda x: x - F.col("mean")).alias("off"), total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))).alias("sq"))
    sums = about.groupBy(*KEY, "mean").agg(F.sum("k").alias("k"), F.sum("off").alias("off"), F.sum("sq").alias("sq"))
    off = F.try_divide("off", "k")
    return sums.select(*KEY, (F.col("mean") + off).alias("mean"), F.sqrt(F.greatest(F.try_divide("sq", "k") - off * off, F.lit(0.0))).alias("sd"))


def scaled(blocks: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Samples less their channel's mean over its standard deviation."""
    return blocks.join(moments(blocks), KEY).withColumn("samples", F.transform("samples", lambda x: (x - F.col("mean")) / (F.col("sd") + eps))).drop("mean", "sd")


def with_halo(blocks: DataFrame, before: int | Column, after: int | Column) -> DataFrame:
    """Blocks with the ``before`` samples before them and the ``after`` samples after them, as far as the channel goes; ``lo`` is
    where samples now begin.

    Each block sends a copy of what they need to the blocks around it, and those put their pieces
    together: rows meet by block, never by record.
    """
    b, start = F.col("block"), F.col("start")
    end = start + F.size("samples")
    number, last = F.floor(start / b), F.floor((F.col("n") - 1) / b)
    to = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((start - after) / b)), F.least(last, F.floor((end - 1 + before) / b)))).alias("_to")
    sent = blocks.select(*KEY, *FACTS, "start", "samples", to)
    lo = F.greatest("start", F.col("_to") * b - before)
    hi = F.least(end, (F.col("_to") + 1) * b + after)
    piece = F.struct(lo.alias("lo"), F.slice("samples", (lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    met = sent.where(hi > lo).select(*KEY, *FACTS, "_to", piece.alias("_p")).groupBy(*KEY, *FACTS, "_to").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return met.select(*KEY, *FACTS, (F.col("_to") * b).alias("start"), F.col("_p")[0]["lo"].alias("lo"), F.flatten(F.transform("_p", lambda p: p["x"])).alias("samples"))


def reblocked(pieces: DataFrame) -> DataFrame:
    """Blocks of rows whose samples, of any number, cover each channel without overlap from ``start`` on."""
    start, block = F.col("start"), F.col("block")
    end = start + F.size("samples")
    to = F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))).alias("_to")
    lo, hi = F.greatest("start", F.col("_to") * block), F.least(end, (F.col("_to") + 1) * block)
    piece = F.struct(lo.alias("lo"), F.slice("samples", (lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    dealt = pieces.where(F.size("samples") > 0).select(*KEY, *FACTS, "start", "samples", to).select(*KEY, *FACTS, "_to", piece.alias("_p"))
    met = dealt.groupBy(*KEY, *FACTS, "_to").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return met.select(*KEY, *FACTS, (F.col("_to") * block).alias("start"), F.flatten(F.transform("_p", lambda p: p["x"])).alias("samples"))


def settled(fs: float, low: float, high: float, order: int, tol: float) -> int:
    """Samples after which what came before has less than ``tol`` of its weight in a filter's answer: from its slowest pole."""
    radius = max(np.abs(np.roots([1.0, s[3], s[4]])).max() for s in K.butterworth(order, low, high, fs))
    return int(np.ceil(1.5 * np.log(tol) / np.log(radius)))


def bandpassed(blocks: DataFrame, fs: float, low: float = 0.5, high: float = 40.0, order: int = 4, tol: float = 1e-12) -> DataFrame:
    """Zero-phase band-pass of channels at a common rate, forward and backward over each block and a halo in which starts settle.

    Equals the filter over the whole channel up to ``tol``.  Channels must have no missing samples.
    """
    halo = settled(fs, low, high, order, tol)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*KEY, *FACTS, "start", "samples").schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = part["samples"].value_lengths().to_numpy(zero_copy_only=False)
            x, at = part["samples"].flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            skip = part["start"].to_numpy() - part["lo"].to_numpy()
            keep = np.minimum(part["block"].to_numpy(), part["n"].to_numpy() - part["start"].to_numpy())
            out: list[np.ndarray] = [np.empty(0)] * part.num_rows
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                y = K.bandpass(x[at[rows][:, None] + np.arange(n)], fs, low, high, order)
                for r, v in zip(rows, y, strict=True):
                    out[r] = v[skip[r] : skip[r] + keep[r]]
            ends = np.cumsum([0, *map(len, out)])
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0)))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in (*KEY, *FACTS, "start")), made], [*KEY, *FACTS, "start", "samples"])

    return with_halo(blocks, halo, halo).mapInArrow(run, schema)


def resampled(blocks: DataFrame, rate: int = 360) -> DataFrame:
    """Blocks at a common rate: each block's share of the polyphase filter's output from its samples and a halo, dealt into blocks anew.

    Equals the filter over the whole channel.  Rates are whole numbers; a channel at the rate stays as it is.
    """
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*KEY).schema), "fs double, n long, block long, start long, samples array<double>"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.to_pydict()
            made = []
            for fs, n, block, start, lo, x in zip(*(rows[c] for c in ("fs", "n", "block", "start", "lo", "samples")), strict=True):
                if fs == rate:
                    made.append((fs, n, block, start, np.array(x[start - lo : start - lo + min(block, n - start)], float)))
                    continue
                up, down = K.ratio(rate, int(fs))
                first, end = -(-start * up // down), -(-min(start + block, n) * up // down)
                made.append((float(rate), -(-n * up // down), block, first, K.resample_span(np.array(x, float), lo, n, up, down, first, end)))
            fs, n, block, start, x = (list(v) for v in zip(*made, strict=True)) if made else ([], [], [], [], [])
            ends = np.cumsum([0, *map(len, x)])
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in KEY), pa.array(fs, pa.float64()), pa.array(n, pa.int64()), pa.array(block, pa.int64()), pa.array(start, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0)))], [*KEY, *FACTS, "start", "samples"])

    # the filter reaches 10 * max(1, fs / rate) samples to either side
    halo = (F.floor(10 * F.greatest(F.lit(1.0), F.col("fs") / rate)) + 2).cast("long")
    return reblocked(with_halo(blocks, halo, halo).mapInArrow(run, schema))


def moved(annotations: DataFrame, blocks: DataFrame, rate: int = 360) -> DataFrame:
    """Annotations (record, sample, symbol) at the common rate, rounded with halves to even."""
    rates = blocks.where("start = 0").groupBy("record").agg(F.first("fs").alias("_fs"))  # leads of a record share it
    return annotations.join(rates, "record").withColumn("sample", F.bround(F.col("sample") * F.lit(float(rate)) / F.col("_fs")).cast("long")).drop("_fs")


def beats(blocks: DataFrame, annotations: DataFrame, symbols: dict[str, str], before: int = 90, after: int = 162, firsts: DataFrame | None = None) -> DataFrame:
    """Labelled beats with intervals and z-scored segments per lead, as ``wfdb.beats`` gives them of whole records.

    Symbols are filtered before intervals are taken and edges after it.  A beat is cut from
    the block that its sample lies in and the halo around it.  ``firsts``: the channels' first
    blocks, where they can be read alone.
    """
    marked = windows.intervals(tables.map_symbols(annotations, symbols), "record", ["sample"], "sample")
    wide = with_halo(scaled(blocks), before, after)
    facts = (blocks if firsts is None else firsts).where("start = 0").select(*KEY, F.col("n").alias("_n"), F.col("block").alias("_b"), F.col("fs").alias("_fs"))
    placed = marked.join(facts, "record").where((F.col("sample") >= before) & (F.col("sample") + after <= F.col("_n")))
    placed = placed.withColumn("start", F.floor(F.col("sample") / F.col("_b")) * F.col("_b"))
    cut = F.slice("samples", (F.col("sample") - before - F.col("lo") + 1).cast("int"), before + after)
    return placed.join(wide.drop("fs"), [*KEY, "start"]).select(
        "record", "sample", "pos", "label", (F.col("rr_pre") / F.col("_fs")).alias("rr_pre"), (F.col("rr_post") / F.col("_fs")).alias("rr_post"), "lead", "idx", F.col("_fs").alias("fs"),
        cut.alias("segment"))
