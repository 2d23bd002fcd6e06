"""Per-event feature families and the assembled feature table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kernels as K
from . import windows

PREFIXES = {"td_": "time", "fd_": "freq", "mp_": "morph", "wv_": "wavelet", "hrv_": "hrv", "gr_": "graph"}


#: Beats of a record that meet in a task, besides those that their frames reach.
BLOCK = 2048


def time_features(df: DataFrame, segment: str) -> DataFrame:
    """Mean, population sd, skewness, excess kurtosis, rms and zero crossings of an array column.

    A constant segment has no skewness and no kurtosis, an empty or null one has no features: null.
    """
    moments = A.let(A.doubles(segment), lambda a: A.let(A.mean(a), lambda m: F.struct(
        m.alias("m"), A.central(a, m, 2).alias("m2"), A.central(a, m, 3).alias("m3"), A.central(a, m, 4).alias("m4"), A.rms(a).alias("rms"), A.zero_crossings(a).alias("zcr"))))
    m2 = F.col("_t.m2")
    return df.withColumn("_t", moments).withColumns({
        "td_mean": F.col("_t.m"),
        "td_std": F.sqrt(m2),
        "td_skew": F.try_divide(F.col("_t.m3"), m2 * F.sqrt(m2)),
        "td_kurt": F.try_divide(F.col("_t.m4"), m2 * m2) - 3.0,
        "td_rms": F.col("_t.rms"),
        "td_zcr": F.col("_t.zcr"),
    }).drop("_t")


def descriptor(df: DataFrame, segment: str, name: str = "descriptor", keep: bool = False) -> DataFrame:
    """sd, rms, skewness, excess kurtosis and largest absolute value as an array of five; ``keep`` leaves the time features."""
    out = time_features(df, segment).withColumn(name, F.array("td_std", "td_rms", "td_skew", "td_kurt", A.max_abs(A.doubles(segment))))
    return out if keep else out.drop("td_mean", "td_std", "td_skew", "td_kurt", "td_rms", "td_zcr")


def kernel_features(df: DataFrame, segment: str, fs: float, families: tuple[str, ...] = ("freq", "morph", "wavelet"), filtered: bool = True) -> DataFrame:
    """Spectral, morphological and wavelet features of segments, by batches of rows of one length.

    A segment that is null, holds a null or has fewer than two samples has none: null.
    """
    names = _names(families)

    def features_of(x: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        if "freq" in families:
            shares, entropy = K.band_shares(x, fs)
            out |= {f"fd_{k}": v for k, v in shares.items()} | {"fd_entropy": entropy}
        if "morph" in families:
            out |= {f"mp_{k}": v for k, v in K.morphology(K.bandpass(x, fs) if filtered else x, fs).items()}
        if "wavelet" in families:
            out |= {f"wv_{k}": v for k, v in K.wavelet_energies(x).items()}
        return out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part[segment]
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            held = np.zeros(0) if lists.null_count == len(lists) else lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            out, there = np.zeros((len(names), part.num_rows)), np.zeros(part.num_rows, bool)
            for n in np.unique(sizes[sizes > 1]).tolist():
                rows = np.flatnonzero(sizes == n)
                x = held[starts[rows][:, None] + np.arange(n)]
                whole = np.isfinite(x).all(axis=1)
                rows, x = rows[whole], x[whole]
                if len(rows):
                    found = features_of(x)
                    out[:, rows], there[rows] = np.stack([found[name] for name in names]), True
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, mask=~there) for v in out)], [*part.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, own + "".join(f", {n} double" for n in names))


def _names(families: tuple[str, ...]) -> list[str]:
    out = []
    if "freq" in families:
        out += [f"fd_{k}" for k in K.BANDS] + ["fd_entropy"]
    if "morph" in families:
        out += ["mp_r_amp", "mp_qrs_ms", "mp_energy_ratio"]
    if "wavelet" in families:
        out += ["wv_A4", "wv_D4", "wv_D3", "wv_D2", "wv_D1"]
    return out


def edges(df: DataFrame, record: str, order: list[str], values: str = "descriptor", width: int = 16, tau: float = 8.0) -> DataFrame:
    """(record, i, j, w) for beats less than ``width`` apart: max(0, cosine) * exp(-|i - j| / tau).

    A pair's weight does not depend on the frame it is seen in, so each is computed once
    and all frames share it: rows x (width - 1) edges, from one exchange by record.
    """
    w = windows.along(record, *order)
    rows = df.withColumn("j", F.row_number().over(w) - 1).withColumn("_past", F.collect_list(values).over(w.rowsBetween(-(width - 1), -1)))
    past = rows.select(record, "j", F.col(values).alias("_own"), F.posexplode("_past").alias("_p", "_other"), F.size("_past").alias("_n"))
    lag = F.col("_n") - F.col("_p")
    return past.select(record, (F.col("j") - lag).alias("i"), "j",
                       (F.greatest(F.lit(0.0), A.cosine(F.col("_own"), F.col("_other"))) * F.exp(-lag / tau)).alias("w"))


def graph_features(df: DataFrame, record: str, order: list[str], values: str = "descriptor", width: int = 16, tau: float = 8.0, causal: bool = True) -> DataFrame:
    """gr_wdegree, gr_clustering and gr_pagerank of each beat in the graph over its frame; 0 for frames of under three.

    A pair's weight does not depend on the frame it is seen in.  So each beat carries the
    weights to the beats before it that can share a frame with it, computed once, and a
    frame's graph is put together from its beats' own arrays, a block of beats at a time.  A beat without a whole
    descriptor (a constant segment has no skewness) is in the frames, but has no edges.
    """
    reach = width - 1 if causal else 2 * (width - 1)
    w = windows.along(record, *order)
    past = df.withColumn("_past", F.collect_list(values).over(w.rowsBetween(-reach, -1)))
    weight = lambda other, i: F.greatest(F.lit(0.0), A.cosine(F.col(values), other)) * F.exp((i - F.size("_past")) / tau)
    own = past.withColumn("_own", F.transform("_past", weight)).drop("_past")
    ahead = 0 if causal else width - 1
    # beats meet in blocks, each with the beats before and after it that its frames reach
    placed = own.withColumn("_pos", F.row_number().over(w) - 1)
    sent = placed.withColumn("_block", F.explode(F.sequence(F.floor(F.greatest(F.col("_pos") - ahead, F.lit(0)) / BLOCK), F.floor((F.col("_pos") + width - 1) / BLOCK))))
    columns, block = df.columns, BLOCK

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks().sort_by("_pos").combine_chunks()
        pos, beats = part["_pos"].to_numpy(), part["_own"].combine_chunks()
        home = np.flatnonzero(pos // block == part["_block"][0].as_py())
        first, last = np.maximum(home - (width - 1), 0), np.minimum(home + ahead, len(pos) - 1)
        out, sizes, at = np.zeros((len(home), 3)), last - first + 1, home - first
        for n in np.unique(sizes[sizes >= 3]).tolist():
            rows, some = np.flatnonzero(sizes == n), max(1, 16384 // n)
            for lo in range(0, len(rows), some):
                own = rows[lo : lo + some]
                graph = _graphs(beats.take(pa.array((first[own][:, None] + np.arange(n)).ravel())), n)
                rank, node = K.pagerank(graph), at[own]
                out[own, 0] = graph[np.arange(len(own)), node].sum(axis=1)
                out[own, 2] = rank[np.arange(len(own)), node]
                for k in np.unique(node):
                    same = node == k
                    out[own[same], 1] = K.clustering(graph[same], int(k))
        kept = part.select(columns).take(pa.array(home))
        for i, name in enumerate(("gr_wdegree", "gr_clustering", "gr_pagerank")):
            kept = kept.append_column(name, pa.array(out[:, i]))
        return kept

    own = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return sent.groupBy(record, "_block").applyInArrow(run, own + ", gr_wdegree double, gr_clustering double, gr_pagerank double")


def _graphs(beats: pa.Array, n: int) -> np.ndarray:
    """Symmetric weights (rows, n, n) of frames of n beats, one after the other; each beat has an array of its weights to those before it."""
    lengths = np.diff(beats.offsets.to_numpy())
    flat = beats.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    node = np.arange(len(lengths)) % n
    take = np.minimum(node, lengths)  # of a beat's weights those to beats of this frame: the last ones
    row = np.repeat(np.arange(len(lengths)), take)
    back = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)  # 0 is the beat just before
    w = np.zeros((len(lengths) // n, n, n))
    i, j = node[row], node[row] - 1 - back
    value = flat[ends[row] - 1 - back]
    w[row // n, i, j] = value
    w[row // n, j, i] = value
    return w


def without_frames(beats: DataFrame, segment: str, fs: float) -> DataFrame:
    """The families that look at a beat alone, and its descriptor."""
    return descriptor(kernel_features(beats, segment, fs), segment, keep=True)


def with_frames(base: DataFrame, record: str, order: list[str], segment: str, width: int = 16, tau: float = 8.0, causal: bool = True) -> DataFrame:
    """Rhythm and graph over a frame of beats, added to ``without_frames``."""
    out = windows.rhythm(base, record, order, width=width, causal=causal)
    out = out.withColumnsRenamed({c: f"hrv_{c}" for c in ("mean_rr", "sdnn", "rmssd", "pnn", "lfhf")}).drop("n_rr")
    return graph_features(out, record, order, width=width, tau=tau, causal=causal).drop("descriptor")


def feature_table(beats: DataFrame, record: str, order: list[str], segment: str, fs: float, width: int = 16, tau: float = 8.0, causal: bool = True) -> DataFrame:
    """All six families, a row per beat with its key; beats has rr_pre."""
    return with_frames(without_frames(beats, segment, fs), record, order, segment, width, tau, causal)


def feature_columns(df: DataFrame, keep: set[str] | None = None) -> list[str]:
    return [c for c in df.columns for p, f in PREFIXES.items() if c.startswith(p) and (keep is None or f in keep)]


def as_vector(columns: list[str]) -> Column:
    return F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in columns))


def medians_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values replaced by the column's exact median."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    facts = {r["c"]: r["q"][0] for r in windows.quantiles(cells, "c", "v", [0.5]).collect()}
    return df.fillna(facts)


def first_rows(df: DataFrame, record: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(record).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def resampled(signals: DataFrame, annotations: DataFrame, rate: int = 360) -> tuple[DataFrame, DataFrame]:
    """Signals (record, lead, idx, fs, samples) at a common rate, and annotations (record, sample, symbol) moved with them.

    Samples go through a polyphase filter, a lead at a time where it lies; an annotation's
    sample number is scaled and rounded (halves to even).  A record at the rate already is
    left as it is.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [K.resample(np.array(x, dtype=np.float64)[None, :], rate, int(fs))[0].tolist() if int(fs) != rate else x
                    for fs, x in zip(part["fs"].to_pylist(), part["samples"].to_pylist(), strict=True)]
            new = {"samples": pa.array(made, part["samples"].type), "fs": pa.array([rate] * part.num_rows, part["fs"].type)}
            yield pa.RecordBatch.from_arrays([new.get(c, part[c]) for c in part.schema.names], part.schema.names)

    rates = signals.groupBy("record").agg(F.first("fs").alias("_fs"))  # leads of a record share it
    moved = annotations.join(rates, "record").withColumn("sample", F.bround(F.col("sample") * F.lit(float(rate)) / F.col("_fs")).cast("long")).drop("_fs")
    return signals.mapInArrow(run, schema), moved
