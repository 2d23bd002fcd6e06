"""Tolerance joins and one-to-one matching of events in time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def band_join(ref: DataFrame, det: DataFrame, record: str, tol: float) -> DataFrame:
    """Pairs of a reference and a detection of one record at most ``tol`` apart.

    ref has (record, r_id, r_t), det (record, d_id, d_t).  Time is cut into bins as wide
    as the tolerance; each detection is looked for in its own bin and both neighbours, so
    the join is on (record, bin) and a busy record spreads over its bins.
    """
    bin_ = lambda t: F.floor(F.col(t) / tol)
    left = ref.withColumn("_bin", bin_("r_t"))
    right = det.withColumn("_bin", F.explode(F.array(bin_("d_t") - 1, bin_("d_t"), bin_("d_t") + 1)))
    gap = F.abs(F.col("r_t") - F.col("d_t"))
    return left.join(right, [record, "_bin"]).where(gap <= tol).withColumn("gap", gap).drop("_bin")


def nearest_matches(pairs: DataFrame, record: str, tol: float, rounds: int = 3) -> DataFrame:
    """One-to-one matches: pairs in the order of (gap, r_id, d_id), taken if both sides are free.

    A pair that comes first among those of its reference and among those of its detection is
    in the result whatever happens elsewhere.  So all such pairs are taken at once, pairs
    with a side that is taken go, and this is done again: after ``rounds`` rounds what is left
    is written down, usually nothing.  The rest are chains of ever closer pairs, which
    ``_chains`` settles by pointer doubling.  Sides and not records are what windows are
    partitioned by, so a dense record spreads over all tasks.  ids are unique within a record.
    """
    columns = [record, "r_id", "d_id", "gap"]
    by_r, by_d = Window.partitionBy(record, "r_id"), Window.partitionBy(record, "d_id")
    first = ["gap", "r_id", "d_id"]
    left = pairs.select(*columns).withColumns({"_done": F.lit(False), "_hit": F.lit(False)})
    for _ in range(rounds):
        # a pair out of the running (_done) ranks behind all others
        left = left.withColumn("_a", F.row_number().over(by_r.orderBy("_done", *first)))
        hit = ~F.col("_done") & (F.col("_a") == 1) & (F.row_number().over(by_d.orderBy("_done", *first)) == 1)
        left = left.withColumn("_new", hit)
        left = left.withColumn("_dd", F.max("_new").over(by_d)).withColumn("_rr", F.max("_new").over(by_r))
        left = left.withColumns({"_hit": F.col("_hit") | F.col("_new"), "_done": F.col("_done") | F.col("_dd") | F.col("_rr")}).drop("_a", "_new", "_dd", "_rr")
    done = materialize(left, "matches")
    matches, left = done.where("_hit").select(*columns), done.where("NOT _done").select(*columns)
    while not left.isEmpty():
        hits = materialize(_chains(left, record), "chain-matches")
        matches = matches.unionByName(hits)
        left = materialize(left.join(hits.select(record, "r_id"), [record, "r_id"], "left_anti").join(hits.select(record, "d_id"), [record, "d_id"], "left_anti"), "open-pairs")
    return matches


def _chains(left: DataFrame, record: str) -> DataFrame:
    """Pairs that are in the result for sure: those that come first on both sides, and what follows from them along chains.

    A pair with exactly one better pair on its sides is taken if that one is not.  Such pairs
    point to it, and pointers double, with whether the number of steps is odd, until they lead to
    a pair that does not point: one with none before it is taken, and so is what lies an even
    number of steps away.  Only pointers to pairs that still point are followed, so no
    pair at the end of many chains is joined with all of them.
    """
    key, first = [record, "r_id", "d_id"], ["gap", "r_id", "d_id"]
    by_r, by_d = Window.partitionBy(record, "r_id").orderBy(*first), Window.partitionBy(record, "d_id").orderBy(*first)
    own = F.struct("r_id", "d_id")
    ranked = left.withColumns({"_a": F.row_number().over(by_r), "_ra": F.lag(own).over(by_r)}).withColumns({"_b": F.row_number().over(by_d), "_rb": F.lag(own).over(by_d)})
    ranked = materialize(ranked.withColumn("_q", F.when(F.col("_a") + F.col("_b") == 3, F.coalesce("_ra", "_rb"))).drop("_ra", "_rb"), "chain-ranks")
    heads = ranked.where("_a = 1 AND _b = 1").select(*left.columns)
    points = ranked.where("_q IS NOT NULL").select(*key, F.col("_q.r_id").alias("_qr"), F.col("_q.d_id").alias("_qd"))
    at = lambda df, *more: df.select(record, F.col("r_id").alias("_qr"), F.col("d_id").alias("_qd"), *more)
    table = points.join(at(points, F.lit(True).alias("_o")), [record, "_qr", "_qd"], "left").select(*key, "_qr", "_qd", F.lit(True).alias("odd"), F.coalesce("_o", F.lit(False)).alias("open"))
    while True:
        table = materialize(table, "chains")
        if table.where("open").isEmpty():
            break
        ahead = at(table, F.col("_qr").alias("_nr"), F.col("_qd").alias("_nd"), F.col("odd").alias("_odd"), F.col("open").alias("_open"))
        moved = table.where("open").join(ahead, [record, "_qr", "_qd"]).select(
            *key, F.col("_nr").alias("_qr"), F.col("_nd").alias("_qd"), (F.col("odd") != F.col("_odd")).alias("odd"), F.col("_open").alias("open"))
        table = table.where("NOT open").unionByName(moved)
    even = table.where("NOT odd").join(at(heads), [record, "_qr", "_qd"], "left_semi").select(*key)
    return heads.unionByName(left.join(even, key, "left_semi"))


def transfer_labels(det: DataFrame, ref: DataFrame, matches: DataFrame, record: str) -> DataFrame:
    """Each detection with the label of its reference, '' if it has none."""
    labels = matches.join(ref.select(record, "r_id", "label"), [record, "r_id"]).select(record, "d_id", "label")
    return det.join(labels, [record, "d_id"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def detection_score(n_ref: int | F.Column, n_det: int | F.Column, tp: F.Column) -> dict[str, F.Column]:
    """Counts and rates; a rate without a denominator is null, f1 then 0."""
    se, ppv = F.try_divide(tp, n_ref), F.try_divide(tp, n_det)
    return {"tp": tp, "fp": n_det - tp, "fn": n_ref - tp, "se": F.round(se, 4), "ppv": F.round(ppv, 4),
            "f1": F.round(F.coalesce(F.try_divide(2 * se * ppv, se + ppv), F.lit(0.0)), 4)}


def unmatched(ref: DataFrame, det: DataFrame, matches: DataFrame, record: str) -> DataFrame:
    """(record, side, id): references that no detection met (``missed``) and detections without a reference (``extra``)."""
    missed = ref.join(matches, [record, "r_id"], "left_anti").select(record, F.lit("missed").alias("side"), F.col("r_id").alias("id"))
    return missed.unionByName(det.join(matches, [record, "d_id"], "left_anti").select(record, F.lit("extra").alias("side"), F.col("d_id").alias("id")))


def detected(signals: DataFrame, detector: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """(record, d_id, d_t) of the peaks that a detector finds in each record's signal.

    signals has (record, fs, samples); ``detector(samples, fs)`` returns sample numbers and
    runs where the record lies, one record at a time.
    """
    kind = dict(signals.dtypes)["record"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for record, fs, samples in zip(part["record"].to_pylist(), part["fs"].to_pylist(), part["samples"].to_pylist(), strict=True):
                peaks = np.asarray(detector(np.asarray(samples, dtype=np.float64), fs)).astype(np.int64)
                rows += [(record, i, float(p)) for i, p in enumerate(np.sort(peaks).tolist())]
            record, ids, at = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(record, part["record"].type), pa.array(ids, pa.int64()), pa.array(at, pa.float64())], ["record", "d_id", "d_t"])

    return signals.select("record", "fs", "samples").mapInArrow(run, f"record {kind}, d_id long, d_t double")


def evaluated_detector(signals: DataFrame, ref: DataFrame, detector: Callable[[np.ndarray, float], np.ndarray], tol: float) -> DataFrame:
    """Per record: counts and rates of a detector against reference events (record, r_id, r_t)."""
    det = detected(signals, detector)
    found = nearest_matches(band_join(ref, det, "record", tol), "record", tol)
    one = lambda df, c: df.select("record", *(F.lit(int(x == c)).alias(x) for x in ("nr", "nd", "tp")))
    sums = (one(ref, "nr").unionByName(one(det, "nd")).unionByName(one(found, "tp")).unionByName(signals.select("record", *(F.lit(0).alias(x) for x in ("nr", "nd", "tp"))))
            .groupBy("record").agg(*(F.sum(c).alias(c) for c in ("nr", "nd", "tp"))))
    return sums.select("record", *(v.alias(k) for k, v in detection_score(F.col("nr"), F.col("nd"), F.col("tp")).items()))


def peaks_above(share: float = 0.5, gap: int = 5) -> Callable[[np.ndarray, float], np.ndarray]:
    """A plain detector: local maxima above a share of the largest value, the higher of two closer than ``gap`` samples."""

    def find(x: np.ndarray, fs: float) -> np.ndarray:
        inner = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= share * x.max())) + 1
        kept: list[int] = []
        for at in inner.tolist():
            if kept and at - kept[-1] < gap:
                if x[at] > x[kept[-1]]:
                    kept[-1] = at
            else:
                kept.append(at)
        return np.array(kept, dtype=np.int64)

    return find
