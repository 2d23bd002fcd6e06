"""Experiments that compose features, folds and classifiers: windows, causality, runtime, separability."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import evaluation, features, geometry, learning

BASE = ("td_", "fd_", "mp_", "wv_")


def model_rows(table: DataFrame, id_: str, group: str, label: str) -> DataFrame:
    """(id, group, label, features) of a feature table."""
    columns = features.feature_columns(table)
    rows = table.select(F.col(id_).alias("id"), F.col(group).alias("group"), F.col(label).alias("label"), features.as_vector(columns).alias("features"))
    return materialize(rows, "model-rows")  # models read it many times


def held_out(rows: DataFrame, test: F.Column, name: str) -> DataFrame:
    return learning.evaluate(rows.where(~test), rows.where(test), name)


def causal_and_not(beats: DataFrame, record: str, order: list[str], segment: str, fs: float, ids: tuple[str, str, str], test: F.Column, name: str = "svc", width: int = 16) -> DataFrame:
    """(context, acc, f1_weighted, f1_macro): frames of the past against symmetric ones, on the same held-out groups."""
    out = None
    for context, causal in (("causal", True), ("acausal", False)):
        rows = model_rows(features.feature_table(beats, record, order, segment, fs, width=width, causal=causal), *ids)
        part = held_out(rows, test, name).withColumn("context", F.lit(context))
        out = part if out is None else out.unionByName(part)
    return out


def window_sweep(beats: DataFrame, record: str, order: list[str], segment: str, fs: float, ids: tuple[str, str, str], test: F.Column,
                 widths: tuple[int, ...] = (8, 16, 32, 64), name: str = "svc") -> DataFrame:
    """(width, acc, f1_weighted, f1_macro) as a function of the frame's width; families without a frame are computed once."""
    base = materialize(features.without_frames(beats, segment, fs), "base")
    out = None
    for width in widths:
        rows = model_rows(features.with_frames(base, record, order, segment, width=width), *ids)
        part = held_out(rows, test, name).withColumn("width", F.lit(width))
        out = part if out is None else out.unionByName(part)
    return out


def runtime(beats: DataFrame, record: str, order: list[str], segment: str, fs: float) -> DataFrame:
    """(family, ms_per_beat): wall time of each family over all beats, written nowhere; figures of this machine, not results."""
    steps = {
        "time": lambda b: features.time_features(b, segment),
        "freq": lambda b: features.kernel_features(b, segment, fs, ("freq",)),
        "morph": lambda b: features.kernel_features(b, segment, fs, ("morph",)),
        "wavelet": lambda b: features.kernel_features(b, segment, fs, ("wavelet",)),
        "graph": lambda b: features.graph_features(features.descriptor(b, segment), record, order).drop("descriptor"),
    }
    n = beats.count()
    rows = []
    for family, step in steps.items():
        began = time.perf_counter()
        step(beats).write.format("noop").mode("overwrite").save()
        rows.append((family, (time.perf_counter() - began) * 1000 / max(n, 1)))
    return beats.sparkSession.createDataFrame(rows, "family string, ms_per_beat double")


def separability(rows: DataFrame, tolerances: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.10), folds: int = 3) -> DataFrame:
    """(measure, value): training separability, scatter ratios, the kernel's gap and the separable fraction of pairs, on rows scaled once."""
    scaler = learning.Scaler.fit(rows)
    mean, scale = (F.array(*map(F.lit, x.tolist())) for x in (scaler.mean, scaler.scale))
    scaled = rows.withColumn("features", F.zip_with(F.zip_with("features", mean, lambda a, b: a - b), scale, lambda a, b: a / b))
    scaled = materialize(scaled, "scaled")
    own = learning.train_separability(scaled).first().asDict()
    long = geometry.long(scaled)
    own |= {"fisher": geometry.scatter(long).first()["fisher"], "regularized_fisher": geometry.regularized_fisher(long)}
    gap = learning.gaps(learning.fold_scores(scaled, ["linear", "rbf"], folds)).first().asDict()
    own |= {f"kernel_{k}": v for k, v in gap.items() if k not in ("clf", "n")}
    for r in learning.separable_fraction(learning.pair_errors(scaled), list(tolerances)).collect():
        own[f"separable_{r['tolerance']}"] = r["separable_fraction"]
    return rows.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in own.items()], "measure string, value double")


def minority_report(rows: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """Every operating point of a sweep with its class's average precision and numbers of positives and of rows."""
    curve = evaluation.precision_recall(rows, key)
    sizes = rows.groupBy(key).agg(F.sum(F.col("hit").cast("long")).alias("n_positive"), F.count(F.lit(1)).alias("n_total"))
    return evaluation.operating_points(rows, thresholds, key).join(evaluation.average_precision(curve, key), key).join(sizes, key)
