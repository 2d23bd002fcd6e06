"""Agreement of two models' importance over shared frequency bands."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import tables
from .learning import Linear


def band_importance(coefficients: DataFrame, bands: DataFrame) -> DataFrame:
    """(band, importance): absolute coefficients summed over classes and the band's features, normalised to 1.

    coefficients has (class, feature, value), bands (feature, band); zeros if all are 0.
    """
    own = coefficients.join(bands, "feature").groupBy("band").agg(F.sum(F.abs("value")).alias("w"))
    whole = F.sum("w").over(Window.partitionBy(F.lit(0)))  # a handful of bands
    return own.select("band", F.coalesce(F.try_divide("w", whole), F.lit(0.0)).alias("importance"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cosine, rank correlation (for more than two bands) and whether the top band is the same."""
    both = a.select("band", F.col("importance").alias("x")).join(b.select("band", F.col("importance").alias("y")), "band")
    rank = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    both = both.withColumns({"rx": rank("x"), "ry": rank("y")})
    return both.agg(
        (F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))) + 1e-12)).alias("cosine"),
        F.when(F.count(F.lit(1)) > 2, F.corr("rx", "ry")).alias("spearman"),
        (F.max_by("band", F.struct("x", "band")) == F.max_by("band", F.struct("y", "band"))).alias("same_top"))


def coefficients(spark, model: Linear, names: list[str]) -> DataFrame:
    """(class, feature, value) of a linear model, without intercepts: classes x features, as many as the driver holds."""
    rows = [(str(c), n, float(v)) for c, own in zip(model.classes, model.coef[:, :-1], strict=True) for n, v in zip(names, own, strict=True)]
    return spark.createDataFrame(rows, "class string, feature string, value double")


def with_meta(coefs: DataFrame, meta: DataFrame) -> DataFrame:
    """Coefficients with their feature's family and band; meta has (feature, family, band), band null for features of no band."""
    return coefs.join(F.broadcast(meta), "feature", "left")  # a row per feature


def band_areas(rows: DataFrame, attribution: str, fs: float, bands: dict = K.BANDS) -> DataFrame:
    """rows with an array of the Welch areas of their attribution in each band, in the order of ``bands``."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array(part[attribution].to_pylist(), dtype=np.float64)
            out = np.zeros((part.num_rows, len(bands)))
            if len(x):
                f, p = K.welch(x, fs)
                for i, (lo, hi) in enumerate(bands.values()):
                    inside = (f >= lo) & (f < hi)
                    out[:, i] = np.trapezoid(p[:, inside], f[inside], axis=1) if inside.any() else 0.0
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out.tolist(), pa.list_(pa.float64()))], [*part.schema.names, "areas"])

    return rows.mapInArrow(run, f"{own}, areas array<double>")


def attribution_importance(rows: DataFrame, attribution: str, fs: float, bands: dict = K.BANDS) -> DataFrame:
    """(band, importance): what each band has of the attributions' power over all rows, normalised to 1; zeros if all are 0."""
    names = F.array(*map(F.lit, bands))
    cells = band_areas(rows.select(attribution), attribution, fs, bands).select(F.explode(F.arrays_zip(names.alias("band"), F.col("areas").alias("w"))).alias("x")).select("x.*")
    own = cells.groupBy("band").agg(F.sum("w").alias("w"))
    whole = F.sum("w").over(Window.partitionBy(F.lit(0)))  # a handful of bands
    return own.select("band", F.coalesce(F.try_divide("w", whole), F.lit(0.0)).alias("importance"))


def cosines(rows: DataFrame, importance: list[float], areas: str = "areas") -> DataFrame:
    """rows with the cosine of their own normalised band areas with a given importance."""
    given = F.array(*map(F.lit, importance))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("cosine", dot(F.col(areas), given) / (F.sqrt(dot(F.col(areas), F.col(areas))) * F.sqrt(dot(given, given)) + 1e-12))


def permutation(given: list, k: int) -> list:
    """Permutation k, from 0, of a list in lexicographic order of places, by the digits of k to falling factorials."""
    rest, out = list(given), []
    while rest:
        at, k = divmod(k, math.factorial(len(rest) - 1))
        out.append(rest.pop(at))
    return out


def significance(rows: DataFrame, id_: str, attribution: str, importance: dict[str, float], fs: float, reps: int = 2000) -> DataFrame:
    """One row: the rows' mean cosine with its bootstrap interval, and the observed cosine with a permutation p.

    Rows are drawn as patients are in ``evaluation.bootstrap``: their counts follow from row
    and replicate, so each replicate's sums are taken where rows lie.  The null shuffles the
    importance over bands; replicate r takes permutation r * 48271 mod (2**31 - 1) mod n! of
    the n bands, in lexicographic order.  p = (nulls at or above the observed + 1) / (reps + 1).
    """
    from .evaluation import draw_number, draw_times

    spark = rows.sparkSession
    bands = {k: K.BANDS[k] for k in importance}
    given = list(importance.values())
    own = cosines(band_areas(rows.select(draw_number(rows, id_).alias("_id"), attribution), attribution, fs, bands), given)

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((reps, 2))
        for part in parts:
            ids, c = part["_id"].to_numpy(), part["cosine"].to_numpy()
            for lo in range(0, len(ids), 1024):
                times = draw_times(ids[lo : lo + 1024], reps)
                held += np.stack([times.sum(axis=1), times @ c[lo : lo + 1024]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), pa.array(held[:, 0]), pa.array(held[:, 1])], ["rep", "n", "s"])

    drawn = own.select("_id", "cosine").mapInArrow(draw, "rep long, n double, s double").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("mean"))
    boot = drawn.agg(F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"))  # a row per replicate
    facts = own.agg(F.avg("cosine").alias("mean_cosine"),
                    *(F.avg(F.col("areas")[i] / F.aggregate("areas", F.lit(1e-300), lambda s, x: s + x)).alias(f"m{i}") for i in range(len(bands)))).first()
    mean = np.array([facts[f"m{i}"] or 0.0 for i in range(len(bands))])
    cos = lambda u: float(np.dot(u, mean) / (np.linalg.norm(u) * np.linalg.norm(mean) + 1e-12))
    observed = cos(np.array(given))
    null = np.array([cos(np.array(permutation(given, r * 48271 % (2**31 - 1) % math.factorial(len(given))))) for r in range(reps)])
    tail = (int((null >= observed - 1e-15).sum()) + 1) / (reps + 1)
    return boot.select(F.lit(facts["mean_cosine"]).alias("mean_cosine"), "ci_low", "ci_high", F.lit(observed).alias("observed_cosine"), F.lit(tail).alias("p"),
                       F.lit(float(null.mean())).alias("null_mean"))


def report(model: Linear, names: list[str], bands: DataFrame, rows: DataFrame, attributions: list[str], fs: float, other_parameters: int) -> DataFrame:
    """(attribution, cosine, spearman, same_top, linear_params, other_params, ratio): a linear model beside each column of attributions."""
    spark, out = rows.sparkSession, None
    own = band_importance(coefficients(spark, model, names), bands)
    size = int(model.coef.size)  # coefficients and an intercept per class
    for name in attributions:
        part = agreement(own, attribution_importance(rows, name, fs)).select(
            F.lit(name).alias("attribution"), "*", F.lit(size).alias("linear_params"), F.lit(other_parameters).alias("other_params"),
            tables.cost_ratio(F.lit(size), F.lit(other_parameters)).alias("ratio"))
        out = part if out is None else out.unionByName(part)
    return out
