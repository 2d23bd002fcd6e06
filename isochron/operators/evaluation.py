"""Classification metrics, paired tests and precision-recall, all from grouped counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from .windows import quantiles, running_sums

#: Where the counts 0, 1, 2, ... of a Poisson variable with mean 1 end in (0, 1).
POISSON = np.cumsum([1 / math.e / math.factorial(k) for k in range(13)])

#: Scores by name, as columns of ``scores``.
METRICS = ("acc", "f1_weighted", "f1_macro")


def metric(name: str) -> F.Column:
    """The column of a score by its name; an unknown name is an error."""
    if name not in METRICS:
        raise ValueError(f"no metric {name}; there are {', '.join(METRICS)}")
    return F.col(name)


def confusion(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y_true, y_pred, n)."""
    return pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def by_class(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per class that is true or predicted anywhere: support, predicted, tp, recall, f1 (0 without a denominator)."""
    true = counts.select(*keys, F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
                         F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"))
    pred = counts.select(*keys, F.col("y_pred").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("tp"))
    sums = true.unionByName(pred).groupBy(*keys, "label").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "tp")))
    return sums.withColumns({
        "recall": F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)),
        "f1": F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)),
    })


def scores(counts: DataFrame, keys: list[str], subset: list[str] | None = None) -> DataFrame:
    """acc, f1_weighted, f1_macro (over all labels, or over ``subset``) from confusion counts."""
    own = by_class(counts, keys)
    chosen = F.col("label").isin(subset) if subset else F.lit(True)
    return own.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("acc"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg(F.when(chosen, F.col("f1"))).alias("f1_macro"))


def mcnemar(pred: DataFrame) -> DataFrame:
    """Counts of right and wrong for each pair of classifiers on the same rows; pred has (id, clf, y_true, y_pred).

    The classifiers' answers of one row are gathered by a partial aggregate, so each
    row crosses the network once and pairs are formed inside it.
    """
    rows = pred.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("clf", (F.col("y_true") == F.col("y_pred")).alias("ok")))).alias("own"))
    pairs = rows.select(F.explode(F.expr(
        "flatten(transform(own, (a, i) -> transform(filter(own, b -> b.clf > a.clf), b -> struct(a.clf AS clf_a, b.clf AS clf_b, a.ok AS ok_a, b.ok AS ok_b))))")).alias("p"))
    count = lambda a, b: F.count_if((F.col("p.ok_a") == a) & (F.col("p.ok_b") == b))
    return pairs.groupBy("p.clf_a", "p.clf_b").agg(
        count(True, True).alias("both_right"), count(True, False).alias("only_a"), count(False, True).alias("only_b"), count(False, False).alias("both_wrong"))


def mcnemar_test(table: DataFrame, exact_below: int = 25) -> DataFrame:
    """statistic and p: exact binomial below ``exact_below`` discordant rows, else corrected chi-square."""
    @F.udf(T.DoubleType())
    def p(b, c, stat):
        return 1.0 if b + c == 0 else stats.binomial_two_sided(min(b, c), b + c) if b + c < exact_below else stats.chi2_sf(stat)

    n = F.col("only_a") + F.col("only_b")
    chi = (F.abs(F.col("only_a") - F.col("only_b")) - 1) * (F.abs(F.col("only_a") - F.col("only_b")) - 1) / n
    stat = F.when(n == 0, 0.0).when(n < exact_below, F.least("only_a", "only_b").cast("double")).otherwise(chi)
    return table.withColumn("statistic", stat).withColumn("p", p("only_a", "only_b", "statistic"))


def holm(tests: DataFrame, p: str = "p", *ties: str) -> DataFrame:
    """Step-down adjusted p of a small table of tests (one per pair of classifiers)."""
    order = Window.partitionBy(F.lit(0)).orderBy(p, *ties)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    one = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("_adj", one).withColumn("p_holm", F.max("_adj").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_adj")


def precision_recall(rows: DataFrame, key: str, score: str = "score", hit: str = "hit") -> DataFrame:
    """(key, score, precision, recall) at each distinct score, hits counted from the highest down.

    Each curve ends at precision 1 and recall 0, a row without score.
    """
    tied = rows.groupBy(key, score).agg(F.sum(F.col(hit).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    positives = tied.groupBy(key).agg(F.sum("tp").alias("positives"))
    out = running_sums(tied, key, score, ["tp", "n"]).join(positives, key)
    points = out.select(key, score, (F.col("cum_tp") / F.col("cum_n")).alias("precision"),
                        F.coalesce(F.try_divide("cum_tp", "positives"), F.lit(0.0)).alias("recall"), "tp", "positives")
    end = positives.select(key, F.lit(None).cast(dict(rows.dtypes)[score]).alias(score), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                           F.lit(0).cast("long").alias("tp"), "positives")
    return points.unionByName(end)


def average_precision(curve: DataFrame, key: str) -> DataFrame:
    """Sum of precision times the gain in recall; the gain is the score's own hits."""
    return curve.groupBy(key).agg(F.sum(F.col("precision") * F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0))).alias("ap"))


def operating_points(rows: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """Counts and rates at every threshold of a key (a few dozen), score >= threshold.

    thresholds has one row per key with an array ``grid``; a row adds to the counts of its
    own cell of the grid only, and sums over the grid give each threshold's counts.
    """
    cell = F.size(F.filter("grid", lambda g: g <= F.col("score")))
    cells = rows.join(F.broadcast(thresholds), key).groupBy(key, "grid", cell.alias("cell")).agg(
        F.sum(F.col("hit").cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    spread = cells.select(key, "cell", "p", "n", F.posexplode("grid").alias("i", "threshold"))
    flag = F.col("cell") > F.col("i")
    out = spread.groupBy(key, "threshold").agg(
        F.coalesce(F.sum(F.when(flag, F.col("p"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(flag, F.col("n") - F.col("p"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~flag, F.col("p"))), F.lit(0)).alias("fn"), F.coalesce(F.sum(F.when(~flag, F.col("n") - F.col("p"))), F.lit(0)).alias("tn"))
    return out.withColumns({
        "ppv": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)),
        "sensitivity": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)),
        "fp_per_tp": F.coalesce(F.try_divide("fp", "tp"), F.lit(float("inf"))),
        "n_flagged": F.col("tp") + F.col("fp"),
    })


def sweep_grid(rows: DataFrame, key: str, points: int = 15) -> DataFrame:
    """Per key: evenly spaced thresholds between the 1st and 99th percentile, rounded, and 0."""
    ends = quantiles(rows, key, "score", [0.01, 0.99]).withColumnRenamed("q", "e")
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor((F.col("e")[0] + (F.col("e")[1] - F.col("e")[0]) * i / (points - 1)) * 10000.0 + 0.5) / 10000.0)
    return ends.select(key, F.array_sort(F.array_distinct(F.concat(grid, F.array(F.lit(0.0))))).alias("grid"))


def draw_number(frame: DataFrame, column: str) -> F.Column:
    """A whole number that a unit's draws follow from: whole ids as they are, others by 60 bits of the digest of their text."""
    if isinstance(frame.schema[column].dataType, T.IntegralType):
        return F.col(column).cast("long")
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 15), 16, 10).cast("long")


def draw_times(patient: np.ndarray, reps: int) -> np.ndarray:
    """(reps, patients): how often each replicate draws a patient, Poisson(1) by a hash of both.

    x = (p * 48271 + r * 69621 + 11) mod M, then x = (x * x mod M + r * 7 + p) mod M twice, with
    M = 2**31 - 1, is the place in (0, 1); the counts' probabilities 1 / (e * k!) cut it.
    """
    m = np.int64(2**31 - 1)
    p, r = (patient.astype(np.int64) % m)[None, :], np.arange(reps, dtype=np.int64)[:, None]
    x = (p * 48271 + r * 69621 + 11) % m
    for _ in range(2):
        x = (x * x % m + r * 7 + p) % m
    return np.searchsorted(POISSON, x / float(m), side="right")


def bootstrap(patient_counts: DataFrame, reps: int = 2000) -> DataFrame:
    """(rep, clf, y_true, y_pred, n): confusion counts of resampled patients.

    patient_counts has (patient, clf, y_true, y_pred, n), patients of any type, none of them null: metrics depend on counts only, so
    rows are reduced to them before any resampling.  A patient's number of draws follows
    from its id and the replicate (``draw_times``), so it is taken where the patient lies and
    replicates' counts are summed up in the same pass: what is shuffled is replicates x
    cells of the confusion tables from each task, whatever the number of patients.
    Independent Poisson counts take the place of draws of exactly as many patients.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, int] = {}
        held = np.zeros((reps, 64))
        for part in parts:
            keys = list(zip(part["clf"].to_pylist(), part["y_true"].to_pylist(), part["y_pred"].to_pylist(), strict=True))
            patient, row = np.unique(part["patient"].to_numpy(), return_inverse=True)
            column = np.array([cells.setdefault(k, len(cells)) for k in keys], dtype=np.int64)
            while len(cells) > held.shape[1]:
                held = np.hstack([held, np.zeros_like(held)])
            for lo in range(0, len(patient), 1024):
                own = (row >= lo) & (row < lo + 1024)
                table = np.zeros((min(1024, len(patient) - lo), held.shape[1]))
                np.add.at(table, (row[own] - lo, column[own]), part["n"].to_numpy()[own])
                held += draw_times(patient[lo : lo + 1024], reps) @ table
        for (clf, true, pred), c in cells.items():
            n = held[:, c].astype(np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([clf] * len(some)), pa.array([true] * len(some)), pa.array([pred] * len(some)), pa.array(n[some])],
                                             ["rep", "clf", "y_true", "y_pred", "n"])

    kind = dict(patient_counts.dtypes)
    rows = patient_counts.select(draw_number(patient_counts, "patient").alias("patient"), "clf", "y_true", "y_pred", F.col("n").cast("double").alias("n"))
    return (rows.mapInArrow(run, f"rep long, clf {kind['clf']}, y_true {kind['y_true']}, y_pred {kind['y_pred']}, n long")
            .groupBy("rep", "clf", "y_true", "y_pred").agg(F.sum("n").alias("n")))


def pair_differences(scored: DataFrame, keys: list[str], value: str, clfs: list[str]) -> DataFrame:
    """(keys, clf_a, clf_b, d): a score's difference for each pair of classifiers, formed inside one row."""
    wide = scored.groupBy(*keys).pivot("clf", clfs).agg(F.first(value))
    pairs = [F.struct(F.lit(a).alias("clf_a"), F.lit(b).alias("clf_b"), (F.col(a) - F.col(b)).alias("d")) for a in clfs for b in clfs if a < b]
    return wide.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.*")


def bootstrap_test(replicates: DataFrame, clfs: list[str], name: str = "f1_weighted", alpha: float = 0.05) -> DataFrame:
    """Per pair of classifiers: mean difference, interval, p = min(1, 2 min(P(d >= 0), P(d <= 0))) and Holm's p."""
    d = pair_differences(scores(replicates, ["rep", "clf"]).select("rep", "clf", metric(name)), ["rep"], name, clfs)
    side = lambda c: F.avg(c.cast("int"))
    # a row per replicate: small enough for exact percentiles in a task
    tests = d.groupBy("clf_a", "clf_b").agg(
        F.avg("d").alias("mean_diff"), F.percentile("d", alpha / 2).alias("ci_low"), F.percentile("d", 1 - alpha / 2).alias("ci_high"),
        F.least(F.lit(1.0), 2 * F.least(side(F.col("d") >= 0), side(F.col("d") <= 0))).alias("p"))
    return holm(tests, "p", "clf_a", "clf_b")


def sign_distribution(ranks: F.Column) -> F.Column:
    """Probabilities of all sums 0, 1, 2, ... that an array of whole ranks has if each counts or not by a fair coin.

    The generating function, a factor (1 + x**rank) / 2 for each rank, as an array of coefficients.
    """
    def factor(held: F.Column, rank: F.Column) -> F.Column:
        gap = F.array_repeat(F.lit(0.0), rank)
        return F.zip_with(F.concat(held, gap), F.concat(gap, held), lambda a, b: (a + b) / 2)

    return F.aggregate(ranks, F.array(F.lit(1.0)), factor)


def signed_ranks(differences: DataFrame, keys: list[str], exact_most: int = 50) -> DataFrame:
    """(keys, n, w_plus, w_minus, statistic, z, p) of Wilcoxon's signed ranks over column d; zeros dropped, ties share ranks.

    Ranks come from counts of equal |d| and running sums over them, so no pair's
    differences meet in one task.  p is exact for up to ``exact_most`` differences, ties or
    not: only such a key's ranks (doubled, so that shared ones are whole) are gathered into a
    row, and half of the sums of signs lie within the statistic.  Beyond that p is the normal
    approximation with its tie correction; z is given for all keys.
    """
    key = F.concat_ws(" ", *keys)
    sized = differences.where("d <> 0").select(*keys, key.alias("_k"), F.abs("d").alias("_d"), (F.col("d") > 0).cast("long").alias("_up"))
    tied = sized.groupBy(*keys, "_k", "_d").agg(F.count(F.lit(1)).alias("c"), F.sum("_up").alias("up"))
    run = running_sums(tied, "_k", "_d", ["c"])  # counts of |d| as large or larger
    n = tied.groupBy("_k").agg(F.sum("c").alias("n"))
    # ranks of a tie: from n - cum + 1 to n - cum + c
    twice = 2 * (F.col("n") - F.col("cum_c")) + F.col("c") + 1
    own = F.collect_list(F.when(F.col("n") <= exact_most, F.struct(twice.cast("int").alias("r"), F.col("c").cast("int").alias("c"))))
    sums = run.join(n, "_k").groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(twice / 2 * F.col("up")).alias("w_plus"), F.sum(twice / 2 * (F.col("c") - F.col("up"))).alias("w_minus"),
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("_ties"), own.alias("_own"))
    spread = F.sqrt((F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) - F.col("_ties") / 2) / 24)
    tail = F.udf(lambda z: None if z is None else math.erfc(abs(z) / math.sqrt(2)), T.DoubleType())  # a row per pair
    out = sums.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn("z", F.try_divide(F.col("statistic") - F.col("n") * (F.col("n") + 1) / 4, spread))
    ranks = F.flatten(F.transform("_own", lambda x: F.array_repeat(x["r"], x["c"])))
    below = F.slice(sign_distribution(ranks), F.lit(1), (2 * F.col("statistic")).cast("int") + 1)
    exact = F.least(F.lit(1.0), 2 * F.aggregate(below, F.lit(0.0), lambda a, x: a + x))
    return out.withColumn("p", F.when(F.col("n") <= exact_most, exact).otherwise(F.coalesce(tail("z"), F.lit(1.0)))).drop("_ties", "_own")


def fold_summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample sd and 95 % interval by Student's t over folds."""
    half = F.udf(lambda n: stats.t_quantile(0.975, n - 1) if n and n > 1 else None, T.DoubleType())
    out = values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    width = half("n") * F.col("sd") / F.sqrt("n")
    return out.withColumns({"ci_low": F.col("mean") - width, "ci_high": F.col("mean") + width})


def fold_spread(counts: DataFrame, label: str = "label", value: str = "n") -> DataFrame:
    """Per class: least, median (cut to a whole number) and largest count over folds, a table of a few rows per fold."""
    return counts.groupBy(label).agg(F.min(value).alias("least"), F.median(value).cast("long").alias("median"), F.max(value).alias("most"))
