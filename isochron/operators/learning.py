"""Linear and other classifiers, fitted on training rows only, and the experiments around them.

Rows are (id, group, label, features ARRAY<DOUBLE>).  Everything that is learnt (medians,
scales, components, weights) comes from the training rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import matrix
from ..session import materialize

from . import balance, evaluation, geometry, sampling
from .windows import cut_points, quantiles, ranked, running_sums, slice_of


#: Cells of a sum that travel as one array.
CELLS = 8192
#: Files and cores up to which tasks' arrays are added up in one step.
FEW_TASKS = 64


def _sum_cells(rows: DataFrame, partial: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: list[str], label: str = "label") -> np.ndarray:
    """Sum over all rows of an array that each batch yields; added up per task, then by Spark chunk by chunk."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in parts:
            if part.num_rows:
                x = matrix(part["features"])
                cells = partial(x, np.array(part[label].to_pylist(), dtype=object)).ravel()
                held = cells if held is None else held + cells
        if held is not None:
            chunks = [held[lo : lo + CELLS] for lo in range(0, len(held), CELLS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int64()), pa.array(chunks, pa.list_(pa.float64()))], ["chunk", "x"])

    # n tasks' arrays are added up in about sqrt(n) groups of at most 2 * sqrt(n) + 1, and then the groups' sums;
    # a few tasks' arrays at once: an exchange for each of many small passes would take longer than it saves
    few = max(len(rows.inputFiles()), rows.sparkSession.sparkContext.defaultParallelism) <= FEW_TASKS
    made = rows.select(*columns).mapInArrow(run, "chunk long, x array<double>").withColumn("part", F.floor(F.sqrt(F.spark_partition_id())))
    for keys in (["chunk"],) if few else (["chunk", "part"], ["chunk"]):
        parts = made.groupBy(*keys).agg(F.collect_list("x").alias("x"))
        made = parts.select(*keys, F.reduce(F.slice("x", 2, F.size("x")), F.col("x")[0], lambda s, x: F.zip_with(s, x, lambda a, b: a + b)).alias("x"))
    found = made.collect()
    return np.concatenate([r["x"] for r in sorted(found, key=lambda r: r["chunk"])]) if found else np.empty(0)


@dataclass
class Scaler:
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame) -> Scaler:
        """Means first, then squares about them: no figures cancel however large the means are."""
        sums = _sum_cells(rows, lambda x, _: np.concatenate([[len(x)], x.sum(axis=0)]), ["features", "label"])
        mean = sums[1:] / sums[0]
        off = _sum_cells(rows, lambda x, _: np.concatenate([(x - mean).sum(axis=0), ((x - mean) ** 2).sum(axis=0)]), ["features", "label"]) / sums[0]
        d = len(mean)
        var = np.maximum(off[d:] - off[:d] ** 2, 0)
        sd = np.where(var > (1e-14 * np.abs(mean)) ** 2, np.sqrt(var), 0)  # less than what rounding leaves of a constant
        return cls(mean + off[:d], np.where(sd > 0, sd, 1.0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale


@dataclass
class Linear:
    """One-versus-rest linear scores; coefficients' last column is the intercept."""

    classes: list
    scaler: Scaler
    coef: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.scaler(x) @ self.coef[:, :-1].T + self.coef[:, -1]

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows, labelled or not, with y_pred and the array of scores in the order of the classes."""
        sent = rows.sparkSession.sparkContext.broadcast(self)
        kind = dict(rows.dtypes).get("label", "string" if isinstance(self.classes[0], str) else "bigint")
        arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[kind]

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for part in parts:
                x = matrix(part["features"])
                s = model.scores(x) if part.num_rows else np.empty((0, len(model.classes)))
                best = s.argmax(axis=1) if len(s) else []
                pred = pa.array([model.classes[b] for b in best], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, pred, pa.array(s.tolist(), pa.list_(pa.float64()))], [*part.schema.names, "y_pred", "scores"])

        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{own}, y_pred {kind}, scores array<double>")

    @property
    def kilobytes(self) -> float:
        return self.coef.size * 8 / 1024


@dataclass
class Problem:
    """A binary problem: rows of ``positive`` labels against those of ``negative`` ones, with a weight per label."""

    positive: list
    negative: list
    weight: dict


def solve(rows: DataFrame, scaler: Scaler, problems: list[Problem], loss: str = "squared_hinge", c: float = 0.1, rounds: int = 30, tol: float = 1e-8,
          start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (intercept last) of all problems at the optimum of 1/2 |w|^2 + c * sum of weighted losses.

    ``loss`` is squared_hinge (intercept penalised, as a further feature of 1) or logistic
    (intercept free).  Newton's method: each round is one pass in which tasks sum gradients
    and Hessians of all problems; the driver solves systems of (features + 1) unknowns.
    """
    d, k = len(scaler.mean) + 1, len(problems)
    w = np.zeros((k, d)) if start is None else start
    penal, whole = np.ones(d), None
    if loss == "logistic":
        penal[-1] = 0.0
    sizes = 0.5 ** np.arange(12)

    # a problem's side (1, -1, or 0: not in it) and weight of every label, by the label's number; the last is that of others
    names = list(dict.fromkeys(x for p in problems for x in (*p.positive, *p.negative)))
    number = {x: i for i, x in enumerate(names)}
    side = np.zeros((k, len(names) + 1))
    weight = np.zeros((k, len(names) + 1))
    for i, p in enumerate(problems):
        for labels, y in ((p.negative, -1.0), (p.positive, 1.0)):
            for x in labels:
                side[i, number[x]], weight[i, number[x]] = y, p.weight[x]

    def sides(x: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        z = np.hstack([scaler(x), np.ones((len(x), 1))])
        code = np.array([number.get(x, len(names)) for x in labels.tolist()])
        for i in range(k):
            y = side[i][code]
            own = y != 0
            yield (z, y, weight[i][code]) if own.all() else (z[own], y[own], weight[i][code[own]])

    def losses(m: np.ndarray) -> np.ndarray:
        return np.logaddexp(0, -m) if loss == "logistic" else np.maximum(1 - m, 0) ** 2

    def slopes(w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Value, gradient and Hessian of every problem's losses, in one pass."""

        def partial(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
            cells = []
            for i, (z, y, v) in enumerate(sides(x, labels)):
                m = y * (z @ w[i])
                if loss == "logistic":
                    q = 1 / (1 + np.exp(np.clip(m, -500, 500)))
                    slope, curve = -v * y * q, v * q * (1 - q)
                else:
                    gap = np.maximum(1 - m, 0)
                    slope, curve = -2 * v * y * gap, 2 * v * (gap > 0)
                bent = np.flatnonzero(curve)
                near = z if len(bent) == len(z) else z[bent]
                cells += [[(v * losses(m)).sum()], z.T @ slope, (near.T @ (near * curve[bent][:, None])).ravel()]
            return np.concatenate(cells)

        s = _sum_cells(rows, partial, ["features", "label"]).reshape(k, -1)
        return s[:, 0], s[:, 1 : d + 1], s[:, d + 1 :].reshape(k, d, d)

    def values(w: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Every problem's losses after each size of step, in one pass."""

        def partial(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
            cells = []
            for i, (z, y, v) in enumerate(sides(x, labels)):
                m, back = y * (z @ w[i]), y * (z @ step[i])
                cells.append([(v * losses(m - t * back)).sum() for t in sizes])
            return np.concatenate(cells)

        return _sum_cells(rows, partial, ["features", "label"]).reshape(k, -1)

    found, hopeful = slopes(w), True
    for _ in range(rounds):
        value, grad, hess = found
        full = w * penal + c * grad
        step = np.stack([np.linalg.lstsq(np.diag(penal) + c * h, g, rcond=None)[0] for h, g in zip(hess, full, strict=True)])
        now = 0.5 * (penal * w**2).sum(axis=1) + c * value
        whole = now.max() if whole is None else whole  # at w = 0: about c times the sum of weights
        if np.abs(full).max() <= tol * max(1.0, whole) or ((full * step).sum(axis=1) <= 1e-9 * np.maximum(1.0, now)).all():
            break
        if hopeful:  # a whole step is nearly always good: one pass then tells so and goes on from there
            there = w - step
            found = slopes(there)
            if (0.5 * (penal * there**2).sum(axis=1) + c * found[0] <= now + 1e-12 * np.abs(now)).all():
                w = there
                continue
        trial = w[:, None, :] - sizes[None, :, None] * step[:, None, :]
        after = 0.5 * (penal * trial**2).sum(axis=2) + c * values(w, step)
        good = after <= (now + 1e-12 * np.abs(now))[:, None]
        # the largest step that does not raise the value, or none
        w = np.where(good.any(axis=1)[:, None], trial[np.arange(k), good.argmax(axis=1)], w)
        if not good.any():
            break
        found, hopeful = slopes(w), bool(good[:, 0].all())
    return w


def label_counts(rows: DataFrame) -> dict:
    return {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit_linear(rows: DataFrame, loss: str = "squared_hinge", c: float = 0.1, balanced: bool = True, rounds: int = 30, tol: float = 1e-8,
               start: np.ndarray | None = None, counts: dict | None = None, scaler: Scaler | None = None) -> Linear:
    """One-versus-rest linear classifiers (see ``solve``); rows that have been counted and measured come with ``counts`` and ``scaler``.

    Balanced weights of the squared hinge are those of one fit of all classes: n / (classes *
    n of the row's own class).  The logistic ones are fits of their own, so each balances
    its two sides: n / (2 * n of the side).
    """
    counts = label_counts(rows) if counts is None else counts
    classes, n = sorted(counts), sum(counts.values())
    problems = []
    for own in classes:
        rest = [x for x in classes if x != own]
        if not balanced:
            weight = dict.fromkeys(classes, 1.0)
        elif loss == "squared_hinge":
            weight = {x: n / (len(classes) * counts[x]) for x in classes}
        else:
            weight = {x: n / (2 * counts[own]) if x == own else n / (2 * max(n - counts[own], 1)) for x in classes}
        problems.append(Problem([own], rest, weight))
    scaler = Scaler.fit(rows) if scaler is None else scaler
    return Linear(classes, scaler, solve(rows, scaler, problems, loss, c, rounds, tol, start))


def pair_errors(rows: DataFrame, c: float = 1e4, rounds: int = 30) -> DataFrame:
    """(a, b, n, error): training error of a nearly hard-margin linear classifier for each pair of classes.

    Rows are scaled over all classes once.  All pairs are solved in the same passes over the
    rows, and one more pass counts their errors.
    """
    counts = label_counts(rows)
    pairs = [(a, b) for a in sorted(counts) for b in sorted(counts) if a < b]
    scaler = Scaler.fit(rows)
    kind = dict(rows.dtypes)["label"]
    if not pairs:
        return rows.sparkSession.createDataFrame([], f"a {kind}, b {kind}, n long, error double")
    w = solve(rows, scaler, [Problem([b], [a], {a: 1.0, b: 1.0}) for a, b in pairs], "squared_hinge", c, rounds)

    def wrong(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        s = np.hstack([scaler(x), np.ones((len(x), 1))]) @ w.T
        return np.array([((labels == a) & (s[:, i] > 0)).sum() + ((labels == b) & (s[:, i] <= 0)).sum() for i, (a, b) in enumerate(pairs)], dtype=np.float64)

    errors = _sum_cells(rows, wrong, ["features", "label"])
    return rows.sparkSession.createDataFrame([(a, b, counts[a] + counts[b], float(e) / (counts[a] + counts[b])) for (a, b), e in zip(pairs, errors, strict=True)],
                                             f"a {kind}, b {kind}, n long, error double")


def separable_fraction(errors: DataFrame, tolerances: list[float]) -> DataFrame:
    """(tolerance, n_separable, n_pairs, separable_fraction) from errors of pairs, which are taken once."""
    swept = errors.withColumn("tolerance", F.explode(F.array(*map(F.lit, tolerances))))
    own = F.count_if(F.col("error") <= F.col("tolerance"))
    return swept.groupBy("tolerance").agg(own.alias("n_separable"), F.count(F.lit(1)).alias("n_pairs"), (own / F.count(F.lit(1))).alias("separable_fraction"))


def train_separability(rows: DataFrame, c: float = 1e4, rounds: int = 30) -> DataFrame:
    """One row: accuracy on the training rows themselves, mean and median margin of the best over the second score."""
    scored = fit_linear(rows, "squared_hinge", c, balanced=False, rounds=rounds).predict(rows)
    own = geometry.top_margin(scored, "scores").withColumn("_all", F.lit(0))
    # with two classes the scores mirror each other, and the margin is the size of one
    own = own.withColumn("margin", F.when(F.size("scores") == 2, F.abs(F.col("scores")[1])).otherwise(F.col("margin")))
    mean = own.groupBy("_all").agg(F.avg((F.col("label") == F.col("y_pred")).cast("int")).alias("train_accuracy"), F.avg("margin").alias("mean_margin"))
    return mean.join(quantiles(own, "_all", "margin", [0.5]), "_all").select(
        "train_accuracy", "mean_margin", F.col("q")[0].alias("median_margin"), (1 - F.col("train_accuracy")).alias("frac_misclassified"))


#: Model factories by name; each takes training rows and returns something with predict(rows).
FACTORIES: dict[str, Callable[[DataFrame], object]] = {
    "svc": lambda rows: fit_linear(rows, "squared_hinge", 0.1),
    "lr": lambda rows: fit_linear(rows, "logistic", 1.0),
}


def _answers(classes: list) -> list[F.Column]:
    """y_pred, and scores in the order of the classes, of a Spark ML model with prediction _p and probability _q."""
    from pyspark.ml.functions import vector_to_array

    return [F.get(F.array(*map(F.lit, classes)), F.col("_p").cast("int")).alias("y_pred"), F.slice(vector_to_array("_q"), 1, len(classes)).alias("scores")]


class Forest:
    """Spark ML's trees behind the same interface: DecisionTree (depth 5) or RandomForest."""

    def __init__(self, rows: DataFrame, trees: int = 1, depth: int = 5, seed: int = 42):
        from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
        from pyspark.ml.functions import array_to_vector

        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.classes = sorted(counts)
        n = sum(counts.values())
        table = rows.sparkSession.createDataFrame([(k, float(i), n / (len(counts) * counts[k])) for i, k in enumerate(self.classes)],
                                                  f"label {dict(rows.dtypes)['label']}, _y double, _w double")
        data = rows.join(F.broadcast(table), "label").select(array_to_vector("features").alias("_v"), "_y", "_w")
        how = {"featuresCol": "_v", "labelCol": "_y", "weightCol": "_w", "maxDepth": depth, "seed": seed}
        self.model = (DecisionTreeClassifier(**how) if trees == 1 else RandomForestClassifier(numTrees=trees, **how)).fit(data)

    def predict(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        out = self.model.setPredictionCol("_p").setProbabilityCol("_q").transform(rows.withColumn("_v", array_to_vector("features")))
        return out.select(*rows.columns, *_answers(self.classes))


class Neighbours:
    """A majority of the k nearest training rows answers, its share is the score; ties go to the class that sorts first."""

    def __init__(self, rows: DataFrame, k: int = 15):
        self.rows, self.k, self.classes = rows, k, sorted(label_counts(rows))

    def predict(self, rows: DataFrame) -> DataFrame:
        near = geometry.neighbours(rows, self.rows, self.k, others=True)
        n = [F.count_if(F.col("label") == F.lit(c)) for c in self.classes]
        votes = near.groupBy("query").agg(F.array(*n).alias("_n"))
        best = F.get(F.array(*map(F.lit, self.classes)), F.array_position("_n", F.array_max("_n")).cast("int") - 1)
        total = F.aggregate("_n", F.lit(0).cast("long"), lambda s, x: s + x)
        return rows.join(votes.select(F.col("query").alias("id"), best.alias("y_pred"), F.transform("_n", lambda x: x / total).alias("scores")), "id")


class Perceptron:
    """Spark ML's multilayer perceptron on scaled features behind the same interface."""

    def __init__(self, rows: DataFrame, hidden: int = 64, rounds: int = 400, seed: int = 42):
        from pyspark.ml.classification import MultilayerPerceptronClassifier
        from pyspark.ml.functions import array_to_vector

        self.scaler, self.classes = Scaler.fit(rows), sorted(label_counts(rows))
        number = F.create_map(*(F.lit(x) for i, k in enumerate(self.classes) for x in (k, float(i))))
        data = self._scaled(rows).select(array_to_vector("features").alias("_v"), number[F.col("label")].alias("_y"))
        self.model = MultilayerPerceptronClassifier(layers=[len(self.scaler.mean), hidden, max(2, len(self.classes))], featuresCol="_v", labelCol="_y", maxIter=rounds, seed=seed).fit(data)

    def _scaled(self, rows: DataFrame) -> DataFrame:
        mean, scale = (F.array(*map(F.lit, x.tolist())) for x in (self.scaler.mean, self.scaler.scale))
        return rows.withColumn("features", F.zip_with(F.zip_with("features", mean, lambda a, b: a - b), scale, lambda a, b: a / b))

    def predict(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        ready = self._scaled(rows.withColumn("_kept", F.col("features"))).withColumn("_v", array_to_vector("features"))
        out = self.model.setPredictionCol("_p").setProbabilityCol("_q").transform(ready)
        return out.select(*(F.col("_kept").alias(c) if c == "features" else c for c in rows.columns), *_answers(self.classes))


FACTORIES["dt"] = Forest
FACTORIES["rf"] = lambda rows: Forest(rows, trees=50, depth=8)
FACTORIES["rf200"] = lambda rows: Forest(rows, trees=200, depth=8)
FACTORIES["knn"] = Neighbours
FACTORIES["mlp"] = Perceptron


class Lifted:
    """A linear classifier on random Fourier features of scaled rows: near an RBF machine of width gamma, without landmarks."""

    def __init__(self, rows: DataFrame, gamma: float | None = None, c: float = 1.0, features: int = 64):
        self.scaler = Scaler.fit(rows)
        self.gamma = gamma if gamma is not None else 1.0 / len(self.scaler.mean)  # scaled features have unit variance
        self.features = features
        self.model = fit_linear(materialize(self._lift(rows), "lifted"), "squared_hinge", c, balanced=False, rounds=15)
        self.classes = self.model.classes

    def _lift(self, rows: DataFrame) -> DataFrame:
        mean, scale = (F.array(*map(F.lit, x.tolist())) for x in (self.scaler.mean, self.scaler.scale))
        scaled = rows.withColumn("features", F.zip_with(F.zip_with("features", mean, lambda a, b: a - b), scale, lambda a, b: a / b))
        return random_fourier(scaled, self.gamma, self.features)

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.model.predict(self._lift(rows)).select("id", "y_pred", "scores"), "id")


class Kernel:
    """A kernel machine of RBF width gamma over landmarks: squared hinge, one class against the rest.

    Rows become their kernel values with the landmarks times the inverse root of the landmarks' own
    kernel matrix (Nystrom), in which a linear machine is the kernel machine over the span of the
    landmarks: with all rows as landmarks, the exact one.  Landmarks are the first ``landmarks`` rows by a
    hash of their id; their coordinates are what the driver holds.  ``objective`` is the sum over
    classes of 1/2 |w|^2 + c * losses at the optimum.
    """

    def __init__(self, rows: DataFrame, gamma: float | None = None, c: float = 1.0, landmarks: int = 128, rounds: int = 30):
        self.scaler = Scaler.fit(rows)
        self.gamma = gamma if gamma is not None else 1.0 / len(self.scaler.mean)  # scaled features have unit variance
        chosen = rows.select("id", "features").orderBy(F.xxhash64("id"), "id").limit(landmarks).collect()
        self.landmarks = self.scaler(np.array([r["features"] for r in chosen], dtype=np.float64))
        value, vector = np.linalg.eigh(self._values(self.landmarks))
        some = value > 1e-10 * value[-1]
        self.root = vector[:, some] / np.sqrt(value[some])
        lifted = materialize(self._lift(rows), "kernel")
        counts = label_counts(rows)
        self.classes = sorted(counts)
        problems = [Problem([own], [x for x in self.classes if x != own], dict.fromkeys(self.classes, 1.0)) for own in self.classes]
        d = int(some.sum())
        plain = Scaler(np.zeros(d), np.ones(d))  # kernel features are taken as they are
        self.model = Linear(self.classes, plain, solve(lifted, plain, problems, "squared_hinge", c, rounds))
        self.c, self.problems, self.lifted = c, problems, lifted

    def _values(self, x: np.ndarray) -> np.ndarray:
        d2 = (x * x).sum(axis=1)[:, None] + (self.landmarks * self.landmarks).sum(axis=1)[None, :] - 2 * (x @ self.landmarks.T)
        return np.exp(-self.gamma * np.maximum(d2, 0))

    def _lift(self, rows: DataFrame) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast((self.scaler, self.landmarks, self.root, self.gamma))
        schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'features' else f.dataType.simpleString()}" for f in rows.schema)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Kernel.__new__(Kernel)
            own.scaler, own.landmarks, own.root, own.gamma = sent.value
            for part in parts:
                if part.num_rows:
                    z = own._values(own.scaler(np.array(part["features"].to_pylist(), dtype=np.float64))) @ own.root
                    z = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([z if c == "features" else part[c] for c in part.schema.names], part.schema.names)

        return rows.mapInArrow(run, schema)

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.model.predict(self._lift(rows)).select("id", "y_pred", "scores"), "id")

    def objective(self) -> float:
        w, problems = self.model.coef, self.problems

        def losses(z: np.ndarray, labels: np.ndarray) -> np.ndarray:
            m = np.stack([np.where(np.isin(labels, p.positive), 1.0, -1.0) for p in problems]) * (z @ w[:, :-1].T + w[:, -1]).T
            return np.array([(np.maximum(1 - m, 0) ** 2).sum()])

        return float(0.5 * (w * w).sum() + self.c * _sum_cells(self.lifted, losses, ["features", "label"])[0])


FACTORIES["linear"] = lambda rows: fit_linear(rows, "squared_hinge", 1.0, balanced=False)
FACTORIES["lifted"] = Lifted
FACTORIES["rbf"] = Kernel
FACTORIES["rbf0.01"] = lambda rows: Kernel(rows, 0.01)
FACTORIES["rbf0.1"] = lambda rows: Kernel(rows, 0.1)
FACTORIES["rbf1"] = lambda rows: Kernel(rows, 1.0)


class Pipeline:
    """Fill, scale, augment, balance, classify: everything is learnt from the training rows alone.

    Missing features (null or NaN) become the training rows' medians; scaled features get the
    principal components of the selected ones (the 50 with most mutual information, of these
    recursive elimination to ``keep``) beside them; training rows are oversampled and edited, rows to be predicted never are.
    """

    def __init__(self, rows: DataFrame, name: str = "svc", augment: bool = True, smote: bool = True, keep: int = 30, components: int = 5, keep_mutual: int = 50):
        d = rows.select(F.size("features")).first()[0]
        cells = rows.select(F.posexplode("features").alias("i", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        self.medians = {r["i"]: r["q"][0] for r in quantiles(cells, "i", "v", [0.5]).collect()}
        self.medians = [self.medians.get(i, 0.0) for i in range(d)]
        filled = self._filled(rows)
        self.scaler = Scaler.fit(filled)
        ready = materialize(self._scaled(filled).select("id", "label", "features"), "train")
        self.left, self.extend = list(range(d)), None
        if augment:
            if d > keep_mutual:
                self.left = sorted(r["feature"] for r in neighbour_information(ready, keep=keep_mutual).collect())
            self.left = [self.left[i] for i in selected(self._chosen(ready), keep)]
            self.extend = principal_components(self._chosen(ready), min(components, max(len(self.left) - 1, 0))) if len(self.left) > 1 else None
            ready = self._augmented(ready)
        if smote:
            ready = balance.balanced(ready)
        self.model = FACTORIES[name](materialize(ready.select("id", "label", "features"), "balanced"))

    def _filled(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("features", F.zip_with("features", F.array(*map(F.lit, self.medians)), lambda x, m: F.when(x.isNull() | F.isnan(x), m).otherwise(x)))

    def _scaled(self, rows: DataFrame) -> DataFrame:
        mean, scale = (F.array(*map(F.lit, x.tolist())) for x in (self.scaler.mean, self.scaler.scale))
        return rows.withColumn("features", F.zip_with(F.zip_with("features", mean, lambda a, b: a - b), scale, lambda a, b: a / b))

    def _chosen(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("features", F.array(*(F.col("features")[i] for i in self.left)))

    def _augmented(self, rows: DataFrame) -> DataFrame:
        if self.extend is None:
            return rows
        n = len(self.left)
        more = self.extend(self._chosen(rows.withColumn("_whole", F.col("features"))))
        return more.withColumn("features", F.concat("_whole", F.slice("features", n + 1, F.size("features") - n))).drop("_whole")

    def predict(self, rows: DataFrame) -> DataFrame:
        ready = self._scaled(self._filled(rows))
        return self.model.predict(self._augmented(ready) if self.extend else ready)


FACTORIES["pipeline"] = Pipeline
FACTORIES["plain_pipeline"] = lambda rows: Pipeline(rows, augment=False, smote=False)


def components_of(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, loadings) of the k first principal components of rows, a row of loadings each.

    Moments are taken about a first mean.  Signs are pinned: each component's largest loading is positive.
    """
    first = Scaler.fit(rows).mean
    s = _sum_cells(rows, lambda x, _: np.concatenate([[len(x)], (x - first).sum(axis=0), ((x - first).T @ (x - first)).ravel()]), ["features", "label"])
    d = len(first)
    mean = s[1 : d + 1] / s[0]
    _, v = np.linalg.eigh(s[d + 1 :].reshape(d, d) / s[0] - np.outer(mean, mean))
    v = v[:, ::-1][:, : min(k, d - 1)]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return first + mean, v.T


def principal_components(rows: DataFrame, k: int = 5) -> Callable[[DataFrame], DataFrame]:
    """Learn k components from rows; the result appends them to the features of any rows."""
    mean, loadings = components_of(rows, k)

    def extend(more: DataFrame) -> DataFrame:
        part = [F.aggregate(F.zip_with("features", F.array(*map(F.lit, c.tolist())), lambda a, b: a * b), F.lit(float(-(mean @ c))), lambda t, x: t + x) for c in loadings]
        return more.withColumn("features", F.concat("features", F.array(*part)))

    return extend


def selected(rows: DataFrame, keep: int = 30) -> list[int]:
    """Recursive elimination: features whose squared weights sum to least go one by one.

    Each fit starts from the one before without the feature that went.  Nothing is fitted if
    there are no more features than asked for.
    """
    d = rows.select(F.size("features")).first()[0]
    left, start = list(range(d)), None
    if d <= keep:
        return left
    counts, whole = label_counts(rows), Scaler.fit(rows)
    while len(left) > keep:
        scaler = Scaler(whole.mean[left], whole.scale[left])
        model = fit_linear(rows.withColumn("features", F.array(*(F.col("features")[i] for i in left))), start=start, counts=counts, scaler=scaler)
        worst = int((model.coef[:, :-1] ** 2).sum(axis=0).argmin())
        left.pop(worst)
        start = np.delete(model.coef, worst, axis=1)
    return left


def evaluate(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """(clf, acc, f1_weighted, f1_macro) of one classifier on held-out rows."""
    pred = FACTORIES[name](train).predict(test).select(F.lit(name).alias("clf"), F.col("label").alias("y_true"), "y_pred")
    return evaluation.scores(evaluation.confusion(pred, ["clf"]), ["clf"])


#: Fits that go on at the same time: each is a row of small jobs that leave most of a cluster idle.
PARALLEL = 8


def in_parallel(spark: SparkSession, tasks: list[Callable[[], object]], at_once: int = PARALLEL) -> list:
    """Results of functions that start Spark jobs, run by threads of the driver, in order."""
    with ThreadPool(min(at_once, max(1, len(tasks)))) as pool:
        return pool.map(lambda task: inheritable_thread_target(spark)(task)(), tasks, chunksize=1)


def _fold_rows(rows: DataFrame, table: DataFrame, plans: dict[str, tuple[str, list[int] | None]]) -> list[tuple]:
    """(key, fold, acc, f1_weighted, f1_macro) for every plan (classifier, features or all) and fold; folds are rows of ``table``."""
    tagged = materialize(rows.join(table, "group"), "tagged")  # each fold's models read it many times
    folds = sorted(r["fold"] for r in table.select("fold").distinct().collect())

    def one(key: str, fold: int) -> tuple:
        name, own = plans[key]
        part = tagged if own is None else tagged.withColumn("features", F.array(*(F.col("features")[i] for i in own)))
        got = evaluate(part.where(F.col("fold") != fold).drop("fold"), part.where(F.col("fold") == fold).drop("fold"), name).first()
        return (key, fold, *((got["acc"], got["f1_weighted"], got["f1_macro"]) if got else (None, None, None)))

    return in_parallel(rows.sparkSession, [functools.partial(one, key, fold) for key in plans for fold in folds])


def cross_validate(rows: DataFrame, name: str, folds: int = 5, table: DataFrame | None = None) -> DataFrame:
    """(clf, fold, acc, f1_weighted, f1_macro) over group-disjoint folds; pass ``table`` to share folds."""
    return fold_scores(rows, [name], folds, table)


def ablation(rows: DataFrame, families: dict[str, list[int]], name: str = "svc", folds: int = 5) -> DataFrame:
    """(key, f1_weighted, delta): all families, each one dropped, and each one alone."""
    table = materialize(sampling.group_folds(rows, "group", folds), "folds")
    whole = sorted(i for own in families.values() for i in own)
    plans = {"all": whole} | {f"drop_{f}": [i for i in whole if i not in own] for f, own in families.items()} | {f"only_{f}": own for f, own in families.items()}
    found = _fold_rows(rows, table, {k: (name, own) for k, own in plans.items()})
    mean = {k: float(np.mean([r[3] for r in found if r[0] == k and r[3] is not None])) for k in plans}
    return rows.sparkSession.createDataFrame([(k, v, v - mean["all"]) for k, v in mean.items()], "key string, f1_weighted double, delta double")


def leakage_stress(train: DataFrame, test: DataFrame, name: str = "svc") -> DataFrame:
    """Group-disjoint scores beside those of a stratified random split of all rows (which leaks groups)."""
    order = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 40))
    parts = sampling.stratified_split(train.unionByName(test), "label", 0.2, [order, F.col("id")])
    safe = evaluate(train, test, name).withColumn("protocol", F.lit("disjoint"))
    return safe.unionByName(evaluate(parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part"), name).withColumn("protocol", F.lit("random")))


def fold_scores(rows: DataFrame, names: list[str], folds: int = 5, table: DataFrame | None = None) -> DataFrame:
    """Cross-validated scores of several classifiers on the same folds."""
    table = materialize(sampling.group_folds(rows, "group", folds), "folds") if table is None else table
    found = _fold_rows(rows, table, {name: (name, None) for name in names})
    return rows.sparkSession.createDataFrame([(k, a, w, m, f) for k, f, a, w, m in found], "clf string, acc double, f1_weighted double, f1_macro double, fold int")


def gaps(scored: DataFrame, base: str = "linear", name: str = "acc") -> DataFrame:
    """Per classifier: its mean score, the mean gap over the base's on the same folds, sd and 95 % interval, and paired p's.

    scored has a row per classifier and fold, a few dozen.
    """
    own = scored.select("clf", "fold", evaluation.metric(name).alias("s"))
    both = own.where(F.col("clf") != base).join(own.where(F.col("clf") == base).select("fold", F.col("s").alias("b")), "fold").withColumn("gap", F.col("s") - F.col("b"))
    means = both.groupBy("clf").agg(F.avg("s").alias("score"), F.avg("b").alias("base_score"))
    spread = evaluation.fold_summary(both, ["clf"], "gap").select("clf", F.col("mean").alias("gap"), F.col("sd").alias("gap_sd"), "n", "ci_low", "ci_high")
    tests = paired_tests(scored, name)
    tests = tests.select(F.when(F.col("clf_a") == base, F.col("clf_b")).otherwise(F.col("clf_a")).alias("clf"), F.lit(base).alias("_base"), "clf_a", "clf_b", F.col("p").alias("p_t"), "p_wilcoxon")
    tests = tests.where((F.col("clf_a") == base) | (F.col("clf_b") == base)).select("clf", "p_t", "p_wilcoxon")
    return means.join(spread, "clf").join(tests, "clf")


def marginal(rows: DataFrame, families: dict[str, list[int]], costly: str = "graph", cheap: str = "hrv", name: str = "svc", folds: int = 5) -> DataFrame:
    """(key, f1_weighted): all families, without the costly one, without both, and the gains between these."""
    table = materialize(sampling.group_folds(rows, "group", folds), "folds")
    configs = {"full": set(families), "no_costly": set(families) - {costly}, "no_costly_no_cheap": set(families) - {costly, cheap}}
    plans = {key: (name, sorted(i for f in keep for i in families[f])) for key, keep in configs.items()}
    scored = _fold_rows(rows, table, {k: v for k, v in plans.items() if v[1]})
    found = {k: float(np.mean([r[3] for r in scored if r[0] == k and r[3] is not None] or [np.nan])) for k in plans}
    found["marginal_costly_given_cheap"] = found["full"] - found["no_costly"]
    found["gain_of_cheap_alone"] = found["no_costly"] - found["no_costly_no_cheap"]
    return rows.sparkSession.createDataFrame(list(found.items()), "key string, f1_weighted double")


def mutual_information(rows: DataFrame, bins: int = 16, keep: int = 50) -> DataFrame:
    """(feature, mi, rank): features by the mutual information of their equally full bins with the label, the best ``keep``.

    Bins lie between exact quantiles; all the rest is counts of (feature, bin, label).
    """
    cells = rows.select("label", F.posexplode("features").alias("feature", "x"))
    cuts = quantiles(cells, "feature", "x", [i / bins for i in range(1, bins)])
    binned = cells.join(F.broadcast(cuts), "feature").withColumn("bin", F.size(F.filter("q", lambda c: c < F.col("x"))))  # a row per feature
    n = binned.groupBy("feature", "bin", "label").agg(F.count(F.lit(1)).alias("n"))
    sums = {k: n.groupBy(*k).agg(F.sum("n").alias("s")) for k in (("feature", "bin"), ("feature", "label"), ("feature",))}
    out = n
    for i, (k, s) in enumerate(sums.items()):
        out = out.join(s.withColumnRenamed("s", f"_s{i}"), list(k))
    mi = out.groupBy("feature").agg(F.sum(F.col("n") / F.col("_s2") * F.log(F.col("n") * F.col("_s2") / (F.col("_s0") * F.col("_s1")))).alias("mi"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("mi").desc(), "feature"))  # features only
    return mi.withColumn("rank", place).where(F.col("rank") <= keep)


def digamma(x: F.Column) -> F.Column:
    """The digamma function of a positive number: its asymptotic series eight steps further up."""
    y = x + 8.0
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - 1 / (252 * y * y * y * y * y * y)
    return series - sum((1 / (x + float(i)) for i in range(1, 8)), 1 / x)


def _kth_neighbours(cells: DataFrame, k: int, block: int) -> DataFrame:
    """cells (id, feature, label, x) with n, the size of their (feature, label), and near, the value of the min(k, n - 1)-th nearest of its other cells.

    Cells are ranked within (feature, label) exactly, cut into blocks of ``block`` ranks, and
    the k cells at either side of a block go along with it: no task gets more.
    """
    cells = cells.withColumn("own", F.concat_ws(" ", "feature", F.col("label").cast("string")))
    placed = ranked(cells, "own", slice_of(F.col("x"), cut_points(cells, "x")), [F.col("x"), F.col("id")]).withColumnRenamed("_total", "n")
    placed = placed.withColumn("_to", F.explode(F.sequence(F.floor(F.greatest(F.col("_rank") - k, F.lit(0)) / block), F.floor((F.col("_rank") + k) / block))))
    w = Window.partitionBy("own", "_to").orderBy("_rank")
    around = [F.struct(F.abs(f("x", j).over(w) - F.col("x")).alias("d"), f("x", j).over(w).alias("v")) for f in (F.lead, F.lag) for j in range(1, k + 1)]
    near = F.sort_array(F.filter(F.array(*around), lambda s: s["d"].isNotNull()))
    there = placed.withColumn("near", F.get(near, (F.least(F.lit(k), F.col("n") - 1) - 1).cast("int"))["v"])
    return there.where(F.floor(F.col("_rank") / block) == F.col("_to")).select("id", "feature", "label", "x", "n", "near")


def neighbour_information(rows: DataFrame, k: int = 3, keep: int = 50, block: int = 50_000) -> DataFrame:
    """(feature, mi, rank): features by their mutual information with the label, estimated by nearest neighbours; the best ``keep``.

    A row's radius in a feature is the distance to its k-th nearest row of its own label (fewer if the
    label has no more), m the rows of any label within less than that, itself
    included, or those of the same value if the radius is 0.  mi = psi(rows) + mean psi(k) -
    mean psi(rows of the label) - mean psi(m), not below 0, over rows whose label is not
    alone.  Features are finite; rows have unique ids.  All is exact, by ranks and running counts.
    """
    cells = materialize(rows.select("id", "label", F.posexplode("features").alias("feature", "x")).withColumn("x", F.col("x") + 0.0), "cells")
    found = materialize(_kth_neighbours(cells, k, block).where("n > 1"), "kth")
    r, x, near = F.abs(F.col("near") - F.col("x")), F.col("x"), F.col("near")
    asked = found.withColumns({"lo": F.when(near < x, near).otherwise(x - r), "hi": F.when(near > x, near).otherwise(x + r)})
    points = cells.select("feature", F.col("x").alias("t"), F.lit(1).alias("c")).unionByName(
        asked.select("feature", F.explode(F.array("lo", "hi")).alias("t"), F.lit(0).alias("c")))
    # values and bounds of a feature, once each, with how many values are as large or larger
    counts = materialize(running_sums(points.groupBy("feature", "t").agg(F.sum("c").alias("c")), "feature", "t", ["c"]), "counts")
    at = lambda t, ge, c: counts.select("feature", F.col("t").alias(t), F.col("cum_c").alias(ge), F.col("c").alias(c))
    met = asked.join(at("lo", "_ge", "_eq"), ["feature", "lo"]).join(at("hi", "_gh", "_eh"), ["feature", "hi"])
    m = F.when(r == 0, F.col("_eq")).otherwise(F.col("_ge") - F.col("_eq") - F.col("_gh"))
    terms = digamma(F.least(F.lit(k), F.col("n") - 1).cast("double")) - digamma(F.col("n").cast("double")) - digamma(m.cast("double"))
    mi = met.groupBy("feature").agg(F.greatest(F.lit(0.0), digamma(F.count(F.lit(1)).cast("double")) + F.avg(terms)).alias("mi"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("mi").desc(), "feature"))  # features only
    return mi.withColumn("rank", place).where(F.col("rank") <= keep)


def random_fourier(rows: DataFrame, gamma: float, features: int = 200, seed: int = 42) -> DataFrame:
    """Features whose inner products approximate an RBF kernel: a linear model on them stands in for an RBF machine."""
    d = rows.select(F.size("features")).first()[0]
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(d, features)), rng.uniform(0, 2 * np.pi, features)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lift(x):
        import pandas as pd

        return pd.Series(list(np.sqrt(2 / features) * np.cos(np.stack(x.to_numpy()) @ w + b)))

    return rows.withColumn("features", lift("features"))


def paired_tests(folds: DataFrame, metric: str = "f1_weighted") -> DataFrame:
    """For each pair of classifiers on the same folds: mean difference, paired t and signed-rank p, Holm-adjusted.

    folds has one row per classifier and fold, a table of a few dozen rows.
    """
    from ..functions import stats

    rows = folds.select("clf", "fold", metric).collect()
    by = {}
    for r in rows:
        by.setdefault(r["clf"], {})[r["fold"]] = r[metric]
    out = []
    for a in sorted(by):
        for b in sorted(x for x in by if x > a):
            x, y = zip(*((by[a][f], by[b][f]) for f in sorted(by[a])), strict=True)
            t, p = stats.paired_t(list(x), list(y))
            _, pw = stats.wilcoxon([u - v for u, v in zip(x, y, strict=True)])
            out.append((a, b, sum(x) / len(x) - sum(y) / len(y), t, p, pw))
    tests = folds.sparkSession.createDataFrame(out, "clf_a string, clf_b string, mean_diff double, t double, p double, p_wilcoxon double")
    return evaluation.holm(tests, "p", "clf_a", "clf_b")
