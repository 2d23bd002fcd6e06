"""Estimators compose, save, load in another process and cross-validate like Spark's own."""

import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from isochron.operators import learning
from isochron.operators.estimators import ArrayClassifier, ArrayClassifierModel, ArrayScaler, FeatureAugmenter, MedianImputer, ScoreEvaluator

from .conftest import ROOT

LOADER = """
import sys, json
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from pyspark.ml import PipelineModel
rows = PipelineModel.load(sys.argv[1]).transform(spark.read.parquet(sys.argv[2])).select("id", "y_pred", "scores").collect()
print("ROWS", json.dumps(sorted([r["id"], r["y_pred"], r["scores"]] for r in rows)))
"""


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    data = []
    for i in range(240):
        k = "NSV"[i % 3 if i % 4 else 0]
        x = rng.normal(size=7) * 1.5 + 1e6
        x[:3] += 6.0 * np.eye(3)["NSV".index(k)]
        data.append((i, i % 6, k, [None if (i + j) % 29 == 0 else float("nan") if (i * j) % 31 == 5 else float(v) for j, v in enumerate(x)], i % 3))
    return spark.createDataFrame(data, "id long, group long, label string, features array<double>, fold int").repartition(3).persist()


def stages(name, **more):
    return Pipeline(stages=[MedianImputer(), ArrayScaler(), FeatureAugmenter(keep=4, components=2), ArrayClassifier(name=name, **more)])


@pytest.mark.parametrize("name,smote", [("svc", True), ("lr", False), ("dt", False), ("mlp", False)])
def test_a_saved_pipeline_predicts_alike(spark, rows, tmp_path, name, smote):
    model = stages(name, smote=smote).fit(rows)
    want = model.transform(rows.drop("label")) if name in ("svc", "lr") else model.transform(rows)
    want = {r["id"]: r for r in want.collect()}
    truth = {r["id"]: r["label"] for r in rows.collect()}
    assert sum(want[i]["y_pred"] == k for i, k in truth.items()) > 0.85 * len(truth)
    assert all(len(r["scores"]) == 3 and len(r["features"]) == 9 for r in want.values())
    assert all(r["y_pred"] == model.stages[-1].classes[int(np.argmax(r["scores"]))] for r in want.values())
    model.write().overwrite().save(str(tmp_path / "model"))
    again = {r["id"]: r for r in PipelineModel.load(str(tmp_path / "model")).transform(rows).collect()}
    assert all(again[i]["y_pred"] == r["y_pred"] and again[i]["scores"] == pytest.approx(r["scores"], abs=1e-9) for i, r in want.items())
    if name == "svc":  # in a session of its own
        rows.write.parquet(str(tmp_path / "rows"))
        done = subprocess.run([sys.executable, "-c", LOADER, str(tmp_path / "model"), str(tmp_path / "rows")], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert "ROWS" in done.stdout, done.stderr[-2000:]
        for i, pred, scores in json.loads(done.stdout.split("ROWS", 1)[1]):
            assert want[i]["y_pred"] == pred and want[i]["scores"] == pytest.approx(scores, abs=1e-9)


def test_cross_validation_over_given_folds(spark, rows, tmp_path):
    short = lambda: Pipeline(stages=[MedianImputer(), ArrayScaler(), ArrayClassifier(name="lr")])
    pipeline = short()
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].name, ["lr", "dt"]).build()
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=ScoreEvaluator(metricName="acc"), foldCol="half", numFolds=2)
    rows = rows.withColumn("half", F.col("fold") % 2)
    model = cv.fit(rows)
    by_hand = []
    for fold in range(2):
        fitted = short().fit(rows.where(F.col("half") != fold))
        by_hand.append(fitted.transform(rows.where(F.col("half") == fold)).agg(F.avg((F.col("label") == F.col("y_pred")).cast("int"))).first()[0])
    assert model.avgMetrics[0] == pytest.approx(np.mean(by_hand), abs=1e-9)
    model.write().overwrite().save(str(tmp_path / "cv"))
    assert CrossValidatorModel.load(str(tmp_path / "cv")).avgMetrics == pytest.approx(model.avgMetrics)


def test_estimators_keep_their_params(rows, tmp_path):
    made = ArrayClassifier(name="lr", smote=True)
    made.write().overwrite().save(str(tmp_path / "e"))
    again = ArrayClassifier.load(str(tmp_path / "e"))
    assert again.getOrDefault("name") == "lr" and again.getOrDefault("smote") is True and again.uid == made.uid
    with pytest.raises(ValueError, match="no classifier"):
        ArrayClassifier(name="oracle")
    filled = MedianImputer().fit(rows).transform(rows)
    fitted = ArrayClassifier(name="knn").fit(filled)
    out = fitted.transform(filled).collect()
    assert all(sum(r["scores"]) == pytest.approx(1) and r["y_pred"] == fitted.classes[int(np.argmax(r["scores"]))] for r in out)
    with pytest.raises(Exception, match="cannot be saved"):
        fitted.save(str(tmp_path / "knn"))
    assert issubclass(ArrayClassifierModel, object)


def test_scales_and_components_of_large_means(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([1e9 + rng.normal(size=400) * 0.003, 1e5 + rng.normal(size=400) * 3e-4, rng.normal(size=400), np.full(400, 0.1)])
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>").repartition(5)
    scaler = learning.Scaler.fit(table)
    assert scaler.scale[:3] == pytest.approx(x.std(axis=0)[:3], rel=1e-3) and scaler.scale[3] == 1.0
    mean, loadings = learning.components_of(table, 2)
    v = np.linalg.svd(x - x.mean(axis=0))[2]
    assert mean == pytest.approx(x.mean(axis=0)) and np.abs(loadings[0] @ v[0]) == pytest.approx(1, abs=1e-6)


def test_all_classifiers_give_scores(spark, rows):
    filled = MedianImputer().fit(rows).transform(rows)
    for name in ("rf", "rbf"):
        out = ArrayClassifier(name=name).fit(filled)
        got = out.transform(filled).collect()
        assert len(got) == 240 and all(r["y_pred"] == out.classes[int(np.argmax(r["scores"]))] for r in got)


def plain_information(x, y, k=3):
    """The estimator by its definition, feature by feature."""
    from math import inf

    def psi(m):
        return -0.5772156649015329 + sum(1 / i for i in range(1, m))

    out = []
    for v in np.asarray(x).T:
        terms, n = [], 0
        for i in range(len(v)):
            same = sorted((abs(v[j] - v[i]), v[j]) for j in range(len(v)) if j != i and y[j] == y[i])
            if not same:
                continue
            r, near = same[min(k, len(same)) - 1]
            lo, hi = (near if near < v[i] else v[i] - r), (near if near > v[i] else v[i] + r)
            m = int((v == v[i]).sum()) if r == 0 else int(((v > lo) & (v < hi)).sum())
            terms.append(psi(min(k, len(same))) - psi(len(same) + 1) - psi(m))
            n += 1
        out.append(max(0.0, psi(n) + np.mean(terms)) if n else -inf)
    return out


@pytest.mark.parametrize("block", [7, 50_000])
def test_information_by_neighbours(spark, block):
    rng = np.random.default_rng(4)
    y = ["a"] * 90 + ["b"] * 50 + ["c"] * 3 + ["alone"]
    shift = np.array([{"a": 0.0, "b": 2.0, "c": 5.0, "alone": 9.0}[k] for k in y])
    x = np.column_stack([rng.normal(size=144) + shift, rng.integers(0, 4, 144) * 1.0, rng.normal(size=144), np.zeros(144), np.round(rng.normal(size=144) + shift)])
    table = spark.createDataFrame([(i, k, v.tolist()) for i, (k, v) in enumerate(zip(y, x, strict=True))], "id long, label string, features array<double>").repartition(4)
    got = {r["feature"]: (r["mi"], r["rank"]) for r in learning.neighbour_information(table, block=block).collect()}
    want = plain_information(x, y)
    assert [got[i][0] for i in range(5)] == pytest.approx(want, abs=1e-9)
    assert sorted(v[1] for v in got.values()) == [1, 2, 3, 4, 5] and got[int(np.argmax(want))][1] == 1


def test_fifty_of_a_wider_table_are_selected(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 160)
    x = rng.normal(size=(160, 60))
    x[:, 7] += 4 * y
    table = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x, strict=True))], "id long, label long, features array<double>").repartition(2)
    best = [r["feature"] for r in learning.neighbour_information(table, keep=50).collect()]
    assert len(best) == 50 and 7 in best
    model = FeatureAugmenter(keep=49, components=3).fit(table)
    assert len(model.chosen) == 49 and 7 in model.chosen.tolist() and set(model.chosen.tolist()) <= set(best)
    assert len(model.transform(table).first()["features"]) == 63


def test_the_kernel_machine_reaches_the_optimum_of_the_dual(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    y = np.where((x**2).sum(axis=1) + 0.3 * rng.normal(size=500) > 2.4, 1, 0)
    table = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x, strict=True))], "id long, label long, features array<double>").repartition(3)
    c, gamma = 1.0, 0.5
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    kernel = np.exp(-gamma * ((z[:, None] - z[None]) ** 2).sum(axis=2)) + 1.0  # the intercept is a further feature of 1
    # squared hinge: maximise sum a - 1/2 a' (yKy + I / 2c) a over a >= 0, by coordinates
    s = np.where(y == 1, 1.0, -1.0)
    q = kernel * np.outer(s, s) + np.eye(500) / (2 * c)
    a, slope = np.zeros(500), -np.ones(500)
    for _ in range(300):
        for i in range(500):
            step = max(-a[i], -slope[i] / q[i, i])
            a[i] += step
            slope += step * q[:, i]
    dual = a.sum() - 0.5 * a @ q @ a
    whole = learning.Kernel(table, gamma, c, landmarks=500)
    assert dual <= whole.objective() / 2 < dual * 1.01  # any dual value lies below the optimum; both classes' problems mirror each other
    few = learning.Kernel(table, gamma, c, landmarks=150)
    assert whole.objective() * (1 - 1e-9) <= few.objective() < whole.objective() * 1.01
    right = few.predict(table).agg(F.avg((F.col("label") == F.col("y_pred")).cast("int"))).first()[0]
    assert right > 0.93 > learning.fit_linear(table).predict(table).agg(F.avg((F.col("label") == F.col("y_pred")).cast("int"))).first()[0]


def test_sums_of_tasks_in_one_or_two_levels(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (300, 4)).astype(float)
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>").repartition(23)
    for few in (64, 0):
        monkeypatch.setattr(learning, "FEW_TASKS", few)
        monkeypatch.setattr(learning, "CELLS", 3)
        found = learning._sum_cells(table, lambda x, _: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]), ["features", "label"])
        assert found.tolist() == [300.0, *x.sum(axis=0), *(x.T @ x).ravel()]
