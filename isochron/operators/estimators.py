"""Spark ML estimators over arrays of features: fitted, composed, cross-validated, saved and loaded like any others.

    Pipeline(stages=[MedianImputer(), ArrayScaler(), FeatureAugmenter(keep=30), ArrayClassifier(name="svc")])

Rows have an id, a label of any plain type and an array of doubles.  Everything that a stage
learns comes from the rows it is fitted on; balancing belongs to the classifier, since rows to
be predicted are never resampled.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import balance, evaluation, learning
from .windows import quantiles


class _Writer(MLWriter):
    def __init__(self, instance: _Fitted):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        arrays, facts = self.instance._state()
        shapes = {k: list(np.shape(v)) for k, v in arrays.items()}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"facts": json.dumps({"shapes": shapes, **facts})})
        rows = [(k, np.asarray(v, dtype=float).ravel().tolist()) for k, v in arrays.items()]
        self.sparkSession.createDataFrame(rows, "name string, x array<double>").coalesce(1).write.parquet(f"{path}/arrays")
        if self.instance._inner() is not None:
            self.instance._inner().write().session(self.sparkSession).save(f"{path}/model")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _Fitted:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        facts = json.loads(meta["facts"])
        rows = {r["name"]: r["x"] for r in self.sparkSession.read.parquet(f"{path}/arrays").collect()}
        arrays = {k: np.array(rows[k]).reshape(shape) for k, shape in facts["shapes"].items()}
        out = self.cls._restored(arrays, facts, f"{path}/model")
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


class _Fitted(Model, HasFeaturesCol, HasLabelCol, MLReadable, MLWritable):
    """A model whose state is a few arrays and plain facts, and perhaps a model of Spark's own."""

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)

    def _inner(self):
        return None

    def _with(self, column: Column, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getFeaturesCol(), column)


def _given(values: np.ndarray) -> Column:
    return F.array(*map(F.lit, np.asarray(values, dtype=float).tolist()))


class MedianImputer(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Missing features (null or NaN) become the exact medians of the rows it was fitted on, 0 where there are none."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        name = self.getFeaturesCol()
        d = dataset.select(F.max(F.size(name))).first()[0] or 0
        cells = dataset.select(F.posexplode(name).alias("i", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        found = {r["i"]: r["q"][0] for r in quantiles(cells, "i", "v", [0.5]).collect()}
        return self._copyValues(MedianImputerModel(np.array([found.get(i, 0.0) for i in range(d)])))


class MedianImputerModel(_Fitted):
    def __init__(self, medians: np.ndarray):
        super().__init__()
        self.medians = medians

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._with(F.zip_with(self.getFeaturesCol(), _given(self.medians), lambda x, m: F.when(x.isNull() | F.isnan(x), m).otherwise(x)), dataset)

    def _state(self):
        return {"medians": self.medians}, {}

    @classmethod
    def _restored(cls, arrays, facts, path):
        return cls(arrays["medians"])


class ArrayScaler(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Features less their means, over their standard deviations (1 for a constant one)."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ArrayScalerModel:
        rows = dataset.select(F.col(self.getFeaturesCol()).alias("features"), F.lit(0).alias("label"))
        scaler = learning.Scaler.fit(rows)
        return self._copyValues(ArrayScalerModel(scaler.mean, scaler.scale))


class ArrayScalerModel(_Fitted):
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        super().__init__()
        self.mean, self.scale = mean, scale

    def _transform(self, dataset: DataFrame) -> DataFrame:
        centred = F.zip_with(self.getFeaturesCol(), _given(self.mean), lambda a, b: a - b)
        return self._with(F.zip_with(centred, _given(self.scale), lambda a, b: a / b), dataset)

    def _state(self):
        return {"mean": self.mean, "scale": self.scale}, {}

    @classmethod
    def _restored(cls, arrays, facts, path):
        return cls(arrays["mean"], arrays["scale"])


class FeatureAugmenter(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """All features, and beside them the principal components of some: the ``keepMutual`` with most mutual
    information with the label, and of these the ``keep`` that recursive elimination leaves."""

    keepMutual = Param(Params._dummy(), "keepMutual", "features that mutual information leaves", TypeConverters.toInt)
    keep = Param(Params._dummy(), "keep", "features that recursive elimination leaves", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "principal components that are added", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", keepMutual: int = 50, keep: int = 30, components: int = 5):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", keepMutual=50, keep=30, components=5)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeatureAugmenterModel:
        label, features = F.col(self.getLabelCol()).alias("label"), F.col(self.getFeaturesCol()).alias("features")
        rows = materialize(dataset.select(F.monotonically_increasing_id().alias("id"), label, features), "augment")
        d = rows.select(F.max(F.size("features"))).first()[0] or 0
        chosen = list(range(d))
        if d > self.getOrDefault(self.keepMutual):
            chosen = sorted(r["feature"] for r in learning.neighbour_information(rows, keep=self.getOrDefault(self.keepMutual)).collect())
        pick = lambda own: rows.withColumn("features", F.array(*(F.col("features")[i] for i in own)))
        chosen = [chosen[i] for i in learning.selected(pick(chosen), self.getOrDefault(self.keep))] if chosen else []
        k = min(self.getOrDefault(self.components), len(chosen) - 1)
        mean, loadings = learning.components_of(pick(chosen), k) if k > 0 else (np.zeros(len(chosen)), np.zeros((0, len(chosen))))
        return self._copyValues(FeatureAugmenterModel(np.array(chosen, dtype=int), mean, loadings))


class FeatureAugmenterModel(_Fitted):
    def __init__(self, chosen: np.ndarray, mean: np.ndarray, loadings: np.ndarray):
        super().__init__()
        self.chosen, self.mean, self.loadings = chosen, mean, loadings

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getFeaturesCol()
        own = [F.get(F.col(name), F.lit(int(i))) for i in self.chosen]
        more = [sum((x * float(c) for x, c in zip(own, row, strict=True)), F.lit(float(-(self.mean @ row)))) for row in self.loadings]
        return self._with(F.concat(name, F.array(*more)), dataset) if more else dataset

    def _state(self):
        return {"chosen": self.chosen, "mean": self.mean, "loadings": self.loadings}, {}

    @classmethod
    def _restored(cls, arrays, facts, path):
        return cls(arrays["chosen"].astype(int), arrays["mean"], arrays["loadings"])


class ArrayClassifier(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """A classifier by its name in ``learning.FACTORIES``; ``smote`` balances its training rows first (they need an id)."""

    name = Param(Params._dummy(), "name", "which classifier", TypeConverters.toString)
    smote = Param(Params._dummy(), "smote", "oversample and edit the training rows", TypeConverters.toBoolean)
    idCol = Param(Params._dummy(), "idCol", "a key of the rows", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", idCol: str = "id", name: str = "svc", smote: bool = False):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", idCol="id", name="svc", smote=False)
        self._set(**self._input_kwargs)
        if self.getOrDefault(self.name) not in learning.FACTORIES:
            raise ValueError(f"no classifier {name}; there are {', '.join(learning.FACTORIES)}")

    def _fit(self, dataset: DataFrame) -> ArrayClassifierModel:
        id_, label, features = (self.getOrDefault(c) for c in (self.idCol, self.labelCol, self.featuresCol))
        rows = dataset.select(F.col(id_).alias("id"), F.col(label).alias("label"), F.col(features).alias("features"))
        rows = balance.balanced(materialize(rows, "train")) if self.getOrDefault(self.smote) else rows
        return self._copyValues(ArrayClassifierModel(learning.FACTORIES[self.getOrDefault(self.name)](materialize(rows, "train"))))


class ArrayClassifierModel(_Fitted):
    """Adds y_pred, of the label's type, and the array scores, in the order of ``classes``.

    Linear classifiers, trees and perceptrons can be saved; neighbours, which are their
    training rows, and lifted ones cannot.
    """

    name, smote, idCol = ArrayClassifier.name, ArrayClassifier.smote, ArrayClassifier.idCol

    def __init__(self, model):
        super().__init__()
        self.model = model

    @property
    def classes(self) -> list:
        return self.model.classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        plain = {"id": self.getOrDefault(self.idCol), "features": self.getFeaturesCol()}
        rows = dataset.drop("y_pred", "scores").withColumnsRenamed({v: k for k, v in plain.items() if v != k})
        return self.model.predict(rows).withColumnsRenamed({k: v for k, v in plain.items() if v != k})

    def _inner(self):
        return None if isinstance(self.model, learning.Linear) else self.model.model

    def _state(self):
        kind, facts = type(self.model).__name__, {"classes": [c.item() if hasattr(c, "item") else c for c in self.model.classes]}
        if isinstance(self.model, learning.Linear):
            return {"mean": self.model.scaler.mean, "scale": self.model.scaler.scale, "coef": self.model.coef}, facts | {"kind": kind}
        if isinstance(self.model, learning.Forest):
            return {}, facts | {"kind": kind, "inner": type(self.model.model).__name__}
        if isinstance(self.model, learning.Perceptron):
            return {"mean": self.model.scaler.mean, "scale": self.model.scaler.scale}, facts | {"kind": kind, "inner": type(self.model.model).__name__}
        raise ValueError(f"a model of the kind {kind} cannot be saved")

    @classmethod
    def _restored(cls, arrays, facts, path):
        from pyspark.ml import classification

        kind = getattr(learning, facts["kind"])
        model = kind.__new__(kind)
        model.classes = facts["classes"]
        if "mean" in arrays:
            model.scaler = learning.Scaler(arrays["mean"], arrays["scale"])
        if "coef" in arrays:
            model.coef = arrays["coef"]
        if "inner" in facts:
            model.model = getattr(classification, facts["inner"]).load(path)
        return cls(model)


class ScoreEvaluator(Evaluator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """acc, f1_weighted or f1_macro of y_pred, by grouped counts; larger is better."""

    metricName = Param(Params._dummy(), "metricName", "acc, f1_weighted or f1_macro", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", metricName: str = "f1_weighted"):
        super().__init__()
        self._setDefault(labelCol="label", metricName="f1_weighted")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        pred = dataset.select(F.lit(0).alias("_all"), F.col(self.getLabelCol()).alias("y_true"), "y_pred")
        found = evaluation.scores(evaluation.confusion(pred, ["_all"]), ["_all"]).select(evaluation.metric(self.getOrDefault(self.metricName))).first()
        return float(found[0]) if found else 0.0

    def isLargerBetter(self) -> bool:
        return True
