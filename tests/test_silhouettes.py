"""Silhouettes of all rows, over blocks, against the plain definition."""

import numpy as np
import pytest
from pyspark.sql import GroupedData

from isochron.operators import geometry
from isochron.plans import signal


def plain(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() < 2 or own.all():
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, labels == o].mean() for o in set(labels) - {c})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return out


@pytest.mark.parametrize("block", [4096, 37])
def test_blocks(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(230, 6)) + 100
    labels = rng.integers(0, 4, 230)
    x[:40] = x[0]
    labels[0] = 9
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))], "id long, label long, features array<double>")
    got = {r["id"]: r["silhouette"] for r in geometry.silhouettes(df, block=block).collect()}
    assert len(got) == 230
    np.testing.assert_allclose([got[i] for i in range(230)], plain(x, labels), atol=1e-9)


def test_rows_beyond_the_first_ids(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=4).tolist(), int(i % 3)) for i in range(1900, 2100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert signal.silhouette(spark, str(tmp_path)).count() == 200
    assert {r["label"]: r["n"] for r in signal.per_class_silhouette(spark, str(tmp_path)).collect()} == {0: 66, 1: 67, 2: 67}


def test_balancing_starts_from_the_whole_table(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=4).tolist(), int(3 if i % 2 else i % 3)) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {(r["stage"], r["label"]): r["n"] for r in signal.balance_stages(spark, str(tmp_path)).collect()}
    assert {k: n for k, n in out.items() if k[0] == "before"} == {("before", 0): 10, ("before", 1): 10, ("before", 2): 10, ("before", 3): 30}
    assert all(out["oversampled", label] == 30 for label in range(4))


def test_a_pair_of_rows_is_looked_at_once(spark, monkeypatch):
    """Of two blocks, one pass over their distances serves both."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, i % 3, rng.normal(size=3).tolist()) for i in range(40)], "id long, label long, features array<double>")
    seen = []
    real = geometry._distances
    monkeypatch.setattr(geometry, "_distances", lambda x, y: seen.append(len(x) * len(y)) or real(x, y))
    rows = {}
    monkeypatch.setattr(type(df.groupBy("id")), "applyInArrow", lambda self, run, schema: rows.update(run=run) or real_apply(self, run, schema))
    geometry.silhouettes(df, block=20)
    part = df.selectExpr("0 AS i", "1 AS j", "id < 20 AS low", "id", "label", "features").toArrow()
    assert rows["run"](part).num_rows == 40 * 3 and sum(seen) == 400


real_apply = GroupedData.applyInArrow


def test_counts_before_and_after_oversampling_edit_nothing(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=3).tolist(), int(i % 5 == 0)) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(signal.balance, "edited", lambda *a, **k: pytest.fail("rows were edited"))
    got = {(r["fold"], r["stage"], r["label"]): r["n"] for r in signal.balance_per_fold(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and all(got[f, "oversampled", 1] == got[f, "before", 0] for f in range(3))
