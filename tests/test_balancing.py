"""Balancing: partners within a class and editing by bounds, against plain searches."""

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from isochron.operators import balance, geometry, windows


def plain(x, i, k, among):
    d = ((x - x[i]) ** 2).sum(axis=1)
    return [(j, r + 1) for r, (_, j) in enumerate(sorted((float(d[j]), j) for j in among if j != i and np.isfinite(d[j]))[:k])]


def table(spark, separate):
    rng = np.random.default_rng(31)
    labels = rng.choice(5, 420, p=[0.4, 0.3, 0.2, 0.08, 0.02])
    labels[0] = 7  # a class of one row
    x = rng.normal(size=(420, 6)) + 1000 + separate * labels[:, None]
    x[100:130] = x[7]  # copies of several classes: ties go to the smaller id
    x[300, 0], x[301, 3] = np.nan, np.inf
    rows = [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))]
    return x, labels, spark.createDataFrame(rows, "id long, label long, features array<double>").repartition(3)


@pytest.mark.parametrize(("block", "meet"), [(16, 60), (4096, 70), (4096, None)])
def test_neighbours_of_the_own_class(spark, block, meet):
    x, labels, df = table(spark, 0)
    got = {}
    for r in geometry.class_neighbours(df.where("id % 3 = 0"), df, 4, block, meet=meet).collect():
        assert r["label"] == labels[r["query"]]
        got.setdefault(r["query"], []).append((r["id"], r["rank"]))
    assert {i: sorted(v, key=lambda p: p[1]) for i, v in got.items()} == {
        i: p for i in range(0, 420, 3) if (p := plain(x, i, 4, np.flatnonzero(labels == labels[i]).tolist()))}


@pytest.mark.parametrize("separate", [0, 3])
@pytest.mark.parametrize(("block", "meet"), [(16, 60), (16, 7), (4096, 70), (4096, None)])
def test_editing_by_bounds_is_that_of_nearest_rows(spark, block, meet, separate):
    x, labels, df = table(spark, separate)
    want = {i for i in range(420) if any(labels[j] != labels[i] for j, _ in plain(x, i, 3, range(420)))}
    got = [r["id"] for r in geometry.mixed(df.where("label <> 2"), df, 3, block, meet=meet).collect()]
    assert len(got) == len(set(got)) and set(got) == {i for i in want if labels[i] != 2} and 0 < len(want) < 420
    if meet is None:
        assert {r["id"] for r in balance.edited(df, 3).collect()} == set(range(420)) - want
        assert {r["id"] for r in balance.edited(df, 3, spare=2).collect()} == {i for i in range(420) if i not in want or labels[i] == 2}


def test_rows_without_a_label_are_edited_as_before(spark):
    df = spark.createDataFrame([(0, 1, [0.0]), (1, None, [0.1]), (2, 1, [0.2]), (3, 2, [0.25]), (4, 1, [-0.1]), (5, 1, [-0.2])], "id long, label long, features array<double>")
    assert {r["id"] for r in balance.edited(df, 2).collect()} == {0, 4, 5}


def test_only_rows_that_are_copied_look_for_partners(spark, monkeypatch):
    rng = np.random.default_rng(32)
    df = spark.createDataFrame([(i, int(i % 20 > 9), rng.normal(size=3).tolist()) for i in range(97)], "id long, label long, features array<double>")
    seen = []
    real = balance.class_neighbours
    monkeypatch.setattr(balance, "class_neighbours", lambda queries, rows, k: seen.append((queries.count(), rows.count())) or real(queries, rows, k))
    over = balance.oversample(df)
    assert seen == [(3, 47)] and balance.class_counts(over).where("n = 50").count() == 2  # 50 and 47 rows


def test_a_query_with_a_nearer_row_of_another_class_meets_no_more_rows(monkeypatch):
    rng = np.random.default_rng(33)
    x, code = rng.normal(size=(9000, 4)), np.arange(9000) % 2
    seen = []
    real = geometry._screen
    monkeypatch.setattr(geometry, "_screen", lambda z, zz, y: seen.append(len(z) * len(y)) or real(z, zz, y))
    own = np.arange(200)
    beaten = geometry._beaten(x, np.arange(9000), code, own, np.arange(200, 9000), np.full(9000, 1.0), np.zeros(9000, np.int64))
    near = ((x[own, None] - x[None, 200:]) ** 2).sum(axis=2) < 1
    assert beaten.tolist() == (near & (code[own, None] != code[None, 200:])).any(axis=1).tolist()
    assert sum(seen) < 0.5 * 200 * 8800


def test_partners_are_looked_for_once(spark, monkeypatch):
    rng = np.random.default_rng(34)
    df = spark.createDataFrame([(i, int(i % 20 > 9), rng.normal(size=3).tolist()) for i in range(97)], "id long, label long, features array<double>")
    seen, real = spark.sparkContext.accumulator(0), balance.class_neighbours

    def counted(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    monkeypatch.setattr(balance, "class_neighbours", lambda *a: (near := real(*a)).mapInArrow(counted, near.schema))
    got = {(r["stage"], r["label"]): r["n"] for r in balance.stages(df, edit=False).collect()}
    assert got == {("before", 0): 50, ("before", 1): 47, ("oversampled", 0): 50, ("oversampled", 1): 50}
    assert seen.value == 3 * 5  # three rows are copied, with five partners each


def test_queries_of_a_class_are_cut_for_all_cores(spark, monkeypatch):
    df = spark.range(6000).select("id", (F.col("id") % 2).alias("label"), F.array(F.rand(1), F.rand(2)).alias("features"))
    seen, real = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, run, schema: seen.append(self._df.where("ask").select("label", "i", "j").distinct().count()) or real(self, run, schema))
    near = geometry.class_neighbours(df, df, 2, meet=4096)
    assert seen == [6] and near.count() == 12000  # three pieces of each class
    assert geometry.class_neighbours(df.where("id < 0"), df, 2, meet=4096).count() == 0


def test_cut_points_are_asked_for_at_once(spark, monkeypatch):
    from pyspark.sql.functions import builtin

    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("v"))
    want = df.select(F.percentile_approx("v", [i / windows.SLICES for i in range(1, windows.SLICES)], 20_000)).first()[0]
    calls, real = [], builtin.lit
    monkeypatch.setattr(builtin, "lit", lambda x: calls.append(x) or real(x))
    assert windows.cut_points(df, "v", slices=10) == [want[i * windows.SLICES // 10 - 1] for i in range(1, 10)]
    assert len(calls) < 50
