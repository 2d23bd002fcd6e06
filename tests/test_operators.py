"""Operators on hand-made rows: published counts, edge cases, equal rows whatever the partitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.operators import balance, evaluation, features, geometry, learning, matching, sampling, tables, windows
from isochron.sources import store, synthetic, wfdb
from isochron.streaming import trailing


def plain_rhythm(rr, jump=0.05):
    x = np.array([v for v in rr if v is not None])
    n = len(x)
    if n < 3:
        return (n, x.mean() if n else 0.0, 0.0, 0.0, 0.0, 0.0)
    d = np.diff(x)
    return (n, x.mean(), x.std(), np.sqrt((d**2).mean()), (np.abs(d) > jump).mean(), float(n >= 8))


@pytest.mark.parametrize("causal", [True, False])
def test_rhythm_over_frames(spark, causal):
    rng = random.Random(1)
    rows = []
    for record, n in enumerate([1, 2, 3, 7, 8, 9, 16, 17, 40]):
        for pos in range(n):
            missing = pos == 0 or (record == 8 and pos in (5, 6, 20))
            rows.append((record, pos, None if missing else round(rng.uniform(0.6, 1.1), 3)))
    df = spark.createDataFrame(rows, "record long, pos int, rr_pre double").repartition(5)
    got = {(r["record"], r["pos"]): r for r in windows.rhythm(df, "record", ["pos"], width=16, causal=causal).collect()}
    by = {}
    for record, pos, rr in rows:
        by.setdefault(record, []).append(rr)
    for (record, pos), r in got.items():
        own = by[record][max(0, pos - 15) : pos + 1 if causal else pos + 16]
        assert tuple(r[c] for c in ("n_rr", "mean_rr", "sdnn", "rmssd", "pnn", "lfhf")) == pytest.approx(plain_rhythm(own), abs=1e-9)


def test_causal_features_ignore_the_future(spark):
    beats = synthetic.beats(spark, 2, 30, samples=64).withColumn("record", F.col("record"))
    whole = features.feature_table(beats, "record", ["pos"], "segment", 128.0)
    part = features.feature_table(beats.where("pos < 20").repartition(3), "record", ["pos"], "segment", 128.0)
    cols = features.feature_columns(whole)
    a = {r["beat_id"]: [r[c] for c in cols] for r in whole.where("pos < 20").collect()}
    b = {r["beat_id"]: [r[c] for c in cols] for r in part.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9, equal_nan=True) for k in a) and len(cols) == 26, len(cols)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).alias("record"), F.col("id").alias("event_id"), (F.col("id") + F.rand(3)).cast("double").alias("t"))
    rows = rows.persist()
    for i in range(3):
        rows.where((F.col("event_id") >= i * 100) & (F.col("event_id") < i * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = trailing.trailing_rhythm(stream).writeStream.format("memory").queryName("rhythm").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = windows.rhythm(windows.intervals(rows, "record", ["t", "event_id"], "t"), "record", ["t", "event_id"])
    cols = ["event_id", "pos", "n_rr", "mean_rr", "sdnn", "rmssd", "pnn", "lfhf"]
    a, b = (sorted(map(tuple, df.select(*cols).collect())) for df in (spark.table("rhythm"), want))
    assert len(a) == 300 and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b, strict=True))


def greedy(ref, det, tol):
    pairs = sorted((abs(r - d), i, j) for i, r in enumerate(ref) for j, d in enumerate(det) if abs(r - d) <= tol)
    used_r, used_d, out = set(), set(), []
    for _, i, j in pairs:
        if i not in used_r and j not in used_d:
            used_r.add(i)
            used_d.add(j)
            out.append((i, j))
    return sorted(out)


def test_matching_is_the_greedy_one(spark):
    rng = random.Random(2)
    data = {r: ([rng.randrange(400) for _ in range(rng.randrange(30))], [rng.randrange(400) for _ in range(rng.randrange(30))]) for r in range(25)}
    data[90], data[91] = ([100], [90, 110]), ([10, 12], [11])  # equal gaps
    ref = spark.createDataFrame([(r, i, float(t)) for r, (a, _) in data.items() for i, t in enumerate(a)], "record long, r_id long, r_t double")
    det = spark.createDataFrame([(r, i, float(t)) for r, (_, b) in data.items() for i, t in enumerate(b)], "record long, d_id long, d_t double")
    got = {}
    for r in matching.nearest_matches(matching.band_join(ref, det, "record", 10.0), "record", 10.0).collect():
        got.setdefault(r["record"], []).append((r["r_id"], r["d_id"]))
    for r, (a, b) in data.items():
        assert sorted(got.get(r, [])) == greedy(a, b, 10.0)


def test_detection_score_of_the_published_counts(spark):
    row = spark.range(1).select(*(v.alias(k) for k, v in matching.detection_score(F.lit(40), F.lit(41), F.lit(38)).items())).first()
    assert row.asDict() == {"tp": 38, "fp": 3, "fn": 2, "se": 0.95, "ppv": 0.9268, "f1": 0.9383}


def test_metrics_with_classes_missing_on_a_side(spark):
    rows = [("a", "a")] * 5 + [("a", "x"), ("b", "a"), ("b", "a")]
    df = spark.createDataFrame([("m", *r) for r in rows], "clf string, y_true string, y_pred string")
    out = evaluation.scores(evaluation.confusion(df, ["clf"]), ["clf"]).first()
    f1a = 2 * 5 / (6 + 7)
    assert out["acc"] == pytest.approx(5 / 8) and out["f1_weighted"] == pytest.approx(f1a * 6 / 8) and out["f1_macro"] == pytest.approx(f1a / 3)


def test_mcnemar_switches_to_chi_square(spark):
    rows = []
    for pair, n in (("p", 24), ("q", 25)):
        for i in range(n):
            rows += [(f"{pair}{i}", f"{pair}1", "y", "y" if i < 5 else "n"), (f"{pair}{i}", f"{pair}2", "y", "n" if i < 5 else "y")]
    df = spark.createDataFrame(rows, "id string, clf string, y_true string, y_pred string")
    out = {r["clf_a"]: r for r in evaluation.mcnemar_test(evaluation.mcnemar(df)).collect()}
    assert out["p1"]["statistic"] == 5 and out["p1"]["p"] == pytest.approx(2 * sum(math.comb(24, i) for i in range(6)) / 2**24)
    assert out["q1"]["statistic"] == pytest.approx((20 - 5 - 1) ** 2 / 25)


def test_running_sums_do_not_depend_on_slices(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"), F.lit(1).alias("n")).groupBy("k", "v").agg(F.sum("n").alias("n"))
    a = sorted(map(tuple, windows.running_sums(rows, "k", "v", ["n"], slices=2).collect()))
    b = sorted(map(tuple, windows.running_sums(rows, "k", "v", ["n"], slices=64).collect()))
    assert a == b


def test_threshold_without_hits(spark):
    rows = spark.createDataFrame([("a", 0.1, False), ("a", 0.9, False), ("a", 0.2, True)], "clf string, score double, hit boolean")
    out = evaluation.operating_points(rows, spark.createDataFrame([("a", [0.5, 2.0])], "clf string, grid array<double>"), "clf")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"], r["fp_per_tp"]) for r in out.collect()}
    assert got == {0.5: (0, 1, 1, 1, math.inf), 2.0: (0, 0, 1, 2, math.inf)}


def test_folds_and_holdout_keep_groups_apart(spark):
    rows = spark.range(400).select((F.col("id") % 23 % 11).alias("g"), "id")
    folds = {r["g"]: r["fold"] for r in sampling.group_folds(rows, "g", 4).collect()}
    assert set(folds.values()) == {0, 1, 2, 3} and len(folds) == 11
    train, test = sampling.group_holdout(rows, "g", 0.3, 13, sampling.generated_groups)
    ids = np.array(sorted(folds), dtype=object)
    np.random.default_rng(13).shuffle(ids)
    assert {r["g"] for r in test.select("g").distinct().collect()} == set(ids[:3].tolist())
    assert train.count() + test.count() == 400 and train.join(test, "g", "left_semi").count() == 0
    sizes = {r["g"]: r["count"] for r in sampling.stratified(rows, "g", 0.1, [sampling.hashed("id")]).groupBy("g").count().collect()}
    assert all(sizes[r["g"]] == max(1, round(r["count"] * 0.1)) for r in rows.groupBy("g").count().collect())
    train, test = sampling.group_holdout(rows, "g", 0.3, 13)
    assert test.select("g").distinct().count() == 3 and train.count() + test.count() == 400 and train.join(test, "g", "left_semi").count() == 0


def plain_folds(sizes, folds):
    loads, out = [0] * min(folds, len(sizes)), {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        out[g] = f
        loads[f] += n
    return out


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_folds_are_the_greedy_ones(spark, seed):
    rng = random.Random(seed)
    sizes = {g: rng.choice([1, 1, 2, 3, rng.randint(1, 60)]) for g in range(rng.choice([3, 60, 200]))}
    rows = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g long").repartition(3)
    for folds in (2, 5):
        assert {r["g"]: r["fold"] for r in sampling.group_folds(rows, "g", folds).collect()} == plain_folds(sizes, folds)


def test_quantiles_are_exact_whatever_the_slices(spark):
    rng = np.random.default_rng(8)
    data = {"a": rng.normal(size=301), "b": np.repeat([1.0, 2.0, 5.0], [200, 1, 30]), "c": np.array([7.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("d", None)], "k string, v double").repartition(5)
    for slices in (2, 7, 256):
        got = {r["k"]: r["q"] for r in windows.quantiles(rows, "k", "v", [0.5, 0.0, 0.01, 0.99, 1.0], slices).collect()}
        assert set(got) == set(data) and all(got[k] == pytest.approx(np.quantile(v, [0.5, 0.0, 0.01, 0.99, 1.0]).tolist(), abs=1e-12) for k, v in data.items())


def test_a_dense_record_is_matched_as_the_greedy_rule_does(spark):
    rng = random.Random(9)
    a, b = ([rng.randrange(3000) for _ in range(400)] for _ in range(2))
    ref = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(a)], "record long, r_id long, r_t double")
    det = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(b)], "record long, d_id long, d_t double")
    pairs = matching.band_join(ref, det, "record", 25.0)
    for rounds in (1, 3):
        found = matching.nearest_matches(pairs, "record", 25.0, rounds)
        assert sorted((r["r_id"], r["d_id"]) for r in found.collect()) == greedy(a, b, 25.0)
    lone = matching.unmatched(ref, det, found, "record").groupBy("side").count().collect()
    assert {r["side"]: r["count"] for r in lone} == {"missed": 400 - found.count(), "extra": 400 - found.count()}


def test_a_detector_runs_on_each_record(spark):
    t = np.arange(2000)
    x = sum(np.exp(-((t - c) / 5.0) ** 2) for c in range(100, 2000, 100))
    signals = spark.createDataFrame([("r1", 360, x.tolist()), ("r2", 360, (x * 2).tolist()), ("r3", 360, [0.0] * 50)], "record string, fs int, samples array<double>")
    ref = spark.createDataFrame([("r1", i, float(c + 3)) for i, c in enumerate(range(100, 2000, 100))] + [("r2", 0, 50.0)], "record string, r_id long, r_t double")
    got = {r["record"]: (r["tp"], r["fp"], r["fn"]) for r in matching.evaluated_detector(signals, ref, matching.peaks_above(), 10.0).collect()}
    assert got == {"r1": (19, 0, 0), "r2": (0, 19, 1), "r3": (0, 0, 0)}


def test_signed_ranks_agree_with_the_plain_test(spark):
    from isochron.functions import stats

    rng = np.random.default_rng(10)
    data = {"x": np.round(rng.normal(0.2, 1, 80), 1), "y": rng.normal(size=60), "z": np.zeros(5), "five": np.arange(1.0, 6.0), "one": np.array([-2.0]), "even": np.array([1.0, -1.0, 1.0, -1.0])}
    data |= {f"n{n}": np.round(rng.normal(0.3, 1, n), n % 3) for n in (2, 7, 10, 22, 49, 50, 51)}
    rows = spark.createDataFrame([(k, float(v)) for k, own in data.items() for v in own], "k string, d double")
    got = {r["k"]: r for r in evaluation.signed_ranks(rows, ["k"]).collect()}
    assert set(got) == set(data) - {"z"}
    for k in got:
        assert (got[k]["statistic"], got[k]["p"]) == pytest.approx(stats.wilcoxon(data[k].tolist()), rel=1e-9)
    assert got["five"]["p"] == 0.0625 and got["one"]["p"] == 1.0


def test_exact_signed_ranks_by_all_signs():
    from itertools import product

    from isochron.functions import stats

    for d in ([1.0, 2.0, 3.0, -4.0, 5.0], [1.0, 1.0, -1.0, 2.0, 2.0, 0.0, -3.0], [-0.5, -0.5, -0.5], [3.0, -1.0, 2.0, 4.0, 4.0, 6.0, -7.0, 8.0, 9.0, 10.0]):
        own = [x for x in d if x]
        rank = [sum(abs(y) < abs(x) for y in own) + (sum(abs(y) == abs(x) for y in own) + 1) / 2 for x in own]
        least = lambda signs: min(sum(r for r, s in zip(rank, signs, strict=True) if s), sum(r for r, s in zip(rank, signs, strict=True) if not s))  # noqa: B023, E731
        w = least([x > 0 for x in own])
        sums = [sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in product((0, 1), repeat=len(own))]
        p = min(1.0, 2 * sum(x <= w for x in sums) / len(sums))
        assert stats.wilcoxon(d) == pytest.approx((w, p))


def test_patients_by_name_are_drawn(spark):
    rows = [(f"P{i:02d}", "a", "N", "NS"[i % 2], 3) for i in range(40)] + [(f"P{i:02d}", "b", "N", "N", 3) for i in range(40)]
    out = evaluation.bootstrap(spark.createDataFrame(rows, "patient string, clf string, y_true string, y_pred string, n long"), 300)
    total = {r["rep"]: r["n"] for r in out.where("clf = 'b'").collect()}
    assert 90 < sum(total.values()) / 300 / 120 * 100 < 110 and len(set(total.values())) > 5
    assert {r["rep"]: r["n"] for r in out.where("clf = 'a'").groupBy("rep").agg(F.sum("n").alias("n")).collect()} == total


def test_patients_of_records_are_total(spark):
    rows = spark.createDataFrame([(1, "N"), (2, "S"), (3, "N"), (4, "V")], "record long, label string")
    parsed = spark.createDataFrame([(1, "P01"), (2, "P02"), (3, "P03")], "record long, patient string")
    override = spark.createDataFrame([(2, "P01"), (4, "P09")], "record long, patient string")
    got = {r["record"]: r["patient"] for r in tables.with_patients(rows, parsed, override).collect()}
    assert got == {1: "P01", 2: "P01", 3: "P03", 4: "P09"}
    with pytest.raises(Exception, match="no patient for record 4"):
        tables.with_patients(rows, parsed).collect()
    train, test, audit = sampling.audited_holdout(rows, parsed, override)
    assert train.join(test, "patient", "left_semi").count() == 0 and train.count() + test.count() == 4
    assert all(r["disjoint"] for r in audit.collect()) and {r["part"] for r in audit.collect()} == {"train", "test"}
    shared = spark.createDataFrame([("P", "train", "N"), ("P", "test", "N"), ("Q", "test", "S")], "patient string, part string, label string")
    assert not any(r["disjoint"] for r in tables.audit(shared, "patient", "part", "label").collect())
    assert {r["patient"]: r["parts"] for r in tables.patient_lists(shared, "patient", "part").collect()} == {"P": ["test", "train"], "Q": ["test"]}
    with pytest.raises(ValueError, match="no metric"):
        evaluation.metric("auc")


def test_resampled_records_keep_their_annotations(spark):
    t = np.arange(2570) / 257.0
    wave = lambda at: np.sin(2 * np.pi * 3 * at)
    signals = spark.createDataFrame([("a", "II", 0, 257, wave(t).tolist()), ("b", "II", 0, 360, [1.0, 2.0])], "record string, lead string, idx int, fs int, samples array<double>")
    marks = spark.createDataFrame([("a", 257, "N"), ("a", 100, "V"), ("b", 1, "N")], "record string, sample long, symbol string")
    out, moved = features.resampled(signals, marks)
    got = {r["record"]: r for r in out.collect()}
    assert len(got["a"]["samples"]) == 3600 and got["a"]["fs"] == 360 and got["b"]["samples"] == [1.0, 2.0]
    assert np.abs(np.array(got["a"]["samples"])[200:-200] - wave(np.arange(3600) / 360.0)[200:-200]).max() < 1e-2
    assert sorted(map(tuple, moved.collect())) == [("a", round(100 * 360 / 257), "V"), ("a", 360, "N"), ("b", 1, "N")]


@pytest.mark.parametrize("rarest", [1, 2, 4, 8])
def test_oversampling_fills_every_class(spark, rarest):
    rng = np.random.default_rng(3)
    rows = [(i, "A" if i < 20 else "B" if i < 32 else "C", [float(x) for x in rng.normal(size=3)]) for i in range(32 + rarest)]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>").repartition(3)
    out = balance.oversample(df)
    assert {r["label"]: r["n"] for r in balance.class_counts(out).collect()} == {"A": 20, "B": 20, "C": 20}
    lo = {c: np.min([f for _, k, f in rows if k == c], axis=0) for c in "BC"}
    hi = {c: np.max([f for _, k, f in rows if k == c], axis=0) for c in "BC"}
    for r in out.where("id IS NULL").collect():
        assert (np.array(r["features"]) >= lo[r["label"]] - 1e-9).all() and (np.array(r["features"]) <= hi[r["label"]] + 1e-9).all()


def test_editing_drops_rows_among_strangers(spark):
    rows = [(i, "A", [float(i), 0.0]) for i in range(6)] + [(10, "B", [2.5, 0.0]), (11, "B", [90.0, 0.0]), (12, "B", [91.0, 0.0]), (13, "B", [92.0, 0.0]), (14, "B", [93.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>")
    kept = {r["id"] for r in balance.edited(df, 3).collect()}
    assert 10 not in kept and {11, 12, 13, 14} <= kept
    assert 10 in {r["id"] for r in balance.edited(df, 3, spare="B").collect()}


def separable(spark, n=240):
    rng = np.random.default_rng(4)
    centres = {"N": (0, 0), "S": (6, 0), "V": (0, 6)}
    rows = [(i, i % 12, "NSV"[i % 3], [float(x) for x in rng.normal(size=2) + centres["NSV"[i % 3]]] + [float(rng.normal())]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, group long, label string, features array<double>").repartition(4).persist()


def test_linear_models_reach_their_optimum(spark):
    df = separable(spark)
    rows = df.collect()
    for loss, c in (("squared_hinge", 0.1), ("logistic", 1.0)):
        model = learning.fit_linear(df, loss, c)
        x, y = model.scaler(np.array([r["features"] for r in rows])), np.array([r["label"] for r in rows])
        z = np.hstack([x, np.ones((len(x), 1))])
        for k, name in enumerate(model.classes):
            s = np.where(y == name, 1.0, -1.0)
            # one fit of all classes weighs rows by their own class, separate fits weigh two sides
            own = np.array([len(y) / (3 * (y == x).sum()) for x in y])
            v = own if loss == "squared_hinge" else np.where(s > 0, len(y) / (2 * (s > 0).sum()), len(y) / (2 * (s < 0).sum()))

            def value(w, s=s, v=v, loss=loss, c=c):
                m = s * (z @ w)
                reg = w @ w if loss == "squared_hinge" else w[:-1] @ w[:-1]
                return 0.5 * reg + c * (v * (np.maximum(1 - m, 0) ** 2 if loss == "squared_hinge" else np.logaddexp(0, -m))).sum()

            best = value(model.coef[k])
            rng = np.random.default_rng(5)
            assert all(value(model.coef[k] + rng.normal(scale=1e-3, size=z.shape[1])) >= best - 1e-9 for _ in range(50))
        pred = model.predict(df).collect()
        assert np.mean([r["y_pred"] == r["label"] for r in pred]) > 0.97


def test_experiments(spark):
    df = separable(spark, 120)
    out = {r["key"]: r for r in learning.ablation(df, {"a": [0], "b": [1, 2]}, folds=2).collect()}
    assert out["all"]["f1_weighted"] > 0.95 and out["drop_a"]["delta"] < -0.1 and set(out) == {"all", "drop_a", "drop_b", "only_a", "only_b"}
    train, test = df.where("group < 8"), df.where("group >= 8")
    assert {r["protocol"] for r in learning.leakage_stress(train, test).collect()} == {"disjoint", "random"}
    assert learning.evaluate(train, test, "dt").first()["acc"] > 0.9
    folds = learning.cross_validate(df, "svc", 2).unionByName(learning.cross_validate(df, "dt", 2))
    tests = learning.paired_tests(folds).collect()
    assert len(tests) == 1 and 0 <= tests[0]["p_holm"] <= 1
    assert learning.principal_components(df, 2)(df).select(F.size("features")).first()[0] == 5
    assert len(learning.selected(df, 2)) == 2
    assert learning.random_fourier(df, 0.1, 16).select(F.size("features")).first()[0] == 16
    z = learning.Scaler.fit(df)(np.array([r["features"] for r in df.collect()]))
    labels = np.array([r["label"] for r in df.collect()])
    within = sum(np.cov(z[labels == c].T, bias=True) * (labels == c).sum() for c in "NSV")
    between = sum((labels == c).sum() * np.outer(z[labels == c].mean(axis=0), z[labels == c].mean(axis=0)) for c in "NSV")
    want = np.trace(np.linalg.pinv(within + 1e-3 * np.eye(3)) @ between)
    assert geometry.regularized_fisher(geometry.standardized(geometry.long(df))) == pytest.approx(want, rel=1e-6)


def test_pairs_and_training_separability(spark):
    df = separable(spark, 150)
    errors = {(r["a"], r["b"]): r for r in learning.pair_errors(df).collect()}
    assert set(errors) == {("N", "S"), ("N", "V"), ("S", "V")} and all(r["n"] == 100 and r["error"] <= 0.05 for r in errors.values())
    mixed = df.withColumn("label", F.when(F.col("id") % 2 == 0, "N").otherwise("S"))
    assert learning.pair_errors(mixed).first()["error"] > 0.2
    swept = {r["tolerance"]: r for r in learning.separable_fraction(learning.pair_errors(df), [0.05, 0.0]).collect()}
    assert swept[0.05]["separable_fraction"] == 1.0 and swept[0.05]["n_pairs"] == 3
    own = learning.train_separability(df).first()
    assert own["train_accuracy"] > 0.97 and own["mean_margin"] > 0 and own["frac_misclassified"] == pytest.approx(1 - own["train_accuracy"])


def test_pipeline_learns_from_training_rows_only(spark):
    df = separable(spark, 120)
    holes = df.withColumn("features", F.transform("features", lambda x, i: F.when((F.col("id") % 17 == 0) & (i == 2), F.lit(None)).otherwise(x)))
    train, test = holes.where("group < 8"), holes.where("group >= 8")
    model = learning.Pipeline(train, keep=2, components=1)
    rows = np.array([[np.nan if v is None else v for v in r["features"]] for r in train.collect()], dtype=float)
    assert model.medians == pytest.approx(np.nanmedian(rows, axis=0).tolist()) and len(model.left) == 2
    assert model.scaler.mean == pytest.approx(np.where(np.isnan(rows), np.nanmedian(rows, axis=0), rows).mean(axis=0).tolist())
    pred = model.predict(test).collect()
    assert len(pred) == test.count() and np.mean([r["y_pred"] == r["label"] for r in pred]) > 0.95
    train, test = df.where("group < 8").persist(), df.where("group >= 8")
    for model in (learning.Neighbours(train, 5), learning.Perceptron(train, 8, 30), learning.Lifted(train, features=24)):
        assert np.mean([r["y_pred"] == r["label"] for r in model.predict(test).collect()]) > 0.9
    scored = learning.fold_scores(df, ["linear", "knn"], 2)
    gap = learning.gaps(scored).first()
    assert gap["clf"] == "knn" and gap["gap"] == pytest.approx(gap["score"] - gap["base_score"]) and 0 <= gap["p_t"] <= 1
    out = {r["key"]: r["f1_weighted"] for r in learning.marginal(df, {"graph": [0], "hrv": [1], "x": [2]}, folds=2).collect()}
    assert out["marginal_costly_given_cheap"] == pytest.approx(out["full"] - out["no_costly"]) and out["full"] > out["no_costly_no_cheap"]
    mi = {r["feature"]: r["rank"] for r in learning.mutual_information(df, 8).collect()}
    assert mi[2] == 3  # noise comes last


def test_attributions(spark):
    from isochron.functions import kernels as K
    from isochron.operators import alignment

    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, attr array<double>")
    f, p = K.welch(x, 128.0)
    areas = np.stack([np.trapezoid(p[:, (f >= lo) & (f < hi)], f[(f >= lo) & (f < hi)], axis=1) for lo, hi in K.BANDS.values()], axis=1)
    got = {r["band"]: r["importance"] for r in alignment.attribution_importance(df, "attr", 128.0).collect()}
    assert [got[b] for b in K.BANDS] == pytest.approx((areas.sum(axis=0) / areas.sum()).tolist())
    given = {"low": 0.2, "mid": 0.5, "high": 0.3}
    row = alignment.significance(df, "id", "attr", given, 128.0, reps=500).first()
    g = np.array(list(given.values()))
    cos = areas @ g / np.linalg.norm(areas, axis=1) / np.linalg.norm(g)
    assert row["mean_cosine"] == pytest.approx(cos.mean()) and row["ci_low"] < cos.mean() < row["ci_high"]
    times = evaluation.draw_times(np.arange(40), 500)
    assert abs(times.mean() - 1) < 0.05 and row["ci_low"] == pytest.approx(np.quantile(times @ cos / times.sum(axis=1), 0.025))
    assert 0 < row["p"] <= 1
    model = learning.fit_linear(separable(spark, 90))
    bands = spark.createDataFrame([("a", "low"), ("b", "mid"), ("c", "high")], "feature string, band string")
    out = alignment.report(model, ["a", "b", "c"], bands, df, ["attr"], 128.0, 600).first()
    assert out["linear_params"] == 12 and out["ratio"] == 50.0 and -1 <= out["cosine"] <= 1


def test_edge_filter_runs_after_intervals(spark):
    df = spark.createDataFrame([(1, 50, "N"), (1, 300, "?"), (1, 400, "V"), (1, 990, "A")], "record long, sample long, symbol string")
    rows = windows.intervals(tables.map_symbols(df, tables.SYMBOLS), "record", ["sample"], "sample").withColumn("n", F.lit(1000))
    got = tables.inside(rows, "sample", "n", 90, 162).collect()
    assert [(r["sample"], r["rr_pre"], r["rr_post"], r["label"]) for r in got] == [(400, 350, 590, "V")]


def test_leads_in_wanted_order_then_padded(spark):
    df = spark.createDataFrame([(1, "v5", 0), (1, "mlii", 1), (2, "X", 0), (2, "V1", 1)], "record long, lead string, idx int")
    got = {(r["record"], r["place"]): r["lead"] for r in tables.select_leads(df, "record", "lead", "idx", ["MLII", "V1"]).collect()}
    assert got == {(1, 1): "mlii", (1, 2): "v5", (2, 1): "V1", (2, 2): "X"}


def test_patient_numbers(spark):
    text = spark.createDataFrame([("patient: 7",), ("Patient number 12",), ("patient #3",), ("PATIENT 05",)], "t string")
    assert [r[0] for r in text.select(wfdb.patient_number(F.col("t"))).collect()] == ["P07", "P12", "P03", "P05"]
    with pytest.raises(Exception, match="no patient number"):
        spark.createDataFrame([("age: 70",)], "t string").select(wfdb.patient_number(F.col("t"))).collect()


def test_waveform_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    events = [(100, "N"), (500, "V"), (2600, "A"), (2700, "+"), (2800, "N"), (2995, "N")]
    for name in ("r1", "r2"):
        raw = rng.integers(-2048, 2048, size=(3000, 2))
        data, kind = (wfdb.encode_212(raw.ravel()), "212") if name == "r1" else (raw.astype("<i2").tobytes(), "16")
        (tmp_path / f"{name}.dat").write_bytes(data)
        (tmp_path / f"{name}.hea").write_text(f"{name} 2 360 3000\n{name}.dat {kind} 200(10) 12 0 0 0 0 MLII\n{name}.dat {kind} 100 12 5 0 0 0 V1\n# patient: 4\n")
        (tmp_path / f"{name}.atr").write_bytes(wfdb.encode_annotations(events))
        if name == "r1":
            want = raw
    signals = {(r["record"], r["lead"]): r for r in wfdb.read_signals(spark, str(tmp_path)).collect()}
    assert np.allclose(signals["r1", "MLII"]["samples"], (want[:, 0] - 10) / 200) and np.allclose(signals["r1", "V1"]["samples"], (want[:, 1] - 5) / 100)
    assert [(r["sample"], r["symbol"]) for r in wfdb.read_annotations(spark, str(tmp_path)).where("record = 'r1'").orderBy("sample").collect()] == events
    assert {r["patient"] for r in wfdb.read_patients(spark, str(tmp_path)).collect()} == {"P04"}
    beats = wfdb.beats(wfdb.read_signals(spark, str(tmp_path)), wfdb.read_annotations(spark, str(tmp_path)), tables.SYMBOLS).where("record = 'r2' AND lead = 'V1'").orderBy("sample").collect()
    assert [(r["sample"], r["label"]) for r in beats] == [(100, "N"), (500, "V"), (2600, "S"), (2800, "N")] and all(len(r["segment"]) == 252 for r in beats)
    assert beats[3]["rr_post"] == pytest.approx(195 / 360)


def test_store_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 0.25, "b")], "id long, td_mean double, group string")
    store.save_features(df, spark.createDataFrame([("td_mean", "time")], "name string, family string"), str(tmp_path / "f"))
    back, meta = store.load_features(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, back.select("id", "td_mean", "group").collect())) == sorted(map(tuple, df.collect())) and meta.count() == 1
    results = spark.createDataFrame([(["N", "S"], [[5, 1], [2, 3]])], "labels array<string>, matrix array<array<long>>")
    assert sorted(map(tuple, store.reordered_confusion(results, ["S", "N"]).collect())) == [(1, 1, 3), (1, 2, 2), (2, 1, 1), (2, 2, 5)]
    stages = spark.createDataFrame([(s, k, n) for s in ("before", "oversampled", "edited") for k, n in (("N", 5), ("S", 3))], "stage string, label string, n long")
    lines = [r["line"].split() for r in store.balance_report(stages).orderBy("place").collect()]
    assert lines == [["N", "5", "5", "5"], ["S", "3", "3", "3"], ["total", "8", "8", "8"]]
    store.save_results(df, str(tmp_path / "r"), ("td_mean",))
    assert spark.read.json(str(tmp_path / "r")).columns == ["group", "id"]


def test_flat_null_and_unequal_segments_have_null_features(spark):
    wave = [float(np.sin(i / 3)) for i in range(64)]
    rows = [(1, 0, wave, 0.8), (1, 1, [2.0] * 64, 0.8), (1, 2, None, 0.8), (1, 3, wave[:40], 0.8), (1, 4, [1.0, None] * 32, 0.8), (1, 5, [], 0.8), (1, 6, [1.0], 0.8), (1, 7, wave, 0.8)]
    beats = spark.createDataFrame(rows, "record long, sample long, segment array<double>, rr_pre double").coalesce(1)
    got = {r["sample"]: r for r in features.feature_table(beats, "record", ["sample"], "segment", 128.0).collect()}
    assert got[1]["td_skew"] is None and got[1]["td_kurt"] is None and got[1]["td_std"] == 0 and got[1]["fd_low"] is not None
    for sample in (2, 4, 5):
        assert all(got[sample][c] is None for c in ("td_mean", "td_skew", "fd_low", "mp_r_amp", "wv_A4"))
    assert got[6]["fd_low"] is None and got[6]["td_mean"] == 1.0
    assert all(got[s]["td_skew"] is not None and got[s]["wv_D1"] is not None for s in (0, 3, 7))
    assert got[7]["gr_wdegree"] > 0 and got[2]["gr_wdegree"] == 0 and got[3]["hrv_mean_rr"] == pytest.approx(0.8)
    whole = features.feature_table(beats.where("sample IN (0, 7)"), "record", ["sample"], "segment", 128.0).collect()
    assert all(got[r["sample"]]["mp_qrs_ms"] == r["mp_qrs_ms"] for r in whole)
    filled = features.medians_filled(features.time_features(beats, "segment"), ["td_skew", "td_kurt"]).collect()
    assert all(r["td_skew"] is not None for r in filled)


def test_permutations_by_number():
    import itertools

    from isochron.operators import alignment

    for given in ([], [0.5], [1, 2, 3], ["a", "a", "b", "c"]):
        assert [alignment.permutation(given, k) for k in range(math.factorial(len(given)))] == [list(x) for x in itertools.permutations(given)]


def test_neighbours_by_cells_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(12, 8)) * 30
    x = np.concatenate([centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 8)), np.repeat(centres[:1], 60, axis=0), np.zeros((3, 8))])
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>").repartition(5)
    queries = rows.where("id % 4 = 0 OR id > 690")

    def plain(q, ids, k, others):
        out = []
        for i in ids:
            d = ((x - q(i)) ** 2).sum(axis=1)
            near = sorted((float(v), j) for j, v in enumerate(d) if others or j != i)[:k]
            out += [(i, j, r + 1) for r, (_, j) in enumerate(near)]
        return sorted(out)

    ids = [i for i in range(len(x)) if i % 4 == 0 or i > 690]
    for block in (40, 4096):
        report = {}
        got = sorted((r["query"], r["id"], r["rank"]) for r in geometry.neighbours(queries, rows, 5, block, report=report).collect())
        assert got == plain(lambda i: x[i], ids, 5, False)
        assert report["pairs"] == len(ids) * len(x) and (report["compared"] < 0.6 * report["pairs"] if block == 40 else report["compared"] == report["pairs"])
    other = spark.createDataFrame([(i, 0, (x[i] + 0.25).tolist()) for i in range(0, 200, 7)], "id long, label int, features array<double>")
    got = sorted((r["query"], r["id"], r["rank"]) for r in geometry.neighbours(other, rows, 3, 50, others=True).collect())
    assert got == plain(lambda i: x[i] + 0.25, range(0, 200, 7), 3, True)
    few = geometry.neighbours(rows.where("id < 4"), rows.where("id < 4"), 9, 2).collect()  # fewer rows than asked for
    assert len(few) == 12


@pytest.mark.parametrize(("block", "meet"), [(16, 100), (16, 7), (4096, 90)])
def test_neighbours_without_structure_are_sent_once_to_a_shelf(spark, block, meet):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(500, 24)) + 1000
    x[100:140] = x[7]  # copies: ties go to the smaller id
    x[300, 0], x[301, 3] = np.nan, np.inf
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>").repartition(3)
    got = sorted((r["query"], r["rank"], r["id"], r["d2"]) for r in geometry.neighbours(rows, rows, 4, block, meet=meet).collect())
    plain = []
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        plain += [(i, r + 1, j, v) for r, (v, j) in enumerate(sorted((float(v), j) for j, v in enumerate(d) if j != i and np.isfinite(v))[:4])]
    assert [g[:3] for g in got] == [p[:3] for p in plain] and np.allclose([g[3] for g in got], [p[3] for p in plain])
    cells = geometry.Cells(rows.where("id <> 300 AND id <> 301"), 498, block, "features", meet)
    if cells.pivots is not None and meet == 100:
        asked = cells.asked(cells.placed(rows.select("id", "features")).withColumn("tau", F.lit(1e9)))
        assert len(cells.parts) < len(cells.sizes) / 3 and asked.groupBy("id", "shelf").count().where("count > 1").count() == 0


def greedy_pairs(pairs):
    """Plain matching of (gap, record, r, d)."""
    used, out = set(), set()
    for gap, record, r, d in sorted(pairs, key=lambda p: (p[0], p[2], p[3])):
        if (record, "r", r) not in used and (record, "d", d) not in used:
            used |= {(record, "r", r), (record, "d", d)}
            out.add((record, r, d))
    return out


def test_a_long_chain_of_ever_closer_pairs(spark, monkeypatch):
    written = []
    keep = matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda df, name: written.append(name) or keep(df, name))
    n = 100_000
    # sides alternate, each pair closer than the one before; a second record has ups and downs
    chain = [(1.0 - i / (2.0 * n), "a", (i + 1) // 2, i // 2) for i in range(n)]
    rng = random.Random(3)
    waves = [(round(math.sin(i / 40) + 0.001 * rng.random(), 6) + 2, "b", (i + 1) // 2, i // 2) for i in range(3000)]
    rows = spark.createDataFrame(chain + waves, "gap double, record string, r_id long, d_id long")
    got = {(r["record"], r["r_id"], r["d_id"]) for r in matching.nearest_matches(rows, "record", 9.0).collect()}
    assert got == greedy_pairs(chain + waves)
    assert len(written) < 40


def test_dense_pairs_are_matched_greedily(spark):
    rng = random.Random(4)
    pairs = {(r, d): rng.randint(0, 12) for r in range(120) for d in range(max(0, r - 6), r + 7)}
    pairs = [(float(g), "x", r, d) for (r, d), g in pairs.items()]
    rows = spark.createDataFrame(pairs, "gap double, record string, r_id long, d_id long")
    for rounds in (0, 2):
        assert {("x", r["r_id"], r["d_id"]) for r in matching.nearest_matches(rows, "record", 9.0, rounds).collect()} == greedy_pairs(pairs)


def test_slices_follow_the_data(spark, monkeypatch):
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10_007)).cast("double").alias("v"), F.col("id"))
    assert windows.cut_points(df, "v") == []
    cuts = windows.cut_points(df, "v", rows=500)
    sizes = [r["count"] for r in df.groupBy(windows.slice_of(F.col("v"), cuts).alias("s")).count().collect()]
    assert len(sizes) == 80 and max(sizes) < 1000
    checked = spark.createDataFrame([(v,) for v in [-1.0, cuts[0], cuts[0] + 1e-9, cuts[-1], 1e9]], "v double").select(windows.slice_of(F.col("v"), cuts)).collect()
    assert [r[0] for r in checked] == [sum(c <= v for c in cuts) for v in [-1.0, cuts[0], cuts[0] + 1e-9, cuts[-1], 1e9]]
    want = df.agg(*(F.percentile("v", p).alias(str(i)) for i, p in enumerate([0.0, 0.013, 0.5, 1.0]))).first()
    for rows in (None, 300):
        assert windows.quantiles(df, "k", "v", [0.0, 0.013, 0.5, 1.0], rows=rows).first()["q"] == pytest.approx(list(want))
        sums = windows.running_sums(df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")), "k", "v", ["n"], rows=rows).orderBy(F.col("v").desc()).collect()
        assert [r["cum_n"] for r in sums] == np.cumsum([r["n"] for r in sums]).tolist()
