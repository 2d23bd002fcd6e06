"""Queries over predictions: three deterministic classifiers answer for every event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, experiments, learning, tables, windows
from ..session import table
from .registry import query

CLASSES = ["click", "error", "purchase", "signup", "view"]
#: Each classifier is right where (event_id * a) % 100 < b, and else answers by event_id and an offset.
RULES = {"dt": (37, 55, 3), "lr": (53, 70, 1), "svc": (71, 74, 2)}
PRED = "p AS (SELECT event_id, user_id AS patient, value AS score, clf, event_type AS y_true, CASE WHEN (event_id * a) % 100 < b THEN event_type " \
       "ELSE ['click', 'error', 'purchase', 'signup', 'view'][((event_id + o) % 5) + 1] END AS y_pred FROM events " \
       "CROSS JOIN (VALUES ('dt', 37, 55, 3), ('lr', 53, 70, 1), ('svc', 71, 74, 2)) AS r(clf, a, b, o))"
BYCLASS = f"""{PRED}, l AS (SELECT clf, y_true AS label FROM p UNION SELECT clf, y_pred FROM p),
    c AS (SELECT l.clf, l.label, (SELECT count(*) FROM p WHERE p.clf = l.clf AND y_true = l.label) AS support, (SELECT count(*) FROM p WHERE p.clf = l.clf AND y_pred = l.label) AS predicted,
          (SELECT count(*) FROM p WHERE p.clf = l.clf AND y_true = l.label AND y_pred = l.label) AS tp FROM l),
    f AS (SELECT *, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(support + predicted, 0), 0) AS f1 FROM c)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("patient"), F.col("value").alias("score"), F.col("event_type").alias("y_true"))
    answer = lambda a, b, o: F.when((F.col("event_id") * a) % 100 < b, F.col("y_true")).otherwise(F.get(F.array(*map(F.lit, CLASSES)), ((F.col("event_id") + o) % 5).cast("int")))
    all_ = F.array(*(F.struct(F.lit(k).alias("clf"), answer(*v).alias("y_pred")) for k, v in RULES.items()))
    return rows.withColumn("_r", F.explode(all_)).select("event_id", "patient", "score", "y_true", "_r.clf", "_r.y_pred")


def counts(spark, sf_dir):
    return evaluation.confusion(predictions(spark, sf_dir), ["clf"])


def _round(df, n, *cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query(f"WITH {PRED} SELECT clf, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark, sf_dir):
    return counts(spark, sf_dir)


METRICS = "round(sum(tp)::DOUBLE / sum(support), 6) AS acc, round(sum(f1 * support) / sum(support), 6) AS f1_weighted"


@query(f"WITH {BYCLASS} SELECT clf, {METRICS}, round(avg(f1), 6) AS f1_macro FROM f GROUP BY clf")
def metrics_acc_f1(spark, sf_dir):
    return _round(evaluation.scores(counts(spark, sf_dir), ["clf"]), 6, "acc", "f1_weighted", "f1_macro")


@query(f"WITH {BYCLASS} SELECT clf, {METRICS}, round(avg(f1) FILTER (WHERE label <> 'error'), 6) AS f1_macro FROM f GROUP BY clf")
def f1_macro_subset(spark, sf_dir):
    return _round(evaluation.scores(counts(spark, sf_dir), ["clf"], [c for c in CLASSES if c != "error"]), 6, "acc", "f1_weighted", "f1_macro")


@query(f"WITH {BYCLASS} SELECT clf, label, support::BIGINT AS support, round(recall, 6) AS recall FROM f WHERE support > 0")
def recall_per_class(spark, sf_dir):
    return _round(evaluation.by_class(counts(spark, sf_dir), ["clf"]).where("support > 0").select("clf", "label", "support", "recall"), 6, "recall")


@query(f"WITH {PRED} SELECT patient, clf, round(avg((y_true = y_pred)::INTEGER), 6) AS acc, count(*) AS n FROM p GROUP BY ALL")
def patientwise_acc(spark, sf_dir):
    return patient_accuracy(predictions(spark, sf_dir))


def patient_accuracy(pred):
    return pred.groupBy("patient", "clf").agg(F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")), 6).alias("acc"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PRED}, a AS (SELECT patient, clf, round(avg((y_true = y_pred)::INTEGER), 6) AS acc FROM p GROUP BY ALL),
    d AS (SELECT x.clf AS clf_a, y.clf AS clf_b, x.acc - y.acc AS d FROM a x JOIN a y ON x.patient = y.patient AND x.clf < y.clf)
    SELECT clf_a, clf_b, round(avg(d), 6) AS mean_diff, round(median(d), 6) AS median_diff, count(*) FILTER (WHERE d > 0) AS wins_a,
           count(*) FILTER (WHERE d < 0) AS wins_b, count(*) FILTER (WHERE d = 0) AS ties FROM d GROUP BY ALL""")
def patientwise_paired(spark, sf_dir):
    wide = patient_accuracy(predictions(spark, sf_dir)).groupBy("patient").pivot("clf", sorted(RULES)).agg(F.first("acc"))
    pairs = [F.struct(F.lit(a).alias("clf_a"), F.lit(b).alias("clf_b"), (F.col(a) - F.col(b)).alias("d")) for a in sorted(RULES) for b in sorted(RULES) if a < b]
    d = wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    d = d.withColumn("pair", F.concat_ws(" ", "clf_a", "clf_b"))
    middle = windows.quantiles(d, "pair", "d", [0.5]).select("pair", F.round(F.col("q")[0], 6).alias("median_diff"))
    sums = d.groupBy("pair", "clf_a", "clf_b").agg(F.round(F.avg("d"), 6).alias("mean_diff"), F.count_if(F.col("d") > 0).alias("wins_a"),
                                                   F.count_if(F.col("d") < 0).alias("wins_b"), F.count_if(F.col("d") == 0).alias("ties"))
    return sums.join(middle, "pair").drop("pair")


def _mcnemar(spark, sf_dir):
    return evaluation.mcnemar(predictions(spark, sf_dir).withColumnRenamed("event_id", "id"))


MCNEMAR = f"""{PRED}, t AS (SELECT x.clf AS clf_a, y.clf AS clf_b, count(*) FILTER (WHERE x.y_pred = x.y_true AND y.y_pred = y.y_true) AS both_right,
    count(*) FILTER (WHERE x.y_pred = x.y_true AND y.y_pred <> y.y_true) AS only_a, count(*) FILTER (WHERE x.y_pred <> x.y_true AND y.y_pred = y.y_true) AS only_b,
    count(*) FILTER (WHERE x.y_pred <> x.y_true AND y.y_pred <> y.y_true) AS both_wrong FROM p x JOIN p y ON x.event_id = y.event_id AND x.clf < y.clf GROUP BY ALL)"""


@query(f"WITH {MCNEMAR} SELECT * FROM t")
def mcnemar_table(spark, sf_dir):
    return _mcnemar(spark, sf_dir)


@query(f"""WITH {MCNEMAR} SELECT clf_a, clf_b, round(CASE WHEN only_a + only_b = 0 THEN 0 WHEN only_a + only_b < 25 THEN least(only_a, only_b)
    ELSE (abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) / (only_a + only_b)::DOUBLE END, 6) AS statistic FROM t""")
def mcnemar_stat(spark, sf_dir):
    return _round(evaluation.mcnemar_test(_mcnemar(spark, sf_dir)).select("clf_a", "clf_b", "statistic"), 6, "statistic")


@query(f"""WITH {MCNEMAR}, n AS (SELECT *, only_a + only_b AS n FROM t)
    SELECT clf_a, clf_b, both_right, only_a, only_b, both_wrong, round(CASE WHEN n = 0 THEN 0 WHEN n < 25 THEN least(only_a, only_b)
           ELSE (abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) / n::DOUBLE END, 6) AS statistic, n AS discordant, n > 0 AND n < 25 AS exact FROM n""")
def pairwise_mcnemar(spark, sf_dir):
    """Every pair of classifiers: counts, statistic and which test applies."""
    out = evaluation.mcnemar_test(_mcnemar(spark, sf_dir)).withColumn("discordant", F.col("only_a") + F.col("only_b"))
    return _round(out.withColumn("exact", (F.col("discordant") > 0) & (F.col("discordant") < 25)).drop("p"), 6, "statistic")


@query(None)
def mcnemar_holm(spark, sf_dir):
    """McNemar p of each pair of classifiers, Holm-adjusted; the tails of binomial and chi-square are not in SQL."""
    return evaluation.holm(evaluation.mcnemar_test(_mcnemar(spark, sf_dir)), "p", "clf_a", "clf_b")


@query("""WITH q AS (SELECT event_type AS test, (sum(event_id) % 997)::DOUBLE / 20000 AS p FROM events GROUP BY event_type),
    r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p) AS a FROM q)
    SELECT test, p, round(max(a) OVER (ORDER BY p, test ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS p_holm FROM r""")
def holm(spark, sf_dir):
    tests = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("test")).agg(((F.sum("event_id") % 997) / F.lit(20000.0)).alias("p"))
    return _round(evaluation.holm(tests, "p", "test"), 9, "p_holm")


REPS = 2000
M = 2**31 - 1
POISSON = ", ".join(repr(float(x)) for x in evaluation.POISSON)


@query(f"""WITH {PRED}, g AS (SELECT patient, clf, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL), u AS (SELECT DISTINCT patient FROM p),
    x0 AS (SELECT patient, rep, (patient * 48271 + rep * 69621 + 11) % {M} AS x FROM u CROSS JOIN (SELECT unnest(range({REPS})) AS rep)),
    x1 AS (SELECT patient, rep, (x * x % {M} + rep * 7 + patient) % {M} AS x FROM x0), x2 AS (SELECT patient, rep, (x * x % {M} + rep * 7 + patient) % {M} AS x FROM x1),
    w AS (SELECT patient, rep, len(list_filter([{POISSON}]::DOUBLE[], lambda c: c <= x::DOUBLE / {M}::DOUBLE)) AS times FROM x2),
    c AS (SELECT rep, clf, y_true, y_pred, sum(n * times) AS n FROM g JOIN (SELECT * FROM w WHERE times > 0) USING (patient) GROUP BY ALL),
    l AS (SELECT rep, clf, y_true AS label, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM c UNION ALL SELECT rep, clf, y_pred, 0, n, 0 FROM c),
    f AS (SELECT rep, clf, label, sum(support) AS support, coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(support) + sum(predicted), 0), 0) AS f1 FROM l GROUP BY ALL),
    a AS (SELECT rep, clf, sum(f1 * support) / sum(support) AS s FROM f GROUP BY ALL),
    d AS (SELECT x.clf AS clf_a, y.clf AS clf_b, x.s - y.s AS d FROM a x JOIN a y ON x.rep = y.rep AND x.clf < y.clf),
    t AS (SELECT clf_a, clf_b, avg(d) AS mean_diff, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high,
                 least(1.0, 2 * least(avg((d >= 0)::INTEGER), avg((d <= 0)::INTEGER))) AS p FROM d GROUP BY ALL),
    h AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, clf_a, clf_b) + 1) * p) AS q FROM t)
    SELECT clf_a, clf_b, round(mean_diff, 6) AS mean_diff, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, p,
           max(q) OVER (ORDER BY p, clf_a, clf_b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_holm FROM h""")
def cluster_bootstrap(spark, sf_dir):
    """Weighted F1 of 2000 resamples of patients, by draws that SQL can replay."""
    own = predictions(spark, sf_dir).groupBy("patient", "clf", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return _round(evaluation.bootstrap_test(evaluation.bootstrap(own, REPS), sorted(RULES)), 6, "mean_diff", "ci_low", "ci_high")


@query(f"""WITH {PRED}, f AS (SELECT clf, patient % 5 AS fold, avg((y_true = y_pred)::INTEGER) AS acc FROM p GROUP BY ALL)
    SELECT clf, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd, count(*) AS n,
           round(avg(acc) - 2.7764451051977987 * stddev_samp(acc) / sqrt(count(*)), 6) AS ci_low, round(avg(acc) + 2.7764451051977987 * stddev_samp(acc) / sqrt(count(*)), 6) AS ci_high
    FROM f GROUP BY clf""")
def fold_summary(spark, sf_dir):
    folds = predictions(spark, sf_dir).groupBy("clf", (F.col("patient") % 5).alias("fold")).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("acc"))
    return _round(evaluation.fold_summary(folds, ["clf"], "acc"), 6, "mean", "sd", "ci_low", "ci_high")


SCORED = "s AS (SELECT event_type AS clf, value AS score, (event_id * 13 + floor(value)::BIGINT) % 10 < 3 AS hit FROM events)"
CURVE = f"""{SCORED}, t AS (SELECT clf, score, count(*) FILTER (WHERE hit) AS tp, count(*) AS n FROM s GROUP BY ALL),
    c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY clf) AS pos FROM t WINDOW w AS (PARTITION BY clf ORDER BY score DESC))"""


def scored(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("clf"), F.col("value").alias("score"), ((F.col("event_id") * 13 + F.floor("value")) % 10 < 3).alias("hit"))


@query(f"WITH {CURVE} SELECT clf, score, round(ctp::DOUBLE / cn, 6) AS precision, round(ctp::DOUBLE / pos, 6) AS recall FROM c UNION ALL SELECT DISTINCT clf, NULL, 1.0, 0.0 FROM s")
def pr_curve(spark, sf_dir):
    return _round(evaluation.precision_recall(scored(spark, sf_dir), "clf").select("clf", "score", "precision", "recall"), 6, "precision", "recall")


@query(f"WITH {CURVE} SELECT clf, round(sum(ctp::DOUBLE / cn * tp / pos), 6) AS ap FROM c GROUP BY clf")
def average_precision(spark, sf_dir):
    return _round(evaluation.average_precision(evaluation.precision_recall(scored(spark, sf_dir), "clf"), "clf"), 6, "ap")


POINT = """count(*) FILTER (WHERE hit AND score >= threshold) AS tp, count(*) FILTER (WHERE NOT hit AND score >= threshold) AS fp,
    count(*) FILTER (WHERE hit AND score < threshold) AS fn, count(*) FILTER (WHERE NOT hit AND score < threshold) AS tn"""
RATES = """clf, threshold, tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS ppv, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS sensitivity,
    CASE WHEN tp = 0 THEN 'Infinity'::DOUBLE ELSE round(fp::DOUBLE / tp, 6) END AS fp_per_tp, tp + fp AS n_flagged"""


@query(f"WITH {SCORED}, o AS (SELECT clf, 50.0::DOUBLE AS threshold, {POINT} FROM (SELECT *, 50.0 AS threshold FROM s) GROUP BY clf) SELECT {RATES} FROM o")
def operating_point(spark, sf_dir):
    rows = scored(spark, sf_dir)
    grid = rows.select("clf").distinct().withColumn("grid", F.array(F.lit(50.0)))
    return _round(evaluation.operating_points(rows, grid, "clf"), 6, "ppv", "sensitivity", "fp_per_tp")


@query(f"""WITH {SCORED}, e AS (SELECT clf, quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM s GROUP BY clf),
    g AS (SELECT DISTINCT clf, threshold FROM (SELECT clf, floor((lo + (hi - lo) * i / 14) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS threshold FROM e CROSS JOIN (SELECT unnest(range(15)) AS i) UNION ALL SELECT clf, 0.0 FROM e)),
    o AS (SELECT clf, threshold, {POINT} FROM s JOIN g USING (clf) GROUP BY ALL) SELECT {RATES} FROM o""")
def threshold_sweep(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return _round(evaluation.operating_points(rows, evaluation.sweep_grid(rows, "clf"), "clf"), 6, "ppv", "sensitivity", "fp_per_tp")


@query(f"WITH {PRED}, c AS (SELECT DISTINCT y_true AS c FROM p) SELECT x.c AS a, y.c AS b FROM c x JOIN c y ON x.c < y.c")
def class_pairs(spark, sf_dir):
    """Unordered pairs of classes, formed inside one row of distinct labels."""
    one = table(spark, sf_dir, "events").agg(F.array_sort(F.collect_set("event_type")).alias("c"))
    return one.select(F.explode(F.expr("flatten(transform(c, (x, i) -> transform(slice(c, i + 2, size(c)), y -> struct(x AS a, y AS b))))")).alias("p")).select("p.*")


PAIR_ERRORS = f"""{PRED}, c AS (SELECT DISTINCT y_true AS c FROM p), q AS (SELECT x.c AS a, y.c AS b FROM c x JOIN c y ON x.c < y.c),
    e AS (SELECT clf, q.a, q.b, count(*) AS n, avg((y_true <> y_pred)::INTEGER) AS error FROM p JOIN q ON y_true IN (q.a, q.b) GROUP BY ALL)"""


def _pair_errors(spark, sf_dir):
    """Errors among the rows of two classes, from counts of single classes."""
    own = predictions(spark, sf_dir).groupBy("clf", "y_true").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_true") != F.col("y_pred")).alias("w"))
    one = own.groupBy("clf").agg(F.array_sort(F.collect_list(F.struct("y_true", "n", "w"))).alias("c"))
    pairs = F.expr("flatten(transform(c, (x, i) -> transform(slice(c, i + 2, size(c)), y -> struct(x.y_true AS a, y.y_true AS b, x.n + y.n AS n, x.w + y.w AS w))))")
    return one.select("clf", F.explode(pairs).alias("p")).select("clf", "p.a", "p.b", "p.n", (F.col("p.w") / F.col("p.n")).alias("error"))


@query(f"WITH {PAIR_ERRORS} SELECT clf, a, b, n, round(error, 6) AS error FROM e")
def pair_errors(spark, sf_dir):
    return _round(_pair_errors(spark, sf_dir), 6, "error")


@query(f"""WITH {PAIR_ERRORS}, t AS (SELECT unnest([0.2, 0.25, 0.3, 0.4, 0.5])::DOUBLE AS tolerance)
    SELECT clf, tolerance, count(*) FILTER (WHERE error <= tolerance) AS n_separable, count(*) AS n_pairs, round(avg((error <= tolerance)::INTEGER), 6) AS separable_fraction FROM e CROSS JOIN t GROUP BY ALL""")
def pair_tolerance_sweep(spark, sf_dir):
    """Share of class pairs with an error within each of five tolerances, errors taken once."""
    out = None
    errors = _pair_errors(spark, sf_dir)
    for clf in sorted(RULES):
        part = learning.separable_fraction(errors.where(F.col("clf") == clf), [0.2, 0.25, 0.3, 0.4, 0.5]).withColumn("clf", F.lit(clf))
        out = part if out is None else out.unionByName(part)
    return _round(out, 6, "separable_fraction")


@query(f"""WITH {PRED}, c AS (SELECT patient, clf, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
    l AS (SELECT patient, clf, y_true AS label, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM c UNION ALL SELECT patient, clf, y_pred, 0, n, 0 FROM c),
    f AS (SELECT patient, clf, label, sum(support) AS support, sum(tp) AS tp, coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(support) + sum(predicted), 0), 0) AS f1 FROM l GROUP BY ALL)
    SELECT patient, clf, round(sum(tp)::DOUBLE / sum(support), 6) AS acc, round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro FROM f GROUP BY ALL""")
def patientwise_f1(spark, sf_dir):
    own = evaluation.confusion(predictions(spark, sf_dir), ["patient", "clf"])
    return _round(evaluation.scores(own, ["patient", "clf"]), 6, "acc", "f1_weighted", "f1_macro")


@query(f"""WITH {PRED}, a AS (SELECT patient, clf, round(avg((y_true = y_pred)::INTEGER), 6) AS acc FROM p GROUP BY ALL),
    d AS (SELECT x.clf AS clf_a, y.clf AS clf_b, round(x.acc - y.acc, 6) AS d FROM a x JOIN a y ON x.patient = y.patient AND x.clf < y.clf),
    r AS (SELECT *, rank() OVER (PARTITION BY clf_a, clf_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY clf_a, clf_b, abs(d)) - 1) / 2.0::DOUBLE AS r,
                 count(*) OVER (PARTITION BY clf_a, clf_b, abs(d)) AS c FROM d WHERE d <> 0),
    s AS (SELECT clf_a, clf_b, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus, sum(c::DOUBLE * c - 1) AS ties FROM r GROUP BY ALL)
    SELECT clf_a, clf_b, n, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, least(w_plus, w_minus)::DOUBLE AS statistic,
           round((least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), 6) AS z FROM s""")
def patientwise_wilcoxon(spark, sf_dir):
    """Signed ranks of the patients' differences for each pair of classifiers; p, which is not in SQL, comes with Holm's in the next query."""
    return _round(_signed(spark, sf_dir).drop("p"), 6, "z")


def _signed(spark, sf_dir):
    d = evaluation.pair_differences(patient_accuracy(predictions(spark, sf_dir)), ["patient"], "acc", sorted(RULES))
    return evaluation.signed_ranks(d.withColumn("d", F.round("d", 6)), ["clf_a", "clf_b"])


@query(None)
def patientwise_test(spark, sf_dir):
    """p of the signed ranks, Holm-adjusted."""
    return evaluation.holm(_signed(spark, sf_dir), "p", "clf_a", "clf_b")


@query(f"""WITH {PRED}, a AS (SELECT patient, clf, round(avg((y_true = y_pred)::INTEGER), 6) AS acc FROM p GROUP BY ALL),
    d AS (SELECT x.patient // 20 AS cohort, x.clf AS clf_a, y.clf AS clf_b, round(x.acc - y.acc, 6) AS d FROM a x JOIN a y ON x.patient = y.patient AND x.clf < y.clf),
    r AS (SELECT *, 2 * rank() OVER (PARTITION BY cohort, clf_a, clf_b ORDER BY abs(d)) + count(*) OVER (PARTITION BY cohort, clf_a, clf_b, abs(d)) - 1 AS r FROM d WHERE d <> 0),
    s AS (SELECT cohort, clf_a, clf_b, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0)::BIGINT AS up, coalesce(sum(r) FILTER (WHERE d < 0), 0)::BIGINT AS down, list(r::BIGINT) AS own FROM r GROUP BY ALL),
    e AS (SELECT *, list_reduce(list_prepend([1.0::DOUBLE], list_transform(own, lambda r: [r::DOUBLE])),
        lambda h, r: list_transform(range(1, len(h) + r[1]::BIGINT + 1), lambda i: (coalesce(h[i], 0) + CASE WHEN i > r[1] THEN h[i - r[1]::BIGINT] ELSE 0 END) / 2)) AS ways FROM s)
    SELECT cohort, clf_a, clf_b, n, up / 2.0::DOUBLE AS w_plus, down / 2.0::DOUBLE AS w_minus, least(up, down) / 2.0::DOUBLE AS statistic,
           round(least(1, 2 * list_sum(ways[1:least(up, down) + 1])), 6) AS p FROM e""")
def cohort_signed_ranks(spark, sf_dir):
    """Exact signed-rank tests of each pair of classifiers within cohorts of twenty patients, ties or not."""
    acc = patient_accuracy(predictions(spark, sf_dir)).withColumn("cohort", F.floor(F.col("patient") / 20))
    d = evaluation.pair_differences(acc, ["patient", "cohort"], "acc", sorted(RULES))
    tests = evaluation.signed_ranks(d.withColumn("d", F.round("d", 6)), ["cohort", "clf_a", "clf_b"])
    return _round(tests.select("cohort", "clf_a", "clf_b", "n", "w_plus", "w_minus", "statistic", "p"), 6, "p")


@query(f"""WITH {CURVE}, v AS (SELECT clf, round(sum(ctp::DOUBLE / cn * tp / pos), 6) AS ap FROM c GROUP BY clf), z AS (SELECT clf, count(*) FILTER (WHERE hit) AS n_positive, count(*) AS n_total FROM s GROUP BY clf),
    g AS (SELECT clf, unnest([10.0, 50.0, 100.0])::DOUBLE AS threshold FROM z WHERE clf IN ('error', 'signup')),
    o AS (SELECT clf, threshold, {POINT} FROM s JOIN g USING (clf) GROUP BY ALL) SELECT {RATES}, ap, n_positive, n_total FROM o JOIN v USING (clf) JOIN z USING (clf)""")
def minority_report(spark, sf_dir):
    """Curve and operating points of the two rarest classes side by side."""
    rows = scored(spark, sf_dir).where(F.col("clf").isin("error", "signup"))
    grid = rows.select("clf").distinct().withColumn("grid", F.array(*map(F.lit, (10.0, 50.0, 100.0))))
    return _round(experiments.minority_report(rows, grid, "clf"), 6, "ppv", "sensitivity", "fp_per_tp", "ap")


@query("""SELECT event_type AS clf, count(DISTINCT user_id) AS linear_params, count(*) AS other_params, round(count(*)::DOUBLE / greatest(count(DISTINCT user_id), 1), 1) AS ratio FROM events GROUP BY event_type""")
def cost_ratio(spark, sf_dir):
    """Parameters of two models for each class, and how many times as many the second has."""
    own = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("clf")).agg(F.count_distinct("user_id").alias("linear_params"), F.count(F.lit(1)).alias("other_params"))
    return own.withColumn("ratio", tables.cost_ratio("linear_params", "other_params"))


@query("""WITH d AS (SELECT event_type AS family, avg(value) / 1000 AS delta, CASE WHEN event_type = 'error' THEN 0 ELSE count(*)::DOUBLE / 1000 END AS ms FROM events GROUP BY event_type)
    SELECT family, round(-delta, 6) AS benefit, CASE WHEN family = 'view' THEN NULL ELSE ms END AS ms,
           round(100 * (CASE WHEN family = 'view' THEN NULL ELSE ms END) / (SELECT sum(ms) FROM d WHERE family <> 'view'), 6) AS pct_of_cost,
           round(-delta / nullif(CASE WHEN family = 'view' THEN NULL ELSE ms END, 0), 6) AS benefit_per_ms FROM d""")
def cost_benefit(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg("value") / 1000).alias("delta"), F.count(F.lit(1)).alias("n"))
    deltas = own.select(F.concat(F.lit("drop_"), "event_type").alias("key"), "delta")
    cost = own.where("event_type <> 'view'").select(F.col("event_type").alias("family"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("n") / 1000.0).alias("ms"))
    return _round(tables.cost_benefit(deltas, cost), 6, "benefit", "pct_of_cost", "benefit_per_ms")
