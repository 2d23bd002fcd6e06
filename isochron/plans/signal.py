"""Queries over vectors as signal segments: features, spectra, graphs, geometry, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import doubles
from ..operators import alignment, balance, evaluation, experiments, features, geometry, learning, windows
from ..session import fresh_path, materialize, table
from ..streaming import graph
from .registry import query

FS = 128.0
X = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
LONG = f"{X}, l AS (SELECT vec_id, label, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS x FROM v)"
MOMENTS = f"""{LONG}, m1 AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS m FROM l),
    mo AS (SELECT vec_id, label, avg(x) AS mean, avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak
           FROM m1 GROUP BY vec_id, label)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles("embedding").alias("x"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 20).alias("group"), F.col("label").cast("long").alias("label"), F.col("x").alias("features"))


def _round(df, n, *cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query(f"""WITH {MOMENTS}, z AS (SELECT vec_id, sum(abs(s - p)) / 128.0 AS zcr FROM
           (SELECT vec_id, sign(x) AS s, lag(sign(x)) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM l) GROUP BY vec_id)
    SELECT vec_id, round(mean, 6) AS td_mean, round(sqrt(m2), 6) AS td_std, round(m3 / m2 ** 1.5, 6) AS td_skew, round(m4 / m2 ** 2 - 3, 6) AS td_kurt,
           round(rms, 6) AS td_rms, round(zcr, 6) AS td_zcr FROM mo JOIN z USING (vec_id)""")
def time_features(spark, sf_dir):
    out = features.time_features(vectors(spark, sf_dir), "x")
    cols = ["td_mean", "td_std", "td_skew", "td_kurt", "td_rms", "td_zcr"]
    return _round(out.select("vec_id", *cols), 6, *cols)


DESCRIPTOR = f"{MOMENTS}, e AS (SELECT vec_id, label, [sqrt(m2), rms, m3 / m2 ** 1.5, m4 / m2 ** 2 - 3, peak] AS d FROM mo)"


@query(f"WITH {DESCRIPTOR} SELECT vec_id, round(d[1], 6) AS sd, round(d[2], 6) AS rms, round(d[3], 6) AS skew, round(d[4], 6) AS kurt, round(d[5], 6) AS peak FROM e")
def compact_descriptor(spark, sf_dir):
    out = features.descriptor(vectors(spark, sf_dir), "x")
    return out.select("vec_id", *(F.round(F.col("descriptor")[i], 6).alias(n) for i, n in enumerate(("sd", "rms", "skew", "kurt", "peak"))))


WELCH = f"""{LONG}, w AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS y FROM l),
    k AS (SELECT unnest(range(33)) AS k), ws AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * i / 64)) ** 2) AS s FROM (SELECT unnest(range(64)) AS i)),
    f AS (SELECT vec_id, k, (sum(y * cos(2 * pi() * k * i / 64)) ** 2 + sum(y * sin(2 * pi() * k * i / 64)) ** 2) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / ({FS} * (SELECT s FROM ws)) AS p
          FROM w CROSS JOIN k GROUP BY vec_id, k),
    g AS (SELECT vec_id, k * 2.0::DOUBLE AS hz, p, lag(p) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM f)"""


def _area(lo: float, hi: float) -> str:
    return f"coalesce(sum(p + q) FILTER (WHERE hz - 2 >= {lo} AND hz < {hi}), 0)"


@query(f"""WITH {WELCH}, a AS (SELECT vec_id, coalesce(sum(p + q), 0) + 1e-12 AS whole, {_area(0.5, 5)} AS low, {_area(5, 15)} AS mid, {_area(15, 40)} AS high FROM g GROUP BY vec_id)
    SELECT vec_id, round(low / whole, 6) AS fd_low, round(mid / whole, 6) AS fd_mid, round(high / whole, 6) AS fd_high FROM a""")
def welch_bands(spark, sf_dir):
    out = features.kernel_features(vectors(spark, sf_dir), "x", FS, ("freq",))
    return _round(out.select("vec_id", "fd_low", "fd_mid", "fd_high"), 6, "fd_low", "fd_mid", "fd_high")


@query(f"""WITH {WELCH}, s AS (SELECT vec_id, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-12) AS p FROM f)
    SELECT vec_id, round(-sum(p * ln(p + 1e-12)), 6) AS fd_entropy FROM s GROUP BY vec_id""")
def spectral_entropy(spark, sf_dir):
    return _round(features.kernel_features(vectors(spark, sf_dir), "x", FS, ("freq",)).select("vec_id", "fd_entropy"), 6, "fd_entropy")


@query(f"""WITH {LONG}, a AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id) AS top FROM l),
    b AS (SELECT vec_id, min(i) FILTER (WHERE abs(x) = top) AS peak FROM a GROUP BY vec_id)
    SELECT vec_id, round(max(x) FILTER (WHERE i = peak), 6) AS mp_r_amp, round((max(i) FILTER (WHERE abs(x) >= 0.3::DOUBLE * top) - min(i) FILTER (WHERE abs(x) >= 0.3::DOUBLE * top)) / {FS} * 1000.0, 6)::DOUBLE AS mp_qrs_ms,
           round(sum(x * x) FILTER (WHERE i >= peak - 7 AND i < peak + 7) / (sum(x * x) + 1e-12), 6) AS mp_energy_ratio FROM a JOIN b USING (vec_id) GROUP BY vec_id""")
def morph_features(spark, sf_dir):
    """On the unfiltered segment, which SQL can follow."""
    out = features.kernel_features(vectors(spark, sf_dir), "x", FS, ("morph",), filtered=False)
    cols = ["mp_r_amp", "mp_qrs_ms", "mp_energy_ratio"]
    return _round(out.select("vec_id", *cols), 6, *cols)


@query(None)
def morph_features_filtered(spark, sf_dir):
    out = features.kernel_features(vectors(spark, sf_dir), "x", FS, ("morph",))
    return out.select("vec_id", "mp_r_amp", "mp_qrs_ms", "mp_energy_ratio")


def _wavelet_sql() -> str:
    from ..functions.kernels import DB4

    low = ", ".join(f"({j}, {c!r}::DOUBLE, {(-1) ** (7 - j) * -1 * DB4[7 - j]!r}::DOUBLE)".replace("np.float64(", "(") for j, c in enumerate(DB4.tolist()))
    parts, n = [f"{LONG}, h(j, lo, hi) AS (VALUES {low}), a0 AS (SELECT vec_id, i, x FROM l)"], 64
    for level in range(1, 5):
        out = (n + 7) // 2
        parts.append(f"""k{level} AS (SELECT k, lo, hi, CASE WHEN ((2 * k + 1 - j) % {2 * n} + {2 * n}) % {2 * n} >= {n} THEN {2 * n} - 1 - ((2 * k + 1 - j) % {2 * n} + {2 * n}) % {2 * n}
                         ELSE ((2 * k + 1 - j) % {2 * n} + {2 * n}) % {2 * n} END AS i FROM (SELECT unnest(range({out})) AS k) CROSS JOIN h),
                         b{level} AS (SELECT vec_id, k AS i, sum(x * lo) AS x, sum(x * hi) AS d FROM a{level - 1} JOIN k{level} USING (i) GROUP BY vec_id, k),
                         a{level} AS (SELECT vec_id, i, x FROM b{level}), e{level} AS (SELECT vec_id, ln(1 + sum(d * d)) AS d{level} FROM b{level} GROUP BY vec_id)""")
        n = out
    return "WITH " + ", ".join(parts) + """, ea AS (SELECT vec_id, ln(1 + sum(x * x)) AS a4 FROM a4 GROUP BY vec_id)
        SELECT vec_id, round(a4, 6) AS wv_A4, round(d4, 6) AS wv_D4, round(d3, 6) AS wv_D3, round(d2, 6) AS wv_D2, round(d1, 6) AS wv_D1
        FROM ea JOIN e1 USING (vec_id) JOIN e2 USING (vec_id) JOIN e3 USING (vec_id) JOIN e4 USING (vec_id)"""


@query(_wavelet_sql())
def wavelet_energy(spark, sf_dir):
    out = features.kernel_features(vectors(spark, sf_dir), "x", FS, ("wavelet",))
    cols = ["wv_A4", "wv_D4", "wv_D3", "wv_D2", "wv_D1"]
    return _round(out.select("vec_id", *cols), 6, *cols)


EDGES = f"""{DESCRIPTOR}, n AS (SELECT label AS record, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS j, d FROM e),
    g AS (SELECT a.record, a.j AS i, b.j AS j, greatest(0, list_dot_product(a.d, b.d) / (sqrt(list_dot_product(a.d, a.d)) * sqrt(list_dot_product(b.d, b.d)) + 1e-12)) * exp(-(b.j - a.j) / 8.0) AS w
          FROM n a JOIN n b ON a.record = b.record AND a.j BETWEEN b.j - 15 AND b.j - 1)"""


def described(spark, sf_dir):
    return features.descriptor(vectors(spark, sf_dir), "x").withColumnRenamed("label", "record")


@query(f"WITH {EDGES} SELECT record, i, j, round(w, 6) AS w FROM g")
def graph_edges(spark, sf_dir):
    out = features.edges(described(spark, sf_dir), "record", ["vec_id"])
    return _round(out.select("record", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "w"), 6, "w")


@query(f"WITH {EDGES} SELECT n.vec_id, round(CASE WHEN n.j < 2 THEN 0 ELSE coalesce(sum(w), 0) END, 6) AS gr_wdegree FROM n LEFT JOIN g ON g.record = n.record AND g.j = n.j GROUP BY n.vec_id, n.j")
def graph_wdeg(spark, sf_dir):
    """From the shared edges: a beat's degree is a grouped sum."""
    own = described(spark, sf_dir)
    place = own.select("record", "vec_id", (F.row_number().over(windows.along("record", "vec_id")) - 1).alias("j"))
    sums = features.edges(own, "record", ["vec_id"]).groupBy("record", "j").agg(F.sum("w").alias("w"))
    out = place.join(sums, ["record", "j"], "left")
    return out.select("vec_id", F.round(F.when(F.col("j") < 2, 0.0).otherwise(F.coalesce("w", F.lit(0.0))), 6).alias("gr_wdegree"))


@query(f"""WITH {EDGES}, t AS (SELECT n.vec_id, n.record, n.j FROM n WHERE n.j >= 2),
    m AS (SELECT t.vec_id, max(w) AS top FROM t JOIN g ON g.record = t.record AND g.j BETWEEN t.j - 14 AND t.j AND g.i BETWEEN t.j - 15 AND t.j GROUP BY t.vec_id),
    d AS (SELECT t.vec_id, count(*) FILTER (WHERE w > 0) AS deg FROM t JOIN g ON g.record = t.record AND g.j = t.j GROUP BY t.vec_id),
    c AS (SELECT t.vec_id, sum(cbrt(x.w * y.w * z.w)) AS s FROM t JOIN g x ON x.record = t.record AND x.j = t.j JOIN g y ON y.record = t.record AND y.j = t.j AND y.i > x.i
          JOIN g z ON z.record = t.record AND z.i = x.i AND z.j = y.i GROUP BY t.vec_id)
    SELECT n.vec_id, round(CASE WHEN n.j < 2 OR coalesce(deg, 0) < 2 OR coalesce(top, 0) = 0 THEN 0 ELSE 2 * coalesce(s, 0) / top / (deg * (deg - 1)) END, 6) AS gr_clustering
    FROM n LEFT JOIN m USING (vec_id) LEFT JOIN d USING (vec_id) LEFT JOIN c USING (vec_id)""")
def graph_clustering(spark, sf_dir):
    return _round(features.graph_features(described(spark, sf_dir), "record", ["vec_id"]).select("vec_id", "gr_clustering"), 6, "gr_clustering")


@query(None)
def graph_pagerank(spark, sf_dir):
    return features.graph_features(described(spark, sf_dir), "record", ["vec_id"]).select("vec_id", "gr_pagerank")


@query(f"""WITH {EDGES}, r AS (SELECT record, vec_id, j, vec_id - lag(vec_id) OVER (PARTITION BY record ORDER BY j) AS rr FROM n),
    m AS (SELECT *, avg(rr) OVER (PARTITION BY record ORDER BY j ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS mean_rr FROM r)
    SELECT m.vec_id, m.j::INTEGER AS pos, round(coalesce(mean_rr, 0), 6) AS mean_rr, round(CASE WHEN m.j < 2 THEN 0 ELSE coalesce(sum(w), 0) END, 6) AS gr_wdegree
    FROM m LEFT JOIN g ON g.record = m.record AND g.j = m.j GROUP BY m.vec_id, m.j, mean_rr""")
def stream_beats(spark, sf_dir):
    """Rhythm and graph of each arriving beat: the table is read as a stream, a second between ids, labels as records."""
    path = f"{sf_dir}/embeddings.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a file or a folder of them
    beats = stream.select(F.col("label").alias("record"), F.col("vec_id").alias("event_id"), F.timestamp_seconds(F.col("vec_id") + 1).alias("ts"), doubles("embedding").alias("x"))
    out = graph.beat_features(features.descriptor(beats, "x"), "0 seconds", idle=1e9)
    to = fresh_path(spark, "stream-beats")
    out.writeStream.format("parquet").option("path", to).option("checkpointLocation", fresh_path(spark, "stream-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(to)
    return _round(got.select(F.col("event_id").alias("vec_id"), "pos", "mean_rr", "gr_wdegree"), 6, "mean_rr", "gr_wdegree")


STANDARD = f"{LONG}, z AS (SELECT vec_id, label, i, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END AS x FROM l WINDOW w AS (PARTITION BY i))"
CELLS = f"""{STANDARD}, c AS (SELECT label, i, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM z GROUP BY label, i)"""


def standard(spark, sf_dir):
    return geometry.standardized(geometry.long(rows(spark, sf_dir)))


@query(f"WITH {STANDARD} SELECT vec_id AS id, i AS dim, round(x, 6) AS x FROM z")
def standardize(spark, sf_dir):
    return _round(standard(spark, sf_dir).select("id", F.col("dim").cast("long").alias("dim"), "x"), 6, "x")


SCATTER = f"""{CELLS}, g AS (SELECT i, sum(n * m) / sum(n) AS g FROM c GROUP BY i),
    s AS (SELECT sum(n * (m - g) * (m - g)) AS b, sum(n * v) AS w, count(DISTINCT label) AS k, (SELECT count(*) FROM v) AS n FROM c JOIN g USING (i))"""


@query(f"WITH {SCATTER} SELECT round(b, 4) AS between, round(w, 4) AS within, round(b / (w + 1e-12), 6) AS fisher FROM s")
def fisher_trace(spark, sf_dir):
    out = geometry.scatter(standard(spark, sf_dir)).select("between", "within", "fisher")
    return _round(_round(out, 4, "between", "within"), 6, "fisher")


@query(f"WITH {SCATTER} SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM s")
def calinski_harabasz(spark, sf_dir):
    return _round(geometry.scatter(standard(spark, sf_dir)).select("calinski_harabasz"), 6, "calinski_harabasz")


@query(f"""WITH {CELLS}, d AS (SELECT vec_id, z.label, sqrt(sum((x - m) * (x - m))) AS d FROM z JOIN c ON z.label = c.label AND z.i = c.i GROUP BY vec_id, z.label),
    s AS (SELECT label, avg(d) AS s FROM d GROUP BY label), p AS (SELECT a.label, b.label AS other, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
    r AS (SELECT p.label, max((s.s + t.s) / gap) AS r FROM p JOIN s ON s.label = p.label JOIN s t ON t.label = p.other GROUP BY p.label)
    SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def davies_bouldin(spark, sf_dir):
    return _round(geometry.davies_bouldin(standard(spark, sf_dir)), 6, "davies_bouldin")


SILHOUETTE = f"""{X}, d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY ALL),
    q AS (SELECT vec_id, label, max(s / n) FILTER (WHERE other = label) AS a, min(s / n) FILTER (WHERE other <> label) AS b FROM d GROUP BY ALL),
    h AS (SELECT vec_id AS id, label, coalesce((b - a) / greatest(a, b), 0) AS s FROM q)"""


def _silhouettes(spark, sf_dir):
    return geometry.silhouettes(rows(spark, sf_dir))


@query(f"WITH {SILHOUETTE} SELECT id, round(s, 6) AS silhouette FROM h")
def silhouette(spark, sf_dir):
    return _round(_silhouettes(spark, sf_dir).select("id", "silhouette"), 6, "silhouette")


@query(f"WITH {SILHOUETTE} SELECT label::BIGINT AS label, round(avg(s), 6) AS silhouette, count(*) AS n FROM h GROUP BY label")
def per_class_silhouette(spark, sf_dir):
    return _silhouettes(spark, sf_dir).groupBy("label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LONG}, c AS (SELECT label, i, avg(x) AS m FROM l GROUP BY label, i), s AS (SELECT vec_id, c.label, -sum((x - m) * (x - m)) AS s FROM l JOIN c USING (i) GROUP BY vec_id, c.label),
    r AS (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS r FROM s)
    SELECT vec_id AS id, round(max(s) FILTER (WHERE r = 1) - max(s) FILTER (WHERE r = 2), 6) AS margin FROM r GROUP BY vec_id""")
def top_margin(spark, sf_dir):
    """Scores are negative squared distances from class centres."""
    long = geometry.long(rows(spark, sf_dir))
    centres = long.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    near = long.drop("label").join(F.broadcast(centres), "dim")  # classes x dimensions
    s = near.groupBy("id", "label").agg((-F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("s"))
    own = s.groupBy("id").agg(F.collect_list("s").alias("scores"))
    return _round(geometry.top_margin(own, "scores").select("id", "margin"), 6, "margin")


@query("""WITH c AS (SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label, n AS before, (SELECT max(n) FROM c) AS after FROM c""")
def smote_counts(spark, sf_dir):
    own = rows(spark, sf_dir)
    after = balance.class_counts(balance.oversample(own)).withColumnRenamed("n", "after")
    return balance.class_counts(own).withColumnRenamed("n", "before").join(after, "label")


@query(None)
def balance_stages(spark, sf_dir):
    return balance.stages(rows(spark, sf_dir))


@query(f"""WITH {X}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, sum((x.x - y.x) ** 2) AS d2 FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 10 = 0
    JOIN (SELECT vec_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM v) x ON x.vec_id = a.vec_id JOIN (SELECT vec_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM v) y ON y.vec_id = b.vec_id AND x.i = y.i GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, id)::INTEGER AS rank FROM p) SELECT query, id, rank FROM r WHERE rank <= 3""")
def nearest_neighbours(spark, sf_dir):
    own = rows(spark, sf_dir)
    return geometry.neighbours(own.where("id % 10 = 0"), own, 3).select("query", "id", "rank")


@query(f"""WITH {X}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id)::INTEGER AS rank FROM p) SELECT query, id, rank, round(d, 5) AS d FROM r WHERE rank <= 5""")
def neighbour_lists(spark, sf_dir):
    """Five nearest rows of every row, by cells around pivots."""
    own = rows(spark, sf_dir)
    return geometry.neighbours(own, own, 5, block=256).select("query", "id", "rank", F.round(F.sqrt("d2"), 5).alias("d"))


def _psi(x: str) -> str:
    steps = " - ".join(f"1 / ({x} + {i})" for i in range(8))
    return f"(ln({x} + 8) - 1 / (2 * ({x} + 8)) - 1 / (12 * ({x} + 8) ** 2) + 1 / (120 * ({x} + 8) ** 4) - 1 / (252 * ({x} + 8) ** 6) - {steps})"


@query(f"""WITH {LONG}, n AS (SELECT vec_id, label, i, x, count(*) OVER (PARTITION BY i, label) AS n, row_number() OVER (PARTITION BY i, label ORDER BY x, vec_id) AS r FROM l),
    d AS (SELECT a.vec_id, a.i, a.x, a.n, b.x AS near, row_number() OVER (PARTITION BY a.i, a.vec_id ORDER BY abs(b.x - a.x), b.x) AS k FROM n a
          JOIN n b ON a.i = b.i AND a.label = b.label AND b.r BETWEEN a.r - 3 AND a.r + 3 AND b.r <> a.r),
    q AS (SELECT vec_id, i, x, n::DOUBLE AS n, least(3, n - 1)::DOUBLE AS k, near, CASE WHEN near < x THEN near ELSE x - abs(near - x) END AS lo, CASE WHEN near > x THEN near ELSE x + abs(near - x) END AS hi
          FROM d WHERE k = least(3, n - 1)),
    m AS (SELECT q.vec_id, q.i, q.n, q.k, count(*)::DOUBLE AS m FROM q JOIN l ON l.i = q.i AND (l.x > q.lo AND l.x < q.hi OR q.near = q.x AND l.x = q.x) GROUP BY ALL),
    s AS (SELECT i, greatest(0, {_psi("count(*)::DOUBLE")} + avg({_psi("k")} - {_psi("n")} - {_psi("m")})) AS mi FROM m GROUP BY i)
    SELECT i AS feature, round(mi, 6) AS mi FROM s""")
def neighbour_information(spark, sf_dir):
    """Mutual information of each component with the label, by nearest neighbours in one dimension."""
    out = learning.neighbour_information(rows(spark, sf_dir), keep=1 << 30)
    return out.select(F.col("feature").cast("long").alias("feature"), F.round("mi", 6).alias("mi"))


COEF = f"""{LONG}, k AS (SELECT label, i, avg(x) AS value FROM l GROUP BY label, i), bi AS (SELECT CASE WHEN i % 3 = 0 THEN 'low' WHEN i % 3 = 1 THEN 'mid' ELSE 'high' END AS band, abs(value) AS a, label FROM k),
    bw AS (SELECT band, sum(a) AS w, sum(a) FILTER (WHERE label < 5) AS h FROM bi GROUP BY band), im AS (SELECT band, w / sum(w) OVER () AS x, h / sum(h) OVER () AS y FROM bw)"""


def _importances(spark, sf_dir):
    coef = geometry.long(rows(spark, sf_dir)).groupBy(F.col("label").alias("class"), F.col("dim").alias("feature")).agg(F.avg("x").alias("value"))
    bands = coef.select("feature").distinct().withColumn("band", F.get(F.array(*map(F.lit, ("low", "mid", "high"))), F.col("feature") % 3))
    return alignment.band_importance(coef, bands), alignment.band_importance(coef.where("class < 5"), bands)


@query(f"WITH {COEF} SELECT band, round(x, 6) AS importance FROM im")
def band_importance(spark, sf_dir):
    return _round(_importances(spark, sf_dir)[0], 6, "importance")


@query(f"""WITH {COEF}, r AS (SELECT *, rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM im)
    SELECT round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)) + 1e-12), 6) AS cosine, round(corr(rx, ry), 6) AS spearman, arg_max(band, x) = arg_max(band, y) AS same_top FROM r""")
def band_agreement(spark, sf_dir):
    return _round(alignment.agreement(*_importances(spark, sf_dir)), 6, "cosine", "spearman")


@query(None)
def linear_holdout(spark, sf_dir):
    """Scores of the linear classifiers on held-out groups."""
    own = rows(spark, sf_dir)
    train, test = own.where("group >= 6"), own.where("group < 6")
    return learning.evaluate(train, test, "svc").unionByName(learning.evaluate(train, test, "lr"))


@query(None)
def cross_validation(spark, sf_dir):
    return learning.cross_validate(rows(spark, sf_dir), "svc", folds=5)


@query(f"""WITH {COEF}, m AS (SELECT i, CASE WHEN i % 4 < 3 THEN ['time', 'freq', 'morph'][i % 4 + 1] END AS family, CASE WHEN i % 2 = 0 THEN ['low', 'mid', 'high'][i % 3 + 1] END AS band FROM (SELECT DISTINCT i FROM k))
    SELECT label::BIGINT AS class, i AS feature, round(value, 6) AS value, family, band FROM k JOIN m USING (i)""")
def coefficient_meta(spark, sf_dir):
    """Coefficients with their feature's family and band, null where it has none."""
    coef = geometry.long(rows(spark, sf_dir)).groupBy(F.col("label").alias("class"), F.col("dim").cast("long").alias("feature")).agg(F.avg("x").alias("value"))
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("feature") % n).cast("int"))
    meta = coef.select("feature").distinct().select("feature", F.when(F.col("feature") % 4 < 3, pick(("time", "freq", "morph"), 4)).alias("family"),
                                                    F.when(F.col("feature") % 2 == 0, pick(("low", "mid", "high"), 3)).alias("band"))
    return _round(alignment.with_meta(coef, meta), 6, "value")


ATTR = f"""{WELCH}, ar AS (SELECT vec_id, {_area(0.5, 5)} AS low, {_area(5, 15)} AS mid, {_area(15, 40)} AS high FROM g GROUP BY vec_id)"""


@query(f"""WITH {ATTR}, t AS (SELECT sum(low) AS low, sum(mid) AS mid, sum(high) AS high FROM ar), u AS (SELECT unnest(['low', 'mid', 'high']) AS band, unnest([low, mid, high]) AS w FROM t)
    SELECT band, round(w / sum(w) OVER (), 6) AS importance FROM u""")
def attribution_importance(spark, sf_dir):
    """Vectors as attributions: each band's share of their power."""
    return _round(alignment.attribution_importance(vectors(spark, sf_dir), "x", FS), 6, "importance")


GIVEN = {"low": 0.1, "mid": 0.3, "high": 0.6}


@query(f"""WITH {ATTR}, c AS (SELECT vec_id, (0.1::DOUBLE * low + 0.3::DOUBLE * mid + 0.6::DOUBLE * high) / (sqrt(low * low + mid * mid + high * high) * sqrt(0.46::DOUBLE) + 1e-12) AS c FROM ar),
    x0 AS (SELECT vec_id AS p, rep, c, (vec_id * 48271 + rep * 69621 + 11) % 2147483647 AS x FROM c CROSS JOIN (SELECT unnest(range(2000)) AS rep)),
    x1 AS (SELECT p, rep, c, (x * x % 2147483647 + rep * 7 + p) % 2147483647 AS x FROM x0), x2 AS (SELECT p, rep, c, (x * x % 2147483647 + rep * 7 + p) % 2147483647 AS x FROM x1),
    dr AS (SELECT rep, c, len(list_filter({[float(x) for x in evaluation.POISSON]}::DOUBLE[], lambda v: v <= x::DOUBLE / 2147483647.0::DOUBLE)) AS t FROM x2),
    b AS (SELECT rep, sum(t * c) / sum(t) AS m FROM dr GROUP BY rep),
    sm AS (SELECT avg(low / (low + mid + high)) AS l, avg(mid / (low + mid + high)) AS m, avg(high / (low + mid + high)) AS h FROM ar),
    q AS (SELECT i, (z[1] * l + z[2] * m + z[3] * h) / (sqrt(0.46::DOUBLE) * sqrt(l * l + m * m + h * h) + 1e-12) AS c FROM sm CROSS JOIN
          (SELECT unnest(range(6)) AS i, unnest([[0.1, 0.3, 0.6], [0.1, 0.6, 0.3], [0.3, 0.1, 0.6], [0.3, 0.6, 0.1], [0.6, 0.1, 0.3], [0.6, 0.3, 0.1]]::DOUBLE[][]) AS z)),
    n AS (SELECT q.c, (SELECT c FROM q WHERE i = 0) AS o FROM (SELECT unnest(range(2000)) AS rep) JOIN q ON q.i = rep * 48271 % 2147483647 % 6)
    SELECT round((SELECT avg(c) FROM c), 6) AS mean_cosine, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high,
           round((SELECT any_value(o) FROM n), 6) AS observed_cosine, (SELECT (count(*) FILTER (WHERE c >= o - 1e-15) + 1) / 2001.0::DOUBLE FROM n) AS p, round((SELECT avg(c) FROM n), 6) AS null_mean FROM b""")
def alignment_significance(spark, sf_dir):
    """Bootstrap of the vectors' cosines with a given importance, and its permutation null."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", doubles("embedding").alias("x"))
    return _round(alignment.significance(own, "vec_id", "x", GIVEN, FS, 2000), 6, "mean_cosine", "ci_low", "ci_high", "observed_cosine", "null_mean")


@query(f"""WITH {LONG}, c AS (SELECT i, unnest([{", ".join(f"quantile_cont(x, {i} / 16.0)" for i in range(1, 16))}]) AS c FROM l GROUP BY i),
    b AS (SELECT l.vec_id, l.label, l.i, count(*) FILTER (WHERE c.c < l.x) AS bin FROM l JOIN c USING (i) GROUP BY ALL),
    n AS (SELECT i, bin, label, count(*) AS n FROM b GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY i, bin) AS sb, sum(n) OVER (PARTITION BY i, label) AS sl, sum(n) OVER (PARTITION BY i) AS st FROM n)
    SELECT i AS feature, round(sum(n / st * ln(n * st / (sb * sl))), 6) AS mi FROM s GROUP BY i""")
def mutual_information(spark, sf_dir):
    """Mutual information of each component's bins with the label; as many are kept as there are."""
    out = learning.mutual_information(rows(spark, sf_dir), 16, keep=1_000_000)
    return _round(out.select(F.col("feature").cast("long").alias("feature"), "mi"), 6, "mi")


def _kept(spark, sf_dir):
    return materialize(rows(spark, sf_dir), "rows")


@query(None)
def train_separability(spark, sf_dir):
    """Training accuracy and margins of a nearly hard-margin linear classifier."""
    return learning.train_separability(_kept(spark, sf_dir))


@query(None)
def pairwise_separable(spark, sf_dir):
    """Training error of a trained linear classifier for each pair of classes."""
    return learning.pair_errors(_kept(spark, sf_dir))


@query(None)
def separable_sweep(spark, sf_dir):
    """Share of class pairs that a trained classifier separates within each tolerance."""
    return learning.separable_fraction(learning.pair_errors(_kept(spark, sf_dir)), [0.005, 0.01, 0.025, 0.05, 0.10])


@query(None)
def separability_report(spark, sf_dir):
    return experiments.separability(_kept(spark, sf_dir), folds=5)


@query(None)
def kernel_gap(spark, sf_dir):
    """What kernel machines of several widths gain over the plain linear classifier on the same five folds, with interval and paired tests."""
    return learning.gaps(learning.fold_scores(_kept(spark, sf_dir), ["linear", "rbf", "rbf0.01", "rbf0.1", "rbf1"], 5))


@query(None)
def nonlinear_headroom(spark, sf_dir):
    """Gaps of neighbours, a forest of 200 trees and a perceptron over the linear classifier; kernel_gap has the kernel machines."""
    return learning.gaps(learning.fold_scores(_kept(spark, sf_dir), ["linear", "knn", "rf200", "mlp"], 5))


@query(None)
def paired_fold_tests(spark, sf_dir):
    """Differences of classifiers on the same folds: paired t and signed ranks, Holm-adjusted."""
    return learning.paired_tests(learning.fold_scores(_kept(spark, sf_dir), ["svc", "lr", "dt"], 5))


@query(None)
def fold_pipeline(spark, sf_dir):
    """Fill, scale, augment, balance and classify, learnt anew from the training rows of each fold."""
    return learning.cross_validate(_kept(spark, sf_dir), "pipeline", 5)


@query("""WITH f AS (SELECT unnest(range(3)) AS fold), c AS (SELECT fold, label::BIGINT AS label, count(*) AS n FROM embeddings JOIN f ON vec_id % 3 <> fold GROUP BY ALL)
    SELECT fold, s.stage, label, CASE WHEN s.stage = 'before' THEN n ELSE max(n) OVER (PARTITION BY fold, s.stage) END AS n FROM c CROSS JOIN (VALUES ('before'), ('oversampled')) s(stage)""")
def balance_per_fold(spark, sf_dir):
    """Class counts of each fold's training rows before and after oversampling; what editing leaves is balance_stages_per_fold."""
    return _stages_per_fold(spark, sf_dir, edit=False)


@query(None)
def balance_stages_per_fold(spark, sf_dir):
    return _stages_per_fold(spark, sf_dir)


def _stages_per_fold(spark, sf_dir, edit=True):
    own = _kept(spark, sf_dir).withColumn("group", F.col("id") % 3)
    folds = spark.range(3).select(F.col("id").alias("group"), F.col("id").cast("int").alias("fold"))
    return balance.stages_per_fold(own, folds, 3, edit).select(F.col("fold").cast("long").alias("fold"), "stage", "label", "n")


def _beats(spark, sf_dir):
    """Vectors as beats of twenty records."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("record"), F.col("label").cast("long").alias("label"), doubles("embedding").alias("segment"))
    return materialize(windows.intervals(own, "record", ["vec_id"], "vec_id"), "beats")


IDS = ("vec_id", "record", "label")


@query(None)
def causal_and_not(spark, sf_dir):
    """Frames of the past against frames that look ahead, on held-out records."""
    return experiments.causal_and_not(_beats(spark, sf_dir), "record", ["vec_id"], "segment", FS, IDS, F.col("group") < 6)


@query(None)
def window_sweep(spark, sf_dir):
    """Scores on held-out records by the width of the frame."""
    return experiments.window_sweep(_beats(spark, sf_dir), "record", ["vec_id"], "segment", FS, IDS, F.col("group") < 6)


@query(None)
def graph_marginal(spark, sf_dir):
    """What the graph family adds to rhythm, and rhythm to the rest."""
    made = features.feature_table(_beats(spark, sf_dir), "record", ["vec_id"], "segment", FS)
    return learning.marginal(experiments.model_rows(made, *IDS), _families(made))


def _families(made: DataFrame) -> dict[str, list[int]]:
    """Which features of a feature table are of each family."""
    families: dict[str, list[int]] = {}
    for i, c in enumerate(features.feature_columns(made)):
        families.setdefault(next(f for p, f in features.PREFIXES.items() if c.startswith(p)), []).append(i)
    return families


@query(None)
def family_ablation(spark, sf_dir):
    """Five folds' weighted F1 with all six families, each dropped and each alone."""
    made = features.feature_table(_beats(spark, sf_dir), "record", ["vec_id"], "segment", FS)
    return learning.ablation(experiments.model_rows(made, *IDS), _families(made))


@query(None)
def leakage_stress(spark, sf_dir):
    """Scores on held-out groups beside those of a stratified random split."""
    own = _kept(spark, sf_dir)
    return learning.leakage_stress(own.where("group >= 6"), own.where("group < 6"))


@query(None)
def family_runtime(spark, sf_dir):
    """Wall time of each family per beat on this machine."""
    return experiments.runtime(_beats(spark, sf_dir), "record", ["vec_id"], "segment", FS)


@query(None)
def alignment_report(spark, sf_dir):
    """A linear model's bands beside those of two columns of attributions."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), doubles("embedding").alias("features"))
    names = [str(i) for i in range(own.select(F.size("features")).first()[0])]
    bands = spark.createDataFrame([(n, ("low", "mid", "high")[int(n) % 3]) for n in names], "feature string, band string")
    both = own.select("features", F.transform("features", F.abs).alias("magnitudes"))
    return alignment.report(learning.fit_linear(own), names, bands, both, ["features", "magnitudes"], FS, 9589)
