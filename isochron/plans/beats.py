"""Queries over ordered events: a user is a record, an event a beat, its type the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import doubles
from ..operators import blocks, evaluation, features, matching, sampling, tables, windows
from ..session import table
from .registry import query

BEATS = "b AS (SELECT user_id AS record, event_id, event_type AS label, value, epoch_us(ts)::DOUBLE / 1e6 AS t FROM events)"
RR = f"""{BEATS}, r AS (SELECT *, (row_number() OVER w - 1)::INTEGER AS pos, t - lag(t) OVER w AS rr_pre, lead(t) OVER w - t AS rr_post
         FROM b WINDOW w AS (PARTITION BY record ORDER BY t, event_id))"""
#: Seconds of a successive difference that counts as a jump.
JUMP = 3600.0
ORDER = ["t", "event_id"]
TYPES = {"view": "N", "click": "S", "purchase": "V", "signup": "F"}


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record"), "event_id", F.col("event_type").alias("label"), "value", windows.seconds().alias("t"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _rhythm(spark: SparkSession, sf_dir: str, causal: bool) -> DataFrame:
    rows = windows.intervals(beats(spark, sf_dir), "record", ORDER, "t")
    out = windows.rhythm(rows, "record", ORDER, width=16, jump=JUMP, causal=causal)
    return rounded(out.select("event_id", "n_rr", "mean_rr", "sdnn", "rmssd", "pnn", "lfhf"), 3, "mean_rr", "sdnn", "rmssd", "pnn")


def _rhythm_sql(after: int) -> str:
    return f"""
        WITH {RR}, d AS (SELECT *, rr_pre - lag(rr_pre) OVER (PARTITION BY record ORDER BY t, event_id) AS d FROM r),
        f AS (SELECT event_id, count(rr_pre) OVER w AS n_rr, avg(rr_pre) OVER w AS m, stddev_pop(rr_pre) OVER w AS s,
                     sqrt(avg(d * d) OVER v) AS q, avg(CASE WHEN abs(d) > {JUMP} THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0.0::DOUBLE END) OVER v AS p
              FROM d WINDOW w AS (PARTITION BY record ORDER BY t, event_id ROWS BETWEEN 15 PRECEDING AND {after} FOLLOWING),
                            v AS (PARTITION BY record ORDER BY t, event_id ROWS BETWEEN 14 PRECEDING AND {after} FOLLOWING))
        SELECT event_id, n_rr::BIGINT AS n_rr, round(coalesce(m, 0), 3) AS mean_rr, round(CASE WHEN n_rr >= 3 THEN s ELSE 0 END, 3) AS sdnn,
               round(CASE WHEN n_rr >= 3 THEN q ELSE 0 END, 3) AS rmssd, round(CASE WHEN n_rr >= 3 THEN p ELSE 0 END, 3) AS pnn,
               CASE WHEN n_rr >= 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lfhf FROM f"""


@query(_rhythm_sql(0))
def hrv_trailing(spark, sf_dir):
    return _rhythm(spark, sf_dir, True)


@query(_rhythm_sql(15))
def acausal_frame(spark, sf_dir):
    return _rhythm(spark, sf_dir, False)


@query(f"WITH {RR} SELECT event_id, record, round(rr_pre, 3) AS rr_pre, round(rr_post, 3) AS rr_post FROM r")
def rr_pre_post(spark, sf_dir):
    out = windows.intervals(beats(spark, sf_dir), "record", ORDER, "t")
    return rounded(out.select("event_id", "record", "rr_pre", "rr_post"), 3, "rr_pre", "rr_post")


@query(f"WITH {RR} SELECT event_id, record, pos FROM r")
def position_in_record(spark, sf_dir):
    return windows.intervals(beats(spark, sf_dir), "record", ORDER, "t").select("event_id", "record", "pos")


@query("""SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 'N' WHEN 'click' THEN 'S' WHEN 'purchase' THEN 'V' ELSE 'F' END AS label
          FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')""")
def symbol_lookup(spark, sf_dir):
    return tables.map_symbols(table(spark, sf_dir, "events"), TYPES, "event_type").select("event_id", "event_type", "label")


@query("""SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
          WHERE event_type IN ('view', 'click', 'purchase', 'signup') GROUP BY event_type""")
def symbol_filter(spark, sf_dir):
    own = tables.map_symbols(table(spark, sf_dir, "events"), TYPES, "event_type")
    return own.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT part, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM
          (SELECT *, CASE WHEN user_id % 10 < 3 THEN 'test' ELSE 'train' END AS part FROM events) GROUP BY part""")
def holdout_semi_anti(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    held = rows.where("user_id % 10 < 3").select("user_id").distinct()
    out = None
    for part, how in (("test", "left_semi"), ("train", "left_anti")):
        own = rows.join(held, "user_id", how).select(F.lit(part).alias("part"), "user_id", "value")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH p AS (SELECT o_custkey AS patient, CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM orders),
               c AS (SELECT patient, part, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT patient, count(*) AS parts FROM c GROUP BY patient)
          SELECT part, count(*) AS patients, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE parts > 1) AS shared FROM c JOIN s USING (patient) GROUP BY part""")
def allocation_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient"), F.when(F.expr("o_orderkey % 3 = 0"), "test").otherwise("train").alias("part"))
    return tables.allocation(rows, "patient", "part")


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type")
def class_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT o_custkey AS patient FROM orders WHERE o_orderkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 <> 0""")
def patient_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient"), "o_orderkey")
    return rows.where("o_orderkey % 3 = 0").select("patient").intersect(rows.where("o_orderkey % 3 <> 0").select("patient"))


@query("""SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND o_totalprice > 100000""")
def record_patient_lookup(spark, sf_dir):
    """Records (orders) to patients (customers) to sites: lookups that must be total."""
    t = lambda n: table(spark, sf_dir, n)
    out = (t("orders").where("o_totalprice > 100000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
           .join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
           .join(F.broadcast(t("region").where("r_name <> 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")))  # 5 rows
    return out.select("o_orderkey", "c_custkey", "n_name", "r_name")


@query(f"""WITH {BEATS}, k AS (SELECT event_id, label, value AS td_value, t - floor(t / 86400) * 86400 AS hrv_daytime FROM b)
           SELECT event_id, round(hrv_daytime, 3) AS hrv_daytime FROM k""")
def family_projection(spark, sf_dir):
    out = beats(spark, sf_dir).select("event_id", F.col("value").alias("td_value"), (F.col("t") - F.floor(F.col("t") / 86400) * 86400).alias("hrv_daytime"))
    return rounded(out.select("event_id", *tables.families(out.columns, features.PREFIXES, {"hrv"})), 3, "hrv_daytime")


@query("""WITH c AS (SELECT DISTINCT user_id AS record, event_type AS lead FROM events),
               i AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY lead) - 1 AS idx FROM c),
               k AS (SELECT *, CASE WHEN lower(lead) = 'view' THEN 1 WHEN lower(lead) = 'none' THEN 2 ELSE 3 + idx END AS place FROM i),
               p AS (SELECT record, lead, row_number() OVER (PARTITION BY record ORDER BY place, idx)::INTEGER AS place FROM k)
          SELECT record, lead, place FROM p WHERE place <= 2""")
def lead_select(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), F.col("event_type").alias("lead")).distinct()
    rows = rows.withColumn("idx", F.row_number().over(windows.along("record", "lead")) - 1)
    return tables.select_leads(rows, "record", "lead", "idx", ["VIEW", "None"]).select("record", "lead", "place")


@query(f"""WITH {RR}, s AS (SELECT *, max(t) OVER (PARTITION BY record) - min(t) OVER (PARTITION BY record) AS length, t - min(t) OVER (PARTITION BY record) AS place FROM r)
           SELECT event_id, record, round(rr_pre, 3) AS rr_pre FROM s WHERE place - 7200 >= 0 AND place + 86400 <= length""")
def edge_filter(spark, sf_dir):
    """Beats whose window leaves the record go, after intervals were taken from all neighbours."""
    from pyspark.sql import Window

    w = Window.partitionBy("record")
    rows = windows.intervals(beats(spark, sf_dir), "record", ORDER, "t")
    rows = rows.withColumns({"length": F.max("t").over(w) - F.min("t").over(w), "at": F.col("t") - F.min("t").over(w)})
    return rounded(tables.inside(rows, "at", "length", 7200, 86400).select("event_id", "record", "rr_pre"), 3, "rr_pre")


@query("""SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 6) AS z FROM events WINDOW w AS (PARTITION BY user_id, event_type)""")
def zscore_by_group(spark, sf_dir):
    return rounded(tables.z_scores(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value").select("event_id", "z"), 6, "z")


@query("""WITH v AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)
          SELECT event_id, coalesce(x, (SELECT median(x) FROM v)) AS x FROM v""")
def median_impute(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.expr("event_id % 7 <> 0"), F.col("value")).alias("x"))
    return features.medians_filled(rows, ["x"])


@query("""SELECT event_type AS label, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99, median(value) AS p50, min(value) AS lo, max(value) AS hi
          FROM events GROUP BY event_type""")
def percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), "value")
    return windows.quantiles(rows, "label", "value", [0.01, 0.99, 0.5, 0.0, 1.0]).select("label", *(F.col("q")[i].alias(n) for i, n in enumerate(("p1", "p99", "p50", "lo", "hi"))))


@query("""WITH RECURSIVE g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
               o AS (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) AS i FROM g),
               f(i, loads, user_id, fold) AS (
                   SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], NULL::BIGINT, NULL::INTEGER
                   UNION ALL
                   SELECT o.i, list_transform(f.loads, lambda x, j: CASE WHEN j = list_position(f.loads, list_min(f.loads)) THEN x + o.n ELSE x END), o.user_id,
                          (list_position(f.loads, list_min(f.loads)) - 1)::INTEGER
                   FROM f JOIN o ON o.i = f.i + 1)
          SELECT user_id, fold FROM f WHERE i > 0""")
def groupkfold(spark, sf_dir):
    return sampling.group_folds(table(spark, sf_dir, "events"), "user_id", 5)


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 7919) % 100003, event_id) AS r,
                     count(*) OVER (PARTITION BY event_type) AS n FROM events)
          SELECT event_id, event_type FROM r WHERE r <= greatest(1, round(n * 0.1))""")
def stratified_sample(spark, sf_dir):
    order = [(F.col("event_id") * 7919) % 100003, F.col("event_id")]
    return sampling.stratified(table(spark, sf_dir, "events"), "event_type", 0.1, order).select("event_id", "event_type")


def _sides(spark, sf_dir):
    own = beats(spark, sf_dir)
    ref = own.where("label = 'view'").select("record", F.col("event_id").alias("r_id"), F.col("t").alias("r_t"), (F.col("r_id") % 4).alias("label"))
    det = own.where("label = 'click'").select("record", F.col("event_id").alias("d_id"), F.col("t").alias("d_t"))
    return ref, det


TOL = 14400.0
PAIRS = f"""{BEATS}, p AS (SELECT x.record, x.event_id AS r_id, y.event_id AS d_id, abs(x.t - y.t) AS gap FROM b x JOIN b y ON x.record = y.record
            AND x.label = 'view' AND y.label = 'click' AND abs(x.t - y.t) <= {TOL})"""


def _greedy_sql(rounds: int = 8) -> str:
    """Pairs that are first for both of their sides are taken, round after round."""
    out, left = [], "p"
    for i in range(rounds):
        out.append(f"""q{i} AS (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY gap, r_id, d_id) AS a,
                       row_number() OVER (PARTITION BY d_id ORDER BY gap, r_id, d_id) AS z FROM {left}),
                       m{i} AS (SELECT record, r_id, d_id, gap FROM q{i} WHERE a = 1 AND z = 1),
                       p{i} AS (SELECT record, r_id, d_id, gap FROM q{i} WHERE r_id NOT IN (SELECT r_id FROM m{i}) AND d_id NOT IN (SELECT d_id FROM m{i}))""")
        left = f"p{i}"
    return ", ".join([PAIRS, *out]) + ", m AS (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(rounds)) + ")"


@query(f"WITH {PAIRS} SELECT record, r_id, d_id, round(gap, 3) AS gap FROM p")
def band_join(spark, sf_dir):
    return rounded(matching.band_join(*_sides(spark, sf_dir), "record", TOL).select("record", "r_id", "d_id", "gap"), 3, "gap")


def _matches(spark, sf_dir):
    ref, det = _sides(spark, sf_dir)
    return ref, det, matching.nearest_matches(matching.band_join(ref, det, "record", TOL), "record", TOL)


@query(f"WITH {_greedy_sql()} SELECT record, r_id, d_id, round(gap, 3) AS gap FROM m")
def nearest_match(spark, sf_dir):
    return rounded(_matches(spark, sf_dir)[2], 3, "gap")


@query(f"WITH {_greedy_sql()} SELECT b.record, b.event_id AS d_id, coalesce((m.r_id % 4)::VARCHAR, '') AS label FROM b LEFT JOIN m ON b.event_id = m.d_id WHERE b.label = 'click'")
def label_transfer(spark, sf_dir):
    ref, det, found = _matches(spark, sf_dir)
    return matching.transfer_labels(det, ref.withColumn("label", F.col("label").cast("string")), found, "record").select("record", "d_id", "label")


@query(f"""WITH {_greedy_sql()}, n AS (SELECT record, count(*) FILTER (WHERE label = 'view') AS nr, count(*) FILTER (WHERE label = 'click') AS nd FROM b GROUP BY record),
           c AS (SELECT record, count(*) AS tp FROM m GROUP BY record),
           s AS (SELECT n.record, coalesce(tp, 0) AS tp, nr, nd, coalesce(tp, 0)::DOUBLE / nullif(nr, 0) AS se, coalesce(tp, 0)::DOUBLE / nullif(nd, 0) AS ppv FROM n LEFT JOIN c USING (record))
           SELECT record, tp, nd - tp AS fp, nr - tp AS fn, round(se, 4) AS se, round(ppv, 4) AS ppv, round(coalesce(2 * se * ppv / nullif(se + ppv, 0), 0), 4) AS f1 FROM s""")
def detection_score(spark, sf_dir):
    ref, det, found = _matches(spark, sf_dir)
    one = lambda df, c: df.select("record", *(F.lit(int(x == c)).alias(x) for x in ("nr", "nd", "tp")))
    sums = one(ref, "nr").unionByName(one(det, "nd")).unionByName(one(found, "tp")).groupBy("record").agg(*(F.sum(c).alias(c) for c in ("nr", "nd", "tp")))
    sums = beats(spark, sf_dir).select("record").distinct().join(sums, "record", "left").fillna(0)
    return sums.select("record", *(v.alias(k) for k, v in matching.detection_score(F.col("nr"), F.col("nd"), F.col("tp")).items()))


@query("""SELECT page_id, regexp_extract(url, '(?i)https?://([^/]+)', 1) AS host,
          CASE WHEN regexp_extract(url, '/([0-9]+)', 1) <> '' THEN 'P' || lpad(regexp_extract(url, '/([0-9]+)', 1), greatest(2, length(regexp_extract(url, '/([0-9]+)', 1)))::INTEGER, '0') ELSE '' END AS patient
          FROM pages""")
def regex_patient_id(spark, sf_dir):
    n = F.regexp_extract("url", r"/([0-9]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"(?i)https?://([^/]+)", 1).alias("host"),
                                                F.when(n != "", F.concat(F.lit("P"), F.expr("lpad(regexp_extract(url, '/([0-9]+)', 1), greatest(2, length(regexp_extract(url, '/([0-9]+)', 1))), '0')"))).otherwise("").alias("patient"))


@query("""SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, json_object('event_id', event_id, 'k', (props::JSON ->> 'k')::BIGINT)::VARCHAR AS packed FROM events""")
def json_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT").k.alias("k"))
    return rows.withColumn("packed", F.to_json(F.struct("event_id", "k")))


@query(None)
def feature_matrix(spark, sf_dir):
    """All six feature families of the vectors, in the order of their ids within a label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("record"), doubles("embedding").alias("segment"))
    rows = windows.intervals(rows, "record", ["vec_id"], "vec_id")
    out = features.feature_table(rows, "record", ["vec_id"], "segment", 128.0)
    return out.select("vec_id", *features.feature_columns(out))


HELD = """g AS (SELECT user_id, md5('13 ' || user_id) AS h FROM (SELECT DISTINCT user_id FROM events)),
          h AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY h, user_id) AS r, count(*) OVER () AS n FROM g) WHERE r <= greatest(1, round(n * 0.3)))"""


@query(f"WITH {HELD} SELECT user_id, count(*) AS n FROM events JOIN h USING (user_id) GROUP BY user_id")
def group_holdout(spark, sf_dir):
    """Events of held-out users, drawn by a seeded digest."""
    _, test = sampling.group_holdout(table(spark, sf_dir, "events"), "user_id", 0.3, 13)
    return test.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_orderkey AS record, o_orderpriority AS label, CASE WHEN o_custkey % 7 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS patient FROM orders),
          g AS (SELECT patient, md5('13 ' || patient) AS h FROM (SELECT DISTINCT patient FROM o)),
          h AS (SELECT patient FROM (SELECT patient, row_number() OVER (ORDER BY h, patient) AS r, count(*) OVER () AS n FROM g) WHERE r <= greatest(1, round(n * 0.3))),
          p AS (SELECT o.*, CASE WHEN h.patient IS NULL THEN 'train' ELSE 'test' END AS part FROM o LEFT JOIN h USING (patient)),
          w AS (SELECT part, count(DISTINCT patient) AS part_patients, count(*) AS part_rows FROM p GROUP BY part)
          SELECT part, label, count(DISTINCT patient) AS patients, count(*) AS rows, any_value(part_patients) AS part_patients, any_value(part_rows) AS part_rows, true AS disjoint
          FROM p JOIN w USING (part) GROUP BY part, label""")
def patient_holdout_audit(spark, sf_dir):
    """Orders are records, customers patients; an override renames some, whole patients are held out, an overlap would be an error."""
    own = table(spark, sf_dir, "orders")
    rows = own.select(F.col("o_orderkey").alias("record"), F.col("o_orderpriority").alias("label"))
    parsed = own.select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("patient"))
    override = parsed.where("patient % 7 = 0").withColumn("patient", F.col("patient") + 1000000)
    return sampling.audited_holdout(rows, parsed, override)[2]


@query("""SELECT o_custkey AS patient, array_to_string(list_sort(list(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END)), ',') AS parts FROM orders GROUP BY o_custkey""")
def patient_lists(spark, sf_dir):
    """Every patient with the parts it stands in."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient"), F.when(F.expr("o_orderkey % 3 = 0"), "test").otherwise("train").alias("part"))
    return tables.patient_lists(rows, "patient", "part").select("patient", F.array_join("parts", ",").alias("parts"))


@query(f"""SELECT 'train' AS part, event_id FROM events WHERE user_id IN ({', '.join(map(str, tables.TRAIN_RECORDS))})
           UNION ALL SELECT 'test', event_id FROM events WHERE user_id IN ({', '.join(map(str, tables.TEST_RECORDS))})""")
def record_list_split(spark, sf_dir):
    """Users with the numbers of the published record lists."""
    rows = table(spark, sf_dir, "events")
    part = lambda name, own: tables.of_records(rows, "user_id", own).select(F.lit(name).alias("part"), "event_id")
    return part("train", tables.TRAIN_RECORDS).unionByName(part("test", tables.TEST_RECORDS))


@query("SELECT event_id, event_type, (event_type = 'click')::INTEGER AS positive FROM events WHERE event_type IN ('click', 'view')")
def class_pair(spark, sf_dir):
    """Events of two classes, one of them against the other."""
    return tables.of_pair(table(spark, sf_dir, "events"), "event_type", "click", "view").select("event_id", "event_type", tables.one_versus_rest("event_type", "click").alias("positive"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, 'I' || CASE WHEN page_id < 10 THEN '0' ELSE '' END || page_id AS record FROM pages""")
def page_names(spark, sf_dir):
    """Base names of paths, and record names made from numbers."""
    return table(spark, sf_dir, "pages").select("page_id", tables.basename("url").alias("base"), tables.record_name("page_id").alias("record"))


@query(f"WITH {BEATS}, r AS (SELECT event_id, record, row_number() OVER (PARTITION BY record ORDER BY t, event_id) AS r FROM b) SELECT event_id, record FROM r WHERE r <= 5")
def first_of_record(spark, sf_dir):
    return features.first_rows(beats(spark, sf_dir), "record", ORDER, 5).select("event_id", "record")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 7919) % 100003, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
          SELECT event_id, event_type, CASE WHEN r <= greatest(1, round(n * 0.2)) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf_dir):
    order = [(F.col("event_id") * 7919) % 100003, F.col("event_id")]
    return sampling.stratified_split(table(spark, sf_dir, "events"), "event_type", 0.2, order).select("event_id", "event_type", "part")


@query("""WITH f AS (SELECT unnest(range(5)) AS fold), c AS (SELECT fold, event_type AS label, count(*) AS n FROM events JOIN f ON user_id % 5 <> fold GROUP BY ALL)
          SELECT label, min(n) AS least, floor(median(n))::BIGINT AS median, max(n) AS most FROM c GROUP BY label""")
def fold_class_counts(spark, sf_dir):
    """Least, median and largest training count of each class over five folds of users."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label"), (F.col("user_id") % 5).alias("own")).agg(F.count(F.lit(1)).alias("n"))
    folds = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> own").groupBy("fold", "label").agg(F.sum("n").alias("n"))
    return evaluation.fold_spread(folds)


@query(f"""WITH {_greedy_sql()} SELECT record, 'missed' AS side, event_id AS id FROM b WHERE label = 'view' AND event_id NOT IN (SELECT r_id FROM m)
           UNION ALL SELECT record, 'extra', event_id FROM b WHERE label = 'click' AND event_id NOT IN (SELECT d_id FROM m)""")
def unmatched_events(spark, sf_dir):
    """Reference events without a detection, and detections without a reference."""
    return matching.unmatched(*_matches(spark, sf_dir), "record")


@query("""WITH l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
          p AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS z, max(x) OVER (PARTITION BY vec_id) AS top FROM l WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
          d AS (SELECT vec_id, i FROM p WHERE x > a AND x >= z AND x >= 0.5::DOUBLE * top),
          n AS (SELECT v.vec_id AS record, 64 // 8 AS nr, (SELECT count(*) FROM d WHERE d.vec_id = v.vec_id) AS nd,
                       (SELECT count(*) FROM d WHERE d.vec_id = v.vec_id AND i % 8 = 4) AS tp FROM embeddings v)
          SELECT record, tp, nd - tp AS fp, nr - tp AS fn, round(tp::DOUBLE / nr, 4) AS se, round(tp::DOUBLE / nullif(nd, 0), 4) AS ppv,
                 round(coalesce(2 * (tp::DOUBLE / nr) * (tp::DOUBLE / nullif(nd, 0)) / nullif(tp::DOUBLE / nr + tp::DOUBLE / nullif(nd, 0), 0), 0), 4) AS f1 FROM n""")
def detector_score(spark, sf_dir):
    """A peak detector run on every vector, held against marks at every eighth sample, which it must hit exactly."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.lit(128).alias("fs"), doubles("embedding").alias("samples"))
    ref = own.select("record", F.posexplode(F.sequence(F.lit(4), F.size("samples") - 1, F.lit(8))).alias("r_id", "r_t")).withColumns({"r_id": F.col("r_id").cast("long"), "r_t": F.col("r_t").cast("double")})
    return matching.evaluated_detector(own, ref, matching.peaks_above(0.5, 1), 0.5)


CHANNEL = "c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"


def _channels(spark, sf_dir, block=64):
    """Each user's values in the order of events as a channel in blocks."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), F.lit("value").alias("lead"), F.lit(0).alias("idx"), F.lit(360.0).alias("fs"), "value",
                                                 (F.row_number().over(order) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    start = (F.col("pos") - F.col("pos") % block).alias("start")
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"])
    return rows.groupBy("record", "lead", "idx", "fs", "n", F.lit(block).cast("long").alias("block"), start).agg(own.alias("samples"))


@query(f"WITH {CHANNEL} SELECT user_id, pos, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 5) AS z FROM c WINDOW w AS (PARTITION BY user_id)")
def block_zscore(spark, sf_dir):
    """Scaled samples of long channels: two sums over blocks, no row with a channel."""
    out = blocks.scaled(_channels(spark, sf_dir))
    return out.select(F.col("record").alias("user_id"), "start", F.posexplode("samples").alias("i", "z")).select("user_id", (F.col("start") + F.col("i")).alias("pos"), F.round("z", 5).alias("z"))


@query(f"WITH {CHANNEL} SELECT user_id, pos, round(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 100 PRECEDING AND 7 FOLLOWING), 5) AS mean FROM c")
def block_moving_mean(spark, sf_dir):
    """A frame that reaches over two blocks back and into the next, from each block and its halo."""
    wide = blocks.with_halo(_channels(spark, sf_dir), 100, 7)
    place = F.sequence(F.lit(0), F.least("block", F.col("n") - F.col("start")).cast("int") - 1)
    own = wide.select(F.col("record").alias("user_id"), "start", "lo", "samples", F.explode(place).alias("i"))
    at = F.col("start") + F.col("i") - F.col("lo")
    first = F.greatest(at - 100, F.lit(0))
    frame = F.slice("samples", (first + 1).cast("int"), (at + 8 - first).cast("int"))
    mean = F.aggregate(frame, F.lit(0.0), lambda s, x: s + x) / F.size(frame)
    return own.select("user_id", (F.col("start") + F.col("i")).alias("pos"), F.round(mean, 5).alias("mean"))
