"""Ordered, partitioned operators: intervals, causal frames, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize


def along(record: str, *order: str) -> WindowSpec:
    return Window.partitionBy(record).orderBy(*order)


def seconds(ts: str = "ts") -> Column:
    """Seconds since the epoch with microseconds, of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def intervals(df: DataFrame, record: str, order: list[str], t: str, rate: float = 1.0) -> DataFrame:
    """pos, and the intervals to the event before and after in units of t / rate; null at a record's ends."""
    w = along(record, *order)
    return df.withColumns({
        "pos": (F.row_number().over(w) - 1).cast("int"),
        "rr_pre": (F.col(t) - F.lag(t).over(w)) / rate,
        "rr_post": (F.lead(t).over(w) - F.col(t)) / rate,
    })


def frame(record: str, order: list[str], width: int, causal: bool = True) -> WindowSpec:
    """The last ``width`` rows with the current one; not causal: as many after it too."""
    return along(record, *order).rowsBetween(-(width - 1), 0 if causal else width - 1)


def rhythm(df: DataFrame, record: str, order: list[str], rr: str = "rr_pre", width: int = 16, jump: float = 0.05, causal: bool = True) -> DataFrame:
    """Interval statistics over a frame of rows: n_rr, mean_rr, sdnn, rmssd, pnn, lfhf.

    Missing intervals are skipped, and successive differences are those of the intervals
    that remain: a frame's first interval has its difference taken off again.  With fewer
    than three intervals all but mean_rr are 0.  lfhf is 1 from eight intervals on, else 0:
    on the short frames used the two bands hold no frequency bin, so their ratio is 1.
    """
    w, f = along(record, *order), frame(record, order, width, causal)
    before = F.last(rr, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.coalesce(F.col(rr) - before, F.lit(0.0))
    has = F.col(rr).isNotNull()
    df = df.withColumns({"_sq": F.when(has, step * step), "_jump": F.when(has, (F.abs(step) > jump).cast("double"))})
    n = F.count(rr).over(f)
    rest = lambda c: (F.sum(c).over(f) - F.first(c, ignorenulls=True).over(f)) / (n - 1)
    enough = lambda c: F.when(n >= 3, c).otherwise(F.lit(0.0))
    return df.withColumns({
        "n_rr": n,
        "mean_rr": F.coalesce(F.avg(rr).over(f), F.lit(0.0)),
        "sdnn": enough(F.stddev_pop(rr).over(f)),
        "rmssd": enough(F.sqrt(F.greatest(rest("_sq"), F.lit(0.0)))),
        "pnn": enough(rest("_jump")),
        "lfhf": F.when(n >= 8, F.lit(1.0)).otherwise(F.lit(0.0)),
    }).drop("_sq", "_jump")


#: Rows of a slice, about, and slices at most.
SLICE_ROWS, SLICES = 50_000, 4096


def cut_points(df: DataFrame, column: str, slices: int | None = None, rows: int | None = None) -> list:
    """Approximate quantiles of a column that cut its values into ``slices`` of like size, or else of about ``rows`` (``SLICE_ROWS``) rows each.

    One pass counts rows and takes the finest quantiles; a small table has no cuts at all.
    Beyond ``SLICES`` times so many rows slices grow, and spill within their tasks.
    """
    shares = F.expr(f"array({', '.join(f'{i / SLICES!r}D' for i in range(1, SLICES))})")  # read at once: a call to the JVM for each literal takes seconds
    finest = F.percentile_approx(column, shares, 20_000).alias("c")
    found = df.agg(F.count(column).alias("n"), finest).first()
    slices = min(SLICES, found["n"], slices or -(-found["n"] // (rows or SLICE_ROWS)))
    return sorted({found["c"][i * SLICES // slices - 1] for i in range(1, slices)}) if slices > 1 else []


def slice_of(column: Column, cuts: list) -> Column:
    """How many cuts lie at or below a value, by halving: does not fall as the value rises."""
    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(cuts[mid]), below(mid + 1, hi)).otherwise(below(lo, mid))

    return below(0, len(cuts))


def ranked(df: DataFrame, key: str, bucket: Column, order: list[Column], bucket_name: str = "_b") -> DataFrame:
    """Add _rank (from 0) and _total within each value of ``key``.

    ``bucket`` must not fall as ``order`` rises.  Rows of one (key, bucket) meet in a
    task; what comes before a bucket is a prefix sum over the small table of counts.
    """
    df = df.withColumn(bucket_name, bucket)
    before = Window.partitionBy(key).orderBy(bucket_name)
    counts = (
        df.groupBy(key, bucket_name).agg(F.count(F.lit(1)).alias("_n"))
        .select(key, bucket_name,
                (F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
                F.sum("_n").over(Window.partitionBy(key)).alias("_total"))
    )
    own = Window.partitionBy(key, bucket_name).orderBy(*order)
    return (
        df.join(counts, [key, bucket_name])
        .withColumn("_rank", F.col("_before") + F.row_number().over(own) - 1)
        .drop("_before", bucket_name)
    )


def quantiles(df: DataFrame, key: str, value: str, shares: list[float], slices: int | None = None, rows: int | None = None) -> DataFrame:
    """(key, q): exact quantiles with linear interpolation, an array in the order of ``shares``.

    No task holds a key's values: counts of slices tell in which slices the wanted ranks
    lie, only their rows are looked at again, and there equal values count as one row.
    Nulls take no part; a key without values has no row.
    """
    df = df.select(key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # equal values are one row from the start; written down, since both the counts and the second look read them
    df = df.withColumn("_slice", slice_of(F.col("_v"), cut_points(df, "_v", slices, rows))).groupBy(key, "_slice", "_v").agg(F.count(F.lit(1)).alias("_m"))
    df = materialize(df, "quantiles")
    along_ = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(key, "_slice").agg(F.sum("_m").alias("_n"))
    counts = counts.select(key, "_slice", "_n", F.coalesce(F.sum("_n").over(along_), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("_total"))
    asked = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_total") - 1)).alias("h")) for i, p in enumerate(shares)))
    # a quantile lies between the two ranks around h
    wanted = counts.withColumn("_a", F.explode(asked)).withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_a.h"), F.ceil("_a.h")))))
    wanted = wanted.where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_n")))
    own = Window.partitionBy(key, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = df.join(wanted.select(key, "_slice").distinct(), [key, "_slice"], "left_semi").withColumn("_to", F.sum("_m").over(own))
    met = wanted.select(key, "_slice", "_before", "_r", "_a").join(values, [key, "_slice"])
    met = met.where((F.col("_r") < F.col("_before") + F.col("_to")) & (F.col("_r") >= F.col("_before") + F.col("_to") - F.col("_m")))
    share = F.col("_a.h") - F.floor("_a.h")
    weight = F.when(F.floor("_a.h") == F.ceil("_a.h"), 1.0).when(F.col("_r") == F.floor("_a.h"), 1 - share).otherwise(share)
    one = met.groupBy(key, F.col("_a.i").alias("_i")).agg(F.sum(weight * F.col("_v")).alias("_q"))
    return one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("q"))


def running_sums(df: DataFrame, key: str, order: str, sums: list[str], slices: int | None = None, rows: int | None = None) -> DataFrame:
    """Sums of columns over all rows of ``key`` with a value of ``order`` as high or higher.

    A key with most of the rows does not meet in one task: rows are cut at approximate
    quantiles of ``order`` (any cuts give the same sums), each slice is summed up by a
    window of its own, and a prefix sum over the slices' totals is added.
    """
    df = df.withColumn("_slice", slice_of(F.col(order), cut_points(df, order, slices, rows)))
    above = Window.partitionBy(key).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, "_slice").agg(*(F.sum(c).alias(c) for c in sums))
    totals = totals.select(key, "_slice", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in sums))
    own = Window.partitionBy(key, "_slice").orderBy(F.col(order).desc())
    out = df.join(totals, [key, "_slice"])
    return out.withColumns({f"cum_{c}": F.col(f"_{c}") + F.sum(c).over(own) for c in sums}).drop("_slice", *(f"_{c}" for c in sums))
