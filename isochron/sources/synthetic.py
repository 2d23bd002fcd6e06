"""A synthetic table of beats, derived from row numbers and hashes alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Width and height of the main wave by class.
SHAPES = {"N": (1.0, 1.0), "S": (1.1, 0.8), "V": (2.2, 1.6), "F": (1.6, 1.2), "Q": (0.7, 0.5)}


def _normal(*columns) -> F.Column:
    """A standard normal from hashes (Box-Muller), the same wherever a row is computed."""
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))


def beats(spark: SparkSession, records: int, per_record: int = 60, samples: int = 252, noise: float = 0.08) -> DataFrame:
    """(beat_id, record, pos, label, rr_pre, segment): Gaussian waves whose shape depends on the class."""
    ids = spark.range(records * per_record).select(F.col("id").alias("beat_id"), (F.col("id") / per_record).cast("long").alias("record"), (F.col("id") % per_record).cast("int").alias("pos"))
    draw = F.pmod(F.xxhash64(F.lit("class"), "beat_id"), F.lit(100))
    label = F.when(draw < 50, "N").when(draw < 65, "S").when(draw < 85, "V").when(draw < 95, "F").otherwise("Q")
    rows = ids.withColumn("label", label)
    shape = lambda w, a: F.struct(F.lit(w).alias("w"), F.lit(a).alias("a"))
    table = F.create_map(*(x for k, (w, a) in SHAPES.items() for x in (F.lit(k), shape(w, a))))
    rows = rows.withColumn("_s", table[F.col("label")])
    t = lambda i: i / float(samples)
    bell = lambda x, mid, wide: F.exp(-((x - mid) * (x - mid)) / (2 * wide * wide))
    value = lambda i: F.col("_s.a") * bell(t(i), 0.4, 0.02 * F.col("_s.w")) + 0.3 * bell(t(i), 0.65, F.lit(0.05)) + noise * _normal("beat_id", i)
    return rows.withColumns({
        "rr_pre": F.when(F.col("pos") > 0, 0.8 + 0.1 * _normal(F.lit("rr"), "beat_id")),
        "segment": F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), value),
    }).drop("_s")
