"""Proportional stratified interleaving into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import ranked
from .common import materialize


def _slice(h: Column, buckets: int) -> Column:
    """A slice number that does not fall as the hexadecimal digest h rises."""
    return F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int")


def interleave(docs: DataFrame, shards: int = 16, stratum: str = "source", seed: int = 17, buckets: int = 4096) -> DataFrame:
    """Deal documents to shards so that every shard has the whole's mixture of sources.

    Rows are shuffled by a seeded digest and ranked within their source; the fractional
    rank (rank + u) / rows of the source spreads each source evenly over (0, 1), where u in
    (0, 1) is drawn from the source's name: sources of equal size, and be it one row each,
    do not fall on the same ranks.  In the order of fractional ranks, equal cuts give shards
    whose row counts differ by one at most (law ``rows``) and whose share of each source
    differs from the whole's by a few rows.

    Both ranks are exact: rows are dealt to ``buckets`` slices of digest or of rank and
    numbered there, and prefix sums over the counts of slices give what comes before.
    A source with a third of all rows is so spread over all tasks, and so are rows without
    doc_id however often one text repeats.  Only doc_id, source, size and checksums are
    shuffled.

    Null text: size 1, checksum 0.  Null source: a stratum of its own.  Null or repeated
    doc_id: each row is dealt on its own; which of fully equal rows comes first does not
    matter.  An empty table gives no rows.  Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("_key"),
    )
    # rows without an id are equal or told apart by their text, so their place may tell them apart too
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("_h", F.md5(F.concat_ws(" ", F.lit(str(seed)), name, F.col("text_crc32").cast("string"))))
    phase = F.conv(F.substring(F.md5(F.concat_ws(" ", F.lit(str(seed)), "_key")), 1, 8), 16, 10).cast("long")
    tie = [F.col("_h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    inside = materialize(
        ranked(rows, "_key", _slice(F.col("_h"), buckets), tie)
        .withColumn("_f", (F.col("_rank") + (phase + 0.5) / F.lit(float(2**32))) / F.col("_total")).drop("_rank", "_total"),
        "shard-ranks",
    ).withColumn("_all", F.lit(0))
    whole = ranked(inside, "_all", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)).cast("int"),
                   [F.col("_f"), F.col("_key"), *tie], "_g")
    shard = F.expr(f"_rank * {shards} div _total")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return whole.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
