"""Feature tables on disk, and results as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_features(df: DataFrame, meta: DataFrame, path: str, by: str = "group") -> None:
    """Features partitioned by group (filters on it read only its files), metadata beside them."""
    df.write.mode("overwrite").partitionBy(by).parquet(f"{path}/features")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/meta")


def save_results(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    df.drop(*drop).write.mode("overwrite").json(path)


def reordered_confusion(results: DataFrame, order: list[str]) -> DataFrame:
    """(row, col, n) of a stored matrix (labels ARRAY<STRING>, matrix ARRAY<ARRAY<LONG>>) in another order of labels."""
    place = lambda c: F.array_position(F.array(*map(F.lit, order)), c)
    rows = results.select("labels", F.posexplode("matrix").alias("i", "own"))
    cells = rows.select("labels", F.col("labels")[F.col("i")].alias("y_true"), F.posexplode("own").alias("j", "n"))
    return cells.select(place(F.col("y_true")).alias("row"), place(F.col("labels")[F.col("j")]).alias("col"), "n").where("row > 0 AND col > 0")


def balance_report(stages: DataFrame, order: tuple[str, ...] = ("N", "S", "V", "F", "Q")) -> DataFrame:
    """One text line per class and a total: counts before balancing, after each stage."""
    wide = stages.groupBy("label").pivot("stage", ["before", "oversampled", "edited"]).agg(F.sum("n")).fillna(0)
    total = wide.agg(F.lit("total").alias("label"), *(F.sum(c).alias(c) for c in ("before", "oversampled", "edited")))
    place: Column = F.array_position(F.array(*map(F.lit, (*order, "total"))), F.col("label"))
    return wide.unionByName(total).select(place.alias("place"), F.format_string("%-6s%10d%14d%10d", "label", "before", "oversampled", "edited").alias("line"))
