"""Class balancing: synthetic minority rows, then edited nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .geometry import class_neighbours, mixed, neighbours
from .windows import cut_points, ranked, slice_of


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def oversample(rows: DataFrame, most_k: int = 5, seed: int = 42) -> DataFrame:
    """rows (id, label, features) with synthetic ones until each class is as large as the largest.

    With a rarest class of c rows, k = max(1, min(most_k, c - 1)) nearest rows of the same
    class are partners; a synthetic row lies at a random place between a row and one of its
    partners.  If the rarest class has one row only, rows are repeated instead.  Choices
    follow from hashes of (row, copy), so they do not depend on partitions.  Synthetic
    ids are null.
    """
    counts = {r["label"]: r["n"] for r in class_counts(rows).collect()}
    if not counts:
        return rows.select("id", "label", "features")
    largest, rarest = max(counts.values()), min(counts.values())
    placed = rows.select("id", "label", "features")
    placed = ranked(placed, "label", slice_of(F.col("id"), cut_points(placed, "id")), [F.col("id")]).withColumnRenamed("_rank", "_r").drop("_total")
    table = rows.sparkSession.createDataFrame([(k, n, largest - n) for k, n in counts.items()], f"label {dict(rows.dtypes)['label']}, _n long, _more long")
    lacking = placed.join(F.broadcast(table.where("_more > 0")), "label")
    # row r of n makes as many copies as there are c < more with c mod n = r
    copies = F.expr("CASE WHEN _r < _more THEN sequence(0, CAST((_more - 1 - _r) DIV _n AS INT)) ELSE array() END")
    wanted = lacking.select("id", "label", "features", F.explode(copies).alias("_copy"))
    u = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id", "_copy"), F.lit(1 << 30)) / float(1 << 30)
    if rarest < 2:
        made = wanted.select(F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), "label", "features")
    else:
        k = max(1, min(most_k, rarest - 1))
        few = rows.join(F.broadcast(table.where("_more > 0").select("label")), "label")
        if rarest == largest:
            return placed.select("id", "label", "features")
        near = class_neighbours(lacking.where("_r < _more").select("id", "label", "features"), few, k)  # only rows that are copied need partners
        partner = rows.select(F.col("id").alias("_pid"), F.col("features").alias("_other"))
        picked = (wanted.withColumn("rank", (F.floor(u("partner") * k) + 1).cast("int"))
                  .join(near.select(F.col("query").alias("id"), F.col("id").alias("_pid"), "rank"), ["id", "rank"]).join(partner, "_pid"))
        at = u("place")
        made = picked.select(F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), "label",
                             F.zip_with("features", "_other", lambda a, b: a + (b - a) * at).alias("features"))
    return placed.select("id", "label", "features").unionByName(made)


def edited(rows: DataFrame, k: int = 3, spare: str | None = None) -> DataFrame:
    """Rows whose k nearest rows (of all classes) all share their label; class ``spare`` is left alone.

    rows needs ids that are unique and not null.
    """
    if rows.where("label IS NULL").isEmpty():
        asking = rows if spare is None else rows.where(F.col("label") != F.lit(spare))
        return rows.join(mixed(asking, rows, k), "id", "left_anti")
    near = neighbours(rows, rows, k).groupBy(F.col("query").alias("id")).agg(F.collect_set("label").alias("_near"))  # rows without a label are of no class
    same = F.forall("_near", lambda x: x == F.col("label"))
    return rows.join(near, "id", "left").where((F.col("label") == F.lit(spare)) | F.col("_near").isNull() | same).drop("_near")


def stages(rows: DataFrame, edit: bool = True) -> DataFrame:
    """(stage, label, n) before balancing, after oversampling and, if asked for, after editing."""
    least = class_counts(rows).orderBy("n", "label").first()
    over = keyed(oversample(rows), rows)
    out = None
    steps = [("before", rows), ("oversampled", over)] + ([("edited", edited(over, spare=least["label"] if least else None))] if edit else [])
    for name, df in steps:
        part = class_counts(df).select(F.lit(name).alias("stage"), "label", "n")
        out = part if out is None else out.unionByName(part)
    return out


def keyed(made: DataFrame, rows: DataFrame) -> DataFrame:
    """made, which are rows and synthetic ones, written down, with new ids above all others for those that have none.

    The highest id is that of ``rows``: asking ``made`` for it would look for all partners a second time.
    """
    top = rows.agg(F.max("id")).first()[0] or 0
    return materialize(made.withColumn("id", F.coalesce("id", F.lit(top + 1) + F.monotonically_increasing_id())), "keyed")


def balanced(rows: DataFrame) -> DataFrame:
    """rows (id, label, features) oversampled and edited, as a classifier's training rows."""
    least = class_counts(rows).orderBy("n", "label").first()
    return edited(keyed(oversample(rows), rows), spare=least["label"] if least else None)


def stages_per_fold(rows: DataFrame, table: DataFrame, folds: int, edit: bool = True) -> DataFrame:
    """(fold, stage, label, n) of the training rows of each fold; rows has group, table (group, fold)."""
    tagged = materialize(rows.join(table, "group").select("id", "label", "features", "fold"), "tagged")
    out = None
    for fold in range(folds):
        part = stages(tagged.where(F.col("fold") != fold).drop("fold"), edit).withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return out
