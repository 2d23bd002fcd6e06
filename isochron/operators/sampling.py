"""Splits, folds and stratified samples whose draws depend on keys, not on partitions."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables
from .windows import cut_points, ranked, slice_of


def digest(*columns: str | Column, seed: int = 13) -> Column:
    """A hexadecimal digest of a key: an order that looks random and is the same everywhere."""
    return F.md5(F.concat_ws(" ", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns)))


def digest_slice(h: Column, slices: int = 4096) -> Column:
    """A slice number that does not fall as the digest rises."""
    return F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * slices / F.lit(2**32)).cast("int")


def held_groups(rows: DataFrame, group: str, share: float = 0.3, seed: int = 13) -> DataFrame:
    """The groups held out: in the order of a seeded digest the first max(1, round(share * n)), however many there are."""
    ids = rows.select(group).distinct().withColumn("_h", digest(group, seed=seed)).withColumn("_all", F.lit(0))
    place = ranked(ids, "_all", digest_slice(F.col("_h")), [F.col("_h"), F.col(group)])
    return place.where(F.col("_rank") < F.greatest(F.lit(1), F.round(F.col("_total") * share))).select(group)


def generated_groups(rows: DataFrame, group: str, share: float = 0.3, seed: int = 13) -> DataFrame:
    """The groups held out by a generator's shuffle of the sorted ids, to repeat a published split.

    A generator's stream is one sequence, so the ids go through the driver: for the few
    patients of a study; ``held_groups`` takes any number.
    """
    ids = np.array(sorted(r[0] for r in rows.select(group).distinct().collect()), dtype=object)
    np.random.default_rng(seed).shuffle(ids)
    return rows.sparkSession.createDataFrame([(x,) for x in ids[: max(1, round(share * len(ids)))].tolist()], f"{group} {dict(rows.dtypes)[group]}")


def group_holdout(rows: DataFrame, group: str, share: float = 0.3, seed: int = 13, draw=held_groups) -> tuple[DataFrame, DataFrame]:
    """(train, test): whole groups are held out, drawn by a seeded digest of their id or as ``draw`` does."""
    held = draw(rows, group, share, seed)
    return rows.join(held, group, "left_anti"), rows.join(held, group, "left_semi")


def audited_holdout(rows: DataFrame, patients: DataFrame, override: DataFrame | None = None, share: float = 0.3, seed: int = 13) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, audit): records get their patients, whole patients are held out, and an overlap is an error.

    rows has record and label, patients and override (record, patient).
    """
    known = tables.with_patients(rows, patients, override)
    train, test = group_holdout(known, "patient", share, seed)
    overlap = train.select("patient").intersect(test.select("patient"))
    if not overlap.isEmpty():
        raise RuntimeError("a patient stands in both parts; check the lookup of patients")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return train, test, tables.audit(both, "patient", "part", "label")


def _dealt(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, list[int], list[int]]]:
    """Per size, largest first: the folds of its first groups, then the round in which the rest go.

    Each group goes into the lightest fold (ties by number).  Once loads differ by less than
    one group's size, folds take turns in an order that does not change.
    """
    loads = [(0, f) for f in range(folds)]
    out = []
    for size, count in sizes:
        lead: list[int] = []
        while len(lead) < count and max(loads)[0] - loads[0][0] >= size:
            load, fold = heapq.heappop(loads)
            lead.append(fold)
            heapq.heappush(loads, (load + size, fold))
        left = count - len(lead)
        turn = [f for _, f in sorted(loads)]
        loads = [(load + size * (left // folds + (turn.index(f) < left % folds)), f) for load, f in loads]
        heapq.heapify(loads)
        out.append((size, lead, turn))
    return out


def group_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, fold): largest group first (ties by group), each into the lightest fold (ties by number).

    Only the histogram of sizes passes the driver, where groups of one size are dealt at
    once; each group finds its fold by its exact rank among those of its size.
    """
    found = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    sizes = [(r["_size"], r["n"]) for r in found.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("_size").desc()).collect()]
    number = min(folds, sum(n for _, n in sizes))
    turns = rows.sparkSession.createDataFrame(_dealt(sizes, number) if sizes else [], "_size long, _lead array<int>, _turn array<int>")
    kind = dict(rows.dtypes)[group]
    cuts = cut_points(found, group) if kind in ("int", "bigint", "double") else []
    place = ranked(found, "_size", slice_of(F.col(group), cuts), [F.col(group)]).join(turns, "_size")
    at = F.col("_rank") - F.size("_lead")
    fold = F.when(at < 0, F.get("_lead", F.col("_rank").cast("int"))).otherwise(F.get("_turn", (at % number).cast("int")) if number else F.lit(None))
    return place.select(group, fold.cast("int").alias("fold"))


def stratified(rows: DataFrame, label: str, share: float, order: list[Column]) -> DataFrame:
    """max(1, round(n * share)) rows of each class, the first in ``order``: exact sizes, unlike sampleBy.

    The first of ``order`` is a number; a class is cut into slices of it, and ranks within
    slices and counts before them tell which rows come first: no class meets in a task.
    """
    rows = rows.withColumn("_o", order[0])
    place = ranked(rows, label, slice_of(F.col("_o"), cut_points(rows, "_o")), [F.col("_o"), *order[1:]])
    return place.where(F.col("_rank") < F.greatest(F.lit(1), F.round(F.col("_total") * share))).drop("_rank", "_total", "_o")


def stratified_split(rows: DataFrame, label: str, share: float, order: list[Column]) -> DataFrame:
    """rows with ``part``: of each class the first share is test, the rest train (a split that lets groups leak)."""
    rows = rows.withColumn("_o", order[0])
    place = ranked(rows, label, slice_of(F.col("_o"), cut_points(rows, "_o")), [F.col("_o"), *order[1:]])
    part = F.when(F.col("_rank") < F.greatest(F.lit(1), F.round(F.col("_total") * share)), "test").otherwise("train")
    return place.withColumn("part", part).drop("_rank", "_total", "_o")


def hashed(*columns: str, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), *columns)
