"""Union-find within tasks and connected components across them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


class UnionFind:
    """Sets of hashable items; the smallest item stands for its set."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a, b) -> bool:
        """False if a and b were together already."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def forest(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(item, smallest item of its set) for all items that are not the smallest."""
    sets = UnionFind()
    for a, b in edges:
        sets.join(a, b)
    return [(x, r) for x in list(sets.parent) if (r := sets.find(x)) != x]


def contract(edges: DataFrame, limit: int = 500_000) -> DataFrame:
    """Replace each task's edges by stars of their union-find sets, ``limit`` edges at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for part in parts:
            held += zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True)
            if len(held) >= limit:
                stars = forest(held)
                held = [] if len(stars) > limit // 2 else stars
                if not held:
                    yield _edges(stars)
        if held:
            yield _edges(forest(held))

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star algorithm on edges (a > b).

    A hub's edges stay spread: its minimum is a partial aggregate, written to disk, and
    the join back to the edges has an exchange on either side that can be split.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(turned) if large else edges
    least = materialize(near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-least")
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(
            least.select("a", F.col("m").alias("b")))
    made = materialize(out.where("a > b").distinct(), "cc-edges")
    remove(least)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge that is not it.

    Edges are contracted by union-find where they lie; large and small stars alternate
    across tasks until nothing changes, a number of rounds that grows as the logarithm of
    the nodes.  Nothing but two sums per round reaches the driver.
    """
    oriented = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(contract(oriented).distinct(), "cc-edges")
    state = None
    while True:
        facts = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(facts) == state or facts[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(facts)
        after = _star(now, large=True)
        remove(now)
        now = _star(after, large=False)
        remove(after)
