"""Class separability of labelled vectors: scatter ratios, cluster indices, silhouettes, neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import matrix
from ..session import materialize


def long(vectors: DataFrame, id_: str = "id", label: str = "label", features: str = "features") -> DataFrame:
    """(id, label, dim, x): one row per component; aggregates over it are partial in every task."""
    return vectors.select(id_, label, F.posexplode(features).alias("dim", "x"))


def standardized(rows: DataFrame) -> DataFrame:
    """Components minus their mean over their population sd (1 where that is 0)."""
    facts = rows.groupBy("dim").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return (rows.join(F.broadcast(facts), "dim")  # one row per dimension
            .withColumn("x", (F.col("x") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s"))


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))


def scatter(rows: DataFrame) -> DataFrame:
    """One row: between- and within-class scatter, their ratio, and the Calinski-Harabasz index."""
    own = _moments(rows)
    whole = own.groupBy("dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    sums = own.join(F.broadcast(whole), "dim").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.count_distinct("label").alias("k"), F.max("dim").alias("d"), F.sum("n").alias("cells"))
    n = F.col("cells") / (F.col("d") + 1)
    return sums.select("between", "within", (F.col("between") / (F.col("within") + 1e-12)).alias("fisher"),
                       ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (n - F.col("k")))).alias("calinski_harabasz"))


def regularized_fisher(rows: DataFrame, ridge: float = 1e-3) -> float:
    """Trace of the inverse within-class scatter (plus a ridge) times the between-class scatter.

    The Gramian is summed up by Spark as dims x dims cells; only it reaches the driver.
    """
    vectors = rows.groupBy("id", "label").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v")).select("label", F.col("v.x").alias("v"))

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for part in parts:
            v, labels = np.array(part["v"].to_pylist()), np.array(part["label"].to_pylist())
            for c in np.unique(labels):
                own = v[labels == c]
                n, s, g = held.get(c, (0, 0, 0))
                held[c] = n + len(own), s + own.sum(axis=0), g + own.T @ own
        for c, (n, s, g) in held.items():
            cells = np.concatenate([[n], s, g.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([str(c)] * len(cells)), pa.array(np.arange(len(cells))), pa.array(cells.astype(float))], ["label", "cell", "x"])

    sums = vectors.mapInArrow(partial, "label string, cell long, x double").groupBy("label", "cell").agg(F.sum("x").alias("x")).toPandas()
    within, means, sizes = 0, [], []
    for _, own in sums.sort_values("cell").groupby("label"):
        x = own["x"].to_numpy()
        d = int((np.sqrt(4 * len(x) - 3) - 1) / 2)
        n, s, g = x[0], x[1 : d + 1], x[d + 1 :].reshape(d, d)
        within = within + g - np.outer(s, s) / n
        means.append(s / n)
        sizes.append(n)
    means, sizes = np.array(means), np.array(sizes)
    off = means - (means * sizes[:, None]).sum(axis=0) / sizes.sum()
    between = (off * sizes[:, None]).T @ off
    return float(np.trace(np.linalg.pinv(within + ridge * np.eye(len(within))) @ between))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """One row: the mean over classes of the worst (spread + spread) / distance of centres."""
    centres = _moments(rows).select("label", "dim", "m")
    far = (rows.join(F.broadcast(centres), ["label", "dim"]).groupBy("id", "label")
           .agg(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("d")))
    spread = far.groupBy("label").agg(F.avg("d").alias("s"))
    a, b = centres.alias("a"), centres.alias("b")
    gaps = (a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col("a.label") != F.col("b.label")))
            .groupBy(F.col("a.label").alias("label"), F.col("b.label").alias("other"))
            .agg(F.sqrt(F.sum((F.col("a.m") - F.col("b.m")) * (F.col("a.m") - F.col("b.m")))).alias("gap")))
    other = spread.select(F.col("label").alias("other"), F.col("s").alias("t"))
    worst = gaps.join(spread, "label").join(other, "other").groupBy("label").agg(F.max((F.col("s") + F.col("t")) / F.col("gap")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y; small ones, where the products cancel, from differences."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    d2 = (-2 * x) @ y.T
    d2 += xx[:, None]
    d2 += yy[None, :]
    if d2.size and not d2.min() > 1e-6 * (xx.max() + yy.max()):
        i, j = np.nonzero(d2 <= 1e-6 * (xx[:, None] + yy[None, :]))
        for lo in range(0, len(i), 65536):
            p, q = i[lo : lo + 65536], j[lo : lo + 65536]
            d2[p, q] = ((x[p] - y[q]) ** 2).sum(axis=1)
    return np.sqrt(d2, out=d2)


def _class_sums(d: np.ndarray, starts: np.ndarray, axis: int) -> np.ndarray:
    """Sums of d along an axis by classes, which begin at ``starts``; a class is a run of d."""
    if len(starts) > 256:
        return np.add.reduceat(d, starts, axis=axis)
    ends = [*starts[1:].tolist(), d.shape[axis]]
    return np.stack([(d[:, a:b] if axis else d[a:b]).sum(axis=axis) for a, b in zip(starts.tolist(), ends, strict=True)], axis=axis)


def silhouettes(vectors: DataFrame, block: int | None = None, features: str = "features") -> DataFrame:
    """(id, label, silhouette) of every row against all rows; ids are unique and not null.

    Rows are dealt into blocks of about ``block`` (by default as many as may meet in a task) by a hash of their id, and a task compares
    two blocks: sums of distances by row and class are additive, so they are summed up over
    block pairs.  A pair of rows is looked at once, for both of them.  The work is quadratic; nothing but the counts of classes reaches the driver.
    """
    kinds = dict(vectors.dtypes)
    vectors = vectors.select("id", "label", features)
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = vectors.count()
    n = max(1, -(-total // (block or meeting_rows(vectors, total, features))))
    own = vectors.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = own.select(F.least("_own", "_to").alias("i"), F.greatest("_own", "_to").alias("j"), (F.col("_own") <= F.col("_to")).alias("low"), "id", "label", features)

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        x, low = matrix(part[features]), part["low"].to_numpy()
        classes, code = np.unique(part["label"].to_numpy(), return_inverse=True)
        same = part["i"][0].as_py() == part["j"][0].as_py()
        sides = [s[np.argsort(code[s], kind="stable")] for s in (np.flatnonzero(low), np.flatnonzero(low if same else ~low))]
        left, right = sides
        starts = [np.unique(code[s], return_index=True) for s in sides]
        out = []
        if len(left) and len(right):
            mid = x[left].mean(axis=0)
            x = x - mid if np.isfinite(mid).all() else x
            sums = [np.zeros((len(left), len(starts[1][0]))), np.zeros((len(starts[0][0]), len(right)))]
            for lo in range(0, len(left), 256):
                rows = left[lo : lo + 256]
                here, at = np.unique(code[rows], return_index=True)
                to = np.searchsorted(starts[0][0], here)
                for from_ in range(0, len(right), 2048):
                    cols = right[from_ : from_ + 2048]
                    d = _distances(x[rows], x[cols])
                    kinds_, begin = np.unique(code[cols], return_index=True)
                    sums[0][lo : lo + 256, np.searchsorted(starts[1][0], kinds_)] += _class_sums(d, begin, 1)
                    if not same:
                        sums[1][to, from_ : from_ + 2048] += _class_sums(d, at, 0)
            for side, other, s in [(left, starts[1][0], sums[0])] if same else [(left, starts[1][0], sums[0]), (right, starts[0][0], sums[1].T)]:
                rows = part.select(["id", "label"]).take(pa.array(np.repeat(side, len(other))))
                out.append(rows.append_column("other", pa.array(np.tile(classes[other], len(side)), part.schema.field("label").type)).append_column("s", pa.array(s.ravel())))
        empty = pa.schema([part.schema.field("id"), part.schema.field("label"), pa.field("other", part.schema.field("label").type), pa.field("s", pa.float64())])
        return pa.concat_tables(out) if out else empty.empty_table()

    parts = dealt.groupBy("i", "j").applyInArrow(run, f"id {kinds['id']}, label {kinds['label']}, other {kinds['label']}, s double")
    sums = parts.groupBy("id", "label", "other").agg(F.sum("s").alias("s")).join(F.broadcast(sizes.withColumnRenamed("label", "other")), "other")  # one row per class
    inside = F.col("other") == F.col("label")
    means = sums.groupBy("id", "label").agg(F.max(F.when(inside & (F.col("_n") > 1), F.col("s") / (F.col("_n") - 1))).alias("a"),
                                            F.min(F.when(~inside, F.col("s") / F.col("_n"))).alias("b"))
    worst = F.greatest("a", "b")
    return means.select("id", "label", F.coalesce(F.when(worst > 0, (F.col("b") - F.col("a")) / worst), F.lit(0.0)).alias("silhouette"))


#: Pivots at most; their coordinates go to all tasks.
PIVOTS = 2048
#: Components of the rows, and as many of the queries, that meet in a task at most.
MEETING = 1 << 22
#: Shares of the rows, by a hash of their id, that queries meet in turns.
SHARES = 16


def meeting_rows(rows: DataFrame, n: int, features: str) -> int:
    """Rows that meet as many others in a task: few enough for its memory and for all cores to have several tasks."""
    first = rows.select(F.size(features)).first()
    sides = math.ceil(math.sqrt(12 * rows.sparkSession.sparkContext.defaultParallelism))
    return max(1, min(MEETING // max(1, first[0] if first else 1), max(1024, -(-n // sides))))


class _Best:
    """The k best rows (by exact distance, then id) so far of some queries; ``tau2`` bounds their squared distances."""

    def __init__(self, ids: np.ndarray, tau2: np.ndarray, k: int):
        self.ids, self.tau2, self.k = ids, tau2, k
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.more: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, r: np.ndarray, at: np.ndarray, d2: np.ndarray) -> None:
        near = d2 <= self.tau2[r]
        self.more.append((r[near], at[near], d2[near]))
        self.waiting += int(near.sum())
        if self.waiting > 4 * self.k * len(self.tau2):
            self.settle()

    def settle(self) -> None:
        r, at, d2 = (np.concatenate(v) for v in zip(self.found, *self.more, strict=True))
        order = np.lexsort((self.ids[at], d2, r))
        r, at, d2 = r[order], at[order], d2[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        last = rank == self.k - 1
        self.tau2[r[last]] = np.minimum(self.tau2[r[last]], d2[last])
        self.found, self.more, self.waiting = tuple(v[rank < self.k] for v in (r, at, d2)), [], 0


def _true(mask: np.ndarray) -> np.ndarray:
    """Flat positions of the few true cells of a mask, looked at eight at a time."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    words = np.flatnonzero(mask.ravel().view(np.uint64))
    word, byte = np.nonzero(mask.reshape(-1, 8)[words])
    return words[word] * 8 + byte


def _screen(z: np.ndarray, zz: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Products of centred queries and rows, less half the rows' squared norms, the latter, and the share ``e`` of both
    squared norms by which single-precision products are off at most; it is in the products already for the rows."""
    d, yy = z.shape[1], (y * y).sum(axis=1)
    large = max(zz.max(), yy.max()) > 1e30  # beyond single precision
    kind, e = (np.float64, (d + 8) * 3e-16) if large else (np.float32, (d + 8) * 1.5e-7)
    s = np.hstack([z, np.ones((len(z), 1))]).astype(kind) @ np.hstack([y, (yy * (e - 0.5))[:, None]]).astype(kind).T
    return s, yy, e


def _compare(x: np.ndarray, ids: np.ndarray, own: np.ndarray, to: np.ndarray, best: _Best, skip: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Hand the rows ``to`` to the best of the queries ``own``: single-precision products say which may count, differences decide."""
    mid = x[own].mean(axis=0)
    z, k = x[own] - mid, best.k
    zz = (z * z).sum(axis=1)
    for lo in range(0, len(to), 2048):
        part = to[lo : lo + 2048]
        s, yy, e = _screen(z, zz, x[part] - mid)
        least = (zz * (1 - e) - best.tau2 * (1 + e)) / 2 - 1e-36
        unbound = np.flatnonzero(np.isinf(best.tau2))
        some = 2 * k + 2  # those that are skipped are fewer than k + 2 then
        if len(unbound) and s.shape[1] > some:
            kth = np.partition(s[unbound], s.shape[1] - some, axis=1)[:, s.shape[1] - some].astype(np.float64)
            least[unbound] = kth - 2 * e * (zz[unbound] + yy.max()) - 1e-36
        flat = _true(s >= least[:, None].astype(s.dtype))
        for at in range(0, len(flat), 65536):
            r, c = np.divmod(flat[at : at + 65536], len(part))
            keep = ~skip(r, part[c])
            r, c = r[keep], part[c[keep]]
            d2 = ((x[own[r]] - x[c]) ** 2).sum(axis=1)
            good = np.isfinite(d2)
            best.add(r[good], c[good], d2[good])
        if len(unbound):
            best.settle()
    best.settle()


def _nearest(part: pa.Table, k: int, features: str, others: bool, pivots: np.ndarray | None) -> pa.Table:
    """The k nearest of some rows for some queries, which bring a bound tau.

    A query meets the rows of its own cell first, where they are here, and then those of other cells whose
    ring differs from the query's distance to that cell's pivot by no more than the bound found so far.
    """
    part = part.combine_chunks()
    empty = np.empty(0, np.int64)
    query, at, d2 = [empty], [empty], [np.empty(0)]
    asks, ids, cell, ring, tau = (part[c].to_numpy() for c in ("ask", "id", "cell", "ring", "tau"))
    x = matrix(part[features])
    whole = np.isfinite(x).all(axis=1)
    q, c = np.flatnonzero(asks & whole), np.flatnonzero(~asks & whole)
    if len(q) and len(c):
        q, c = q[np.lexsort((ring[q], cell[q]))], c[np.argsort(cell[c], kind="stable")]
        cells, code = np.unique(cell[c], return_inverse=True)
        for lo in range(0, len(q), 1024):
            own = q[lo : lo + 1024]
            best = _Best(ids, tau[own] ** 2 * (1 + 1e-9), k)
            itself = (lambda r, c: np.zeros(len(r), bool)) if others else (lambda r, c, own=own: ids[own[r]] == ids[c])
            for home in np.intersect1d(cell[own], cells):
                inside = np.flatnonzero(cell[own] == home)
                mine = _Best(ids, best.tau2[inside], k)
                _compare(x, ids, own[inside], c[code == np.searchsorted(cells, home)], mine, lambda r, c, i=inside: itself(i[r], c))
                best.more.append((inside[mine.found[0]], *mine.found[1:]))
            best.settle()
            if pivots is not None:
                away = _distances(x[own], pivots[cells])
                away[cell[own][:, None] == cells[None, :]] = np.nan  # met already
                reach = np.sqrt(best.tau2)[:, None] * (1 + 1e-9) + 1e-9 * (1 + away)
                low, high = np.fmin.reduce(away - reach, axis=0)[code], np.fmax.reduce(away + reach, axis=0)[code]
                to = c[(ring[c] >= low) & (ring[c] <= high)]
                _compare(x, ids, own, to, best, lambda r, c, own=own: itself(r, c) | (cell[own[r]] == cell[c]))
            query.append(ids[own[best.found[0]]])
            at.append(best.found[1])
            d2.append(best.found[2])
    rows = part.select(["id", "label"]).take(pa.array(np.concatenate(at)))
    return pa.Table.from_arrays([pa.array(np.concatenate(query), rows.schema.field("id").type), rows["id"], rows["label"], pa.array(np.concatenate(d2))], ["query", "id", "label", "d2"])


def _beaten(x: np.ndarray, ids: np.ndarray, code: np.ndarray, own: np.ndarray, to: np.ndarray, tau2: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the queries ``own`` have a row of another class among ``to`` before their bound; a query that has one meets no more rows."""
    mid = x[own].mean(axis=0)
    z = x[own] - mid
    zz, beaten = (z * z).sum(axis=1), np.zeros(len(own), bool)
    for lo in range(0, len(to), 2048):
        live = np.flatnonzero(~beaten)
        if not len(live):
            break
        part = to[lo : lo + 2048]
        s, _, e = _screen(z[live], zz[live], x[part] - mid)
        least = (zz[live] * (1 - e) - tau2[own[live]] * (1 + e)) / 2 - 1e-36
        flat = _true(s >= least[:, None].astype(s.dtype))
        for at in range(0, len(flat), 65536):
            r, c = np.divmod(flat[at : at + 65536], len(part))
            r, c = live[r], part[c]
            other = (code[own[r]] != code[c]) & ~beaten[r]
            r, c = r[other], c[other]
            d2, q = ((x[own[r]] - x[c]) ** 2).sum(axis=1), own[r]
            beaten[r[np.isfinite(d2) & ((d2 < tau2[q]) | (d2 == tau2[q]) & (ids[c] < last[q]))]] = True
    return beaten


def _differing(part: pa.Table, features: str, pivots: np.ndarray | None) -> pa.Table:
    """Ids of the queries that have a row of another class here before their bound (tau2, then the id ``last``).

    Cells near the queries come first, and rows whose ring differs by more than the bound from a query's distance to their pivot are left out.
    """
    part = part.combine_chunks()
    asks, ids, cell, ring, tau2, last = (part[c].to_numpy() for c in ("ask", "id", "cell", "ring", "tau2", "last"))
    code = part["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    x = matrix(part[features])
    whole = np.isfinite(x).all(axis=1)
    q, c = np.flatnonzero(asks & whole), np.flatnonzero(~asks & whole)
    found = [np.empty(0, np.int64)]
    if len(q) and len(c):
        q = q[np.lexsort((ring[q], cell[q]))]
        cells, at = np.unique(cell[c], return_inverse=True)
        for lo in range(0, len(q), 1024):
            own, to = q[lo : lo + 1024], c
            if pivots is not None:
                away = _distances(x[own], pivots[cells])
                reach = np.sqrt(tau2[own])[:, None] * (1 + 1e-9) + 1e-9 * (1 + away)
                low, high = (away - reach).min(axis=0)[at], (away + reach).max(axis=0)[at]
                near = np.flatnonzero((ring[c] >= low) & (ring[c] <= high))
                to = c[near[np.argsort(away.min(axis=0)[at[near]], kind="stable")]]
            found.append(own[_beaten(x, ids, code, own, to, tau2, last)])
    return part.select(["id"]).take(pa.array(np.concatenate(found)))


class Cells:
    """Rows in cells around pivots: each lies in the cell of its nearest pivot, at a distance from it (its ring).

    Cells that lie near each other share a shelf of at most ``meet`` rows; a larger cell is a shelf of its own, cut into parts.
    """

    def __init__(self, rows: DataFrame, n: int, block: int, features: str, meet: int):
        self.features, self.meet_rows = features, meet
        count = max(1, min(PIVOTS, -(-n // block)))
        chosen = rows.select("id", features).orderBy(F.xxhash64("id"), "id").limit(count).collect() if count > 1 else []
        self.pivots = np.array([r[features] for r in chosen], dtype=np.float64) if chosen else None
        self.rows = rows.select("id", "label", features)
        self.rows = materialize(self.placed(self.rows), "cells") if chosen else self.placed(self.rows)
        found = {0: {"n": n, "far": 0.0}} if not chosen else {r["cell"]: r for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~F.isnan("ring"), F.col("ring"))).alias("far")).collect()}  # a row per pivot
        self.sizes = np.array([found[i]["n"] if i in found else 0 for i in range(count)])
        self.radius = np.array([found[i]["far"] if i in found and found[i]["far"] is not None else -np.inf for i in range(count)])
        self.shelf, self.parts = self._filled(self.sizes)

    def _filled(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shelf of each cell and the parts of each shelf, for cells of these sizes."""
        shelf, parts, filled = np.zeros(len(sizes), np.int64), [], None  # rows of the shelf that is being filled
        for i in self._along().tolist():
            size = int(sizes[i])
            if filled is None or filled + size > self.meet_rows:
                parts.append(max(1, -(-size // self.meet_rows)))
                filled = 0
            shelf[i] = len(parts) - 1
            filled += size
        return shelf, np.array(parts)

    def _along(self) -> np.ndarray:
        """Cells in the order of their pivots along the direction in which these vary most."""
        if self.pivots is None or not np.isfinite(self.pivots).all():
            return np.arange(len(self.sizes))
        off = self.pivots - self.pivots.mean(axis=0)
        return np.argsort(off @ np.linalg.eigh(off.T @ off)[1][:, -1], kind="stable")

    def _mapped(self, df: DataFrame, add, more: str) -> DataFrame:
        own, features = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), self.features

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in parts:
                for lo in range(0, whole.num_rows, 256):  # a row may leave once for every shelf
                    part = whole.slice(lo, 256)
                    yield add(part, matrix(part[features]))

        return df.mapInArrow(run, f"{own}, {more}")

    def placed(self, df: DataFrame) -> DataFrame:
        """df with the cell of each row and its ring."""
        if self.pivots is None:
            return df.withColumn("cell", F.lit(0)).withColumn("ring", F.lit(0.0))
        pivots = self.pivots

        def add(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
            d = _distances(x, pivots)
            cell = d.argmin(axis=1)
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*part.schema.names, "cell", "ring"])

        return self._mapped(df, add, "cell int, ring double")

    def _may(self) -> Callable[[pa.RecordBatch, np.ndarray], np.ndarray]:
        """Which cells other than its own may hold a row within tau of a query."""
        pivots, radius = self.pivots, self.radius

        def may(part: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
            d, tau = _distances(x, pivots), part["tau"].to_numpy()
            out = d - radius[None, :] <= (tau * (1 + 1e-9) + 1e-9 * (1 + d.min(axis=1)))[:, None]
            out[np.arange(len(d)), part["cell"].to_numpy()] = False
            return out

        return may

    def asked(self, queries: DataFrame, shelf: np.ndarray | None = None) -> DataFrame:
        """Queries, once for each shelf but their own with a cell that may hold a row within tau; with ``shelf``, for its shelves, their own included."""
        may, own = self._may(), shelf is not None
        shelf = shelf if own else self.shelf
        n = int(shelf.max()) + 1
        order = np.argsort(shelf, kind="stable")
        starts = np.searchsorted(shelf[order], np.arange(n))

        def add(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
            to = np.logical_or.reduceat(may(part, x)[:, order], starts, axis=1)
            to[np.arange(len(x)), shelf[part["cell"].to_numpy()]] = own
            q, found = np.nonzero(to)
            rows = part.take(pa.array(q))
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(found.astype(np.int32))], [*part.schema.names, "shelf"])

        return self._mapped(queries, add, "shelf int")

    def within(self, queries: DataFrame) -> int:
        """Pairs of a query with a row of its own cell or of another that may hold a row within tau."""
        may, sizes = self._may(), self.sizes

        def add(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
            n = may(part, x) @ sizes + sizes[part["cell"].to_numpy()]
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int64))], [*part.schema.names, "n"])

        return self._mapped(queries, add, "n long").agg(F.sum("n")).first()[0] or 0

    def shelved(self, df: DataFrame, shelf: np.ndarray | None = None) -> DataFrame:
        """df with the shelf of each row's cell."""
        shelf = self.shelf if shelf is None else shelf
        return df.withColumn("shelf", F.get(F.expr(f"array({', '.join(map(str, shelf.tolist()))})"), F.col("cell")).cast("int"))

    def meet(self, queries: DataFrame, k: int, others: bool, n: int | None = None) -> DataFrame:
        """The k nearest of each query (id, features, tau, cell, ring, shelf) among the rows of a shelf; queries to a shelf are cut into pieces."""
        kinds, features, pivots = dict(self.rows.dtypes), self.features, self.pivots
        asking = {0: n} if n is not None else {r["shelf"]: r["n"] for r in queries.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shelf
        pieces = [-(-asking.get(i, 0) // self.meet_rows) for i in range(len(self.parts))]
        of = lambda counts: F.get(F.expr(f"array({', '.join(map(str, counts))})"), F.col("shelf"))
        here, every = _here, _every
        left = queries.select("id", F.lit(None).cast(kinds["label"]).alias("label"), features, "tau", "ring", F.lit(True).alias("ask"), "cell", "shelf",
                              here(of(pieces), 1).alias("i"), every(of(self.parts)).alias("j"))
        right = self.shelved(self.rows).select("id", "label", features, F.lit(0.0).alias("tau"), "ring", F.lit(False).alias("ask"), "cell", "shelf",
                                               every(of(pieces)).alias("i"), here(of(self.parts), 2).alias("j"))
        return left.unionByName(right).groupBy("shelf", "i", "j").applyInArrow(
            lambda part: _nearest(part, k, features, others, pivots), f"query {kinds['id']}, id {kinds['id']}, label {kinds['label']}, d2 double")


    def own_class(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest of each query (id, label, features, cell, ring) in each part of its own class; no part and no piece of queries is beyond ``meet``."""
        kinds, features, pivots, meet = dict(self.rows.dtypes), self.features, self.pivots, self.meet_rows
        both = queries.select("label", F.lit(1).alias("q")).unionByName(self.rows.select("label", F.lit(0).alias("q")))
        sizes = both.groupBy("label").agg(F.sum("q").alias("q"), F.ceil(F.sum(1 - F.col("q")) / meet).cast("int").alias("_parts"))
        # queries of 1024 and more are cut further, until all cores have several tasks
        tasks = 4 * self.rows.sparkSession.sparkContext.defaultParallelism
        spread = F.least(F.ceil(F.col("q") / 1024), F.ceil(F.col("q") * tasks / F.greatest(F.sum("q").over(Window.partitionBy(F.lit(0))), F.lit(1)) / F.greatest("_parts", F.lit(1))))  # a row per class
        cut = sizes.select("label", "_parts", F.greatest(F.ceil(F.col("q") / meet), spread).cast("int").alias("_pieces"))
        cut = F.broadcast(cut.withColumnRenamed("label", "_label"))  # a row per class
        dealt = lambda df, ask, i, j: (df.join(cut, F.col("label").eqNullSafe(F.col("_label"))).select(
            "id", "label", features, F.lit(float("inf")).alias("tau"), "ring", F.lit(ask).alias("ask"), "cell", i.alias("i"), "_parts", "_pieces").withColumn("j", j).drop("_parts", "_pieces"))
        left = dealt(queries, True, _here(F.col("_pieces"), 1), _every(F.col("_parts")))
        right = dealt(self.rows, False, _every(F.col("_pieces")), _here(F.col("_parts"), 2))
        return left.unionByName(right).groupBy("label", "i", "j").applyInArrow(
            lambda part: _nearest(part, k, features, False, pivots), f"query {kinds['id']}, id {kinds['id']}, label {kinds['label']}, d2 double")

    def differing(self, queries: DataFrame, low: int, high: int) -> DataFrame:
        """Ids of queries (id, label, features, cell, ring, tau, tau2, last) before whose bound a row of another class lies, among the
        rows of the shares low to high - 1 of ``SHARES``."""
        m, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
        features, pivots = self.features, self.pivots
        shelf, parts = self._filled(-(-self.sizes * (high - low) // SHARES))
        pieces = F.lit(max(1, -(-m // self.meet_rows), min(-(-m // 1024), -(-4 * cores // len(parts)))))
        of = F.get(F.expr(f"array({', '.join(map(str, parts))})"), F.col("shelf"))
        share = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SHARES))
        asked = self.asked(queries, shelf) if pivots is not None and len(parts) > 1 else self.shelved(queries, shelf) if len(parts) > 1 else queries.withColumn("shelf", F.lit(0))
        left = asked.select("id", "label", features, "tau2", "last", "ring", F.lit(True).alias("ask"), "cell", "shelf", _here(pieces, 1).alias("i"), _every(of).alias("j"))
        right = self.shelved(self.rows.where((share >= low) & (share < high)), shelf).select(
            "id", "label", features, F.lit(0.0).alias("tau2"), F.lit(0).cast(dict(self.rows.dtypes)["id"]).alias("last"), "ring", F.lit(False).alias("ask"), "cell", "shelf",
            _every(pieces).alias("i"), _here(of, 2).alias("j"))
        found = left.unionByName(right).groupBy("shelf", "i", "j").applyInArrow(lambda part: _differing(part, features, pivots), f"id {dict(self.rows.dtypes)['id']}")
        return found.distinct()


def _here(n: Column, salt: int) -> Column:
    """One of n pieces, by a hash of the id."""
    return F.pmod(F.xxhash64(F.lit(salt), "id"), n).cast("int")


def _every(n: Column) -> Column:
    """All of n pieces, if there are any."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))))


def class_neighbours(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096, features: str = "features", meet: int | None = None) -> DataFrame:
    """(query, id, label, d2, rank): as ``neighbours``, among the rows of a query's own class; all classes in one pass.

    Pieces of the queries and parts of the rows of a class meet in tasks, which leave out cells that the bound found so far rules out.
    """
    n = rows.count()
    cells = Cells(rows, n, block, features, meet or meeting_rows(rows, n, features))
    return _ranked(cells.own_class(_asking(cells, queries, features), k), k)


def _asking(cells: Cells, queries: DataFrame, features: str) -> DataFrame:
    at = cells.placed(queries.select("id", "label", features))
    return materialize(at, "asking") if cells.pivots is not None else at


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "id"))).where(F.col("rank") <= k)


def mixed(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096, features: str = "features", meet: int | None = None) -> DataFrame:
    """(id): the queries, rows themselves, that have a row of another class among their k nearest rows (by distance, then id).

    That is so if and only if a row of another class lies before the k-th nearest of the query's own.  So a query first meets its own
    class alone, which is the bound; then growing shares of all rows, and it is out of the search with the first row of another
    class before its bound.  Labels are not null; ids are unique numbers.
    """
    n = rows.count()
    cells = Cells(rows, n, block, features, meet or meeting_rows(rows, n, features))
    at = _asking(cells, queries, features)
    last = F.max(F.struct("d2", F.col("id").alias("last")))
    bound = _ranked(cells.own_class(at, k), k).groupBy(F.col("query").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, last).alias("_far"))
    none = F.lit(float("inf"))
    left = materialize(at.join(bound, "id", "left").select(
        "id", "label", features, "cell", "ring", F.coalesce("_far.d2", none).alias("tau2"), F.sqrt(F.coalesce("_far.d2", none)).alias("tau"),
        F.coalesce("_far.last", F.lit(0)).cast(dict(rows.dtypes)["id"]).alias("last")), "bounded")
    out = None
    for low, high in ((0, 1), (1, 4), (4, SHARES)) if len(cells.parts) > 1 or cells.parts[0] > 1 else ((0, SHARES),):
        found = materialize(cells.differing(left, low, high), "mixed")
        left = left.join(found, "id", "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def neighbours(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096, features: str = "features", others: bool = False, report: dict | None = None,
               meet: int | None = None) -> DataFrame:
    """(query, id, label, d2, rank): the k nearest rows of every query row, itself left out unless the rows are ``others``, with ids of their own.

    Rows lie in cells of about ``block`` rows around pivots (at most ``PIVOTS``), and cells on shelves.  A
    query first meets its own shelf, own cell first; its k-th distance there bounds, by the triangle
    inequality, which other cells can hold nearer rows, and only to their shelves it is sent, once to
    each.  Shelves and what asks for them are cut into pieces, so no task gets more than ``meet`` rows
    of either (by default by their number of components).  ``report`` gets the pairs of query and row in all and
    those in cells that had to be looked at.  Ties go to the smaller id; ids are unique numbers.
    """
    n = rows.count()
    cells = Cells(rows, n, block, features, meet or meeting_rows(rows, n, features))
    at = cells.placed(queries.select("id", features)).withColumn("tau", F.lit(float("inf")))
    at = cells.shelved(materialize(at, "asking") if cells.pivots is not None else at)
    w = Window.partitionBy("query").orderBy("d2", "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    first = best(cells.meet(at, k, others, n if queries is rows and cells.pivots is None else None))
    if cells.pivots is None and report is not None:
        report.update(pairs=at.count() * n, compared=at.count() * n)
    if len(cells.parts) == 1 and (report is None or cells.pivots is None):
        return first
    first = materialize(first.drop("rank"), "own-shelf")
    bound = first.groupBy(F.col("query").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d2"))).alias("_tau"))
    more = at.drop("tau", "shelf").join(bound, "id", "left").withColumn("tau", F.coalesce("_tau", F.lit(float("inf")))).drop("_tau")
    if report is not None:
        report.update(pairs=at.count() * n, compared=cells.within(more))
    if len(cells.parts) == 1:
        return best(first)
    return best(first.unionByName(cells.meet(cells.asked(more), k, others)))


def top_margin(rows: DataFrame, scores: str) -> DataFrame:
    """The best score minus the second best of each row."""
    s = F.sort_array(scores, False)
    return rows.withColumn("margin", F.get(s, F.lit(0)) - F.get(s, F.lit(1)))
