"""Exact inner-product search by columnar branch and bound."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.string())])


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list array as float64, zero beyond a vector's own length."""
    lists = vectors.cast(pa.list_(pa.float64()))
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


class BranchAndBound:
    """The best k candidates of each query, fed with blocks of candidates.

    Candidates lie dimension by dimension (vertical layout).  Scores are added up over
    blocks of dimensions; after each block the Cauchy-Schwarz product of the remaining
    norms bounds what a candidate can still gain, and those that cannot reach the
    query's k-th best score are dropped, so later blocks touch survivors only.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, block: int, rows: int = 512):
        self.ids, self.k, self.block, self.rows = ids, k, block, rows
        self.q = np.ascontiguousarray(vectors)
        self.q_rest = self._rest(self.q)
        self.floor = np.full(len(ids), -np.inf)
        # a float of a 64-bit sum is off by 2**9 at most
        self.slack = 2.0**11 if self.q.dtype == np.int64 else 0.0
        self.best: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.q.dtype))

    def _rest(self, x: np.ndarray) -> np.ndarray:
        """Norms of what lies beyond each block of dimensions, rounded up a little."""
        ends, x = range(self.block, x.shape[1] + self.block, self.block), x.astype(np.float64)
        return np.stack([np.sqrt((x[:, e:] ** 2).sum(axis=1)) * (1 + 1e-9) for e in ends] or [np.zeros(len(x))])

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        columns, rest = np.ascontiguousarray(x.T), self._rest(x)
        at = np.searchsorted(self.ids, ids)
        own = np.flatnonzero((at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == ids))
        found = []
        for lo in range(0, len(self.ids), self.rows):
            hi = min(lo + self.rows, len(self.ids))
            mine = own[(at[own] >= lo) & (at[own] < hi)]
            found.append(self._block(lo, hi, columns, rest, at[mine] - lo, mine))
        q, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
        self._keep(q, ids[c], s)

    def _block(self, lo: int, hi: int, columns: np.ndarray, rest: np.ndarray, own_q: np.ndarray, own_c: np.ndarray):
        q, floor, dims = self.q[lo:hi], self.floor[lo:hi], columns.shape[0]
        score = np.zeros((hi - lo, columns.shape[1]), q.dtype)
        alive, pairs = np.arange(columns.shape[1]), None
        for b, d in enumerate(range(0, dims, self.block)):
            e = min(d + self.block, dims)
            if pairs is None:
                score += q[:, d:e] @ columns[d:e, alive]
                bound = score + self.q_rest[b, lo:hi, None] * rest[b, alive][None, :] + self.slack
                live = bound >= floor[:, None]
                if e < dims and live.mean() < 0.15:
                    r, c = np.nonzero(live)
                    pairs = (r, alive[c], score[r, c])
                elif e < dims and (some := live.any(axis=0)).mean() < 0.7:
                    alive, score = alive[some], score[:, some]
            else:
                r, c, s = pairs
                s = s + np.einsum("ij,ji->i", q[r, d:e], columns[d:e, c])
                keep = s + self.q_rest[b, lo + r] * rest[b, c] + self.slack >= floor[r]
                pairs = (r[keep], c[keep], s[keep])
        if pairs is None:
            where = np.full(columns.shape[1], -1)
            where[alive] = np.arange(len(alive))
            seen = where[own_c] >= 0
            never = np.iinfo(np.int64).min if self.slack else -np.inf
            score[own_q[seen], where[own_c[seen]]] = never
            least = floor
            if score.shape[1] > self.k:
                cut = score.shape[1] - self.k
                least = np.maximum(floor, np.partition(score, cut, axis=1)[:, cut])
            r, c = np.nonzero((score >= least[:, None] - self.slack) & (score > never))
            pairs = (r, alive[c], score[r, c])
        else:
            r, c, s = pairs
            mine = np.isin(r * columns.shape[1] + c, own_q * columns.shape[1] + own_c)
            pairs = (r[~mine], c[~mine], s[~mine])
        return pairs[0] + lo, pairs[1], pairs[2]

    def _keep(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        q, ids, s = (np.concatenate(x) for x in zip(self.best, (q, ids, s), strict=True))
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.best = q[kept], ids[kept], s[kept]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])


def _exact(ids: np.ndarray, q: np.ndarray, cand: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The best k of each query by whole numbers of any size; for tables whose scores no long can hold."""
    whole = np.frompyfunc(int, 1, 1)
    x, names = whole(x.astype(object)), cand.tolist()
    at, found, best = [], [], []
    for i, own in enumerate(q):
        order = heapq.nsmallest(k, ((-s, c) for s, c in zip((x @ whole(own.astype(object))).tolist(), names, strict=True) if c != ids[i]))
        at += [i] * len(order)
        found += [c for _, c in order]
        best += [-s for s, _ in order]
    return np.array(at, dtype=np.int64), np.array(found, dtype=np.int64), best


def _search(part: pa.Table, dims: int, k: int, block: int, pieces: int, digits: int, kind: type) -> pa.Table:
    """One block of queries against one block of candidates."""
    part = part.combine_chunks()
    asks = part["ask"].to_numpy()
    ids, x = part["vec_id"].to_numpy(), part["embedding"].combine_chunks()
    q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
    q = q[np.argsort(ids[q])]
    if not len(q) or not len(c):
        return FOUND.empty_table()
    queries, rows = _matrix(x.take(pa.array(q)), dims), _matrix(x.take(pa.array(c)), dims)
    if digits:
        at, found, score = _exact(ids[q], queries, ids[c], rows, k)
        keys = pa.array([f"{s + 10**digits:0{digits + 1}d}" for s in score], pa.string())
        score = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in score], dtype=np.int64)
    else:
        search = BranchAndBound(ids[q], queries.astype(kind), k, block)
        search.floor = np.maximum(search.floor, part["floor"].to_numpy()[q])
        rows = rows.astype(kind)
        for lo in range(0, len(c), pieces):
            search.add(ids[c[lo : lo + pieces]], rows[lo : lo + pieces])
        at, found, score = search.best
        keys = pa.nulls(len(at), pa.string())
    return pa.Table.from_arrays([pa.array(ids[q][at]), pa.array(found), pa.array(score.astype(np.int64)), keys], schema=FOUND)


def top_k(vectors: DataFrame, k: int = 20, query_mod: int = 20, scale: float = 64.0, block: int = 16,
          query_block: int = 8192, row_block: int = 16384, candidates: int = 1024) -> DataFrame:
    """The k rows with the highest integer inner product for every query row.

    Components become floor(scale * x).  Queries are the rows whose vec_id is divisible
    by ``query_mod``; candidates are all other rows.  Queries and candidates are dealt into
    blocks of about ``query_block`` and ``row_block`` rows, and a task holds one block of
    each: blocks travel by shuffle, no vector passes the driver, and a task's memory does
    not grow with the table.  All queries meet the first block of candidates; their k-th
    best score there is the bound that prunes the search of every other block.  Only k rows
    per query and block go on.

    Scores are exact: sums of integers below 2**53 as floats, below 2**63 as 64-bit
    integers, and above that as whole numbers of any size, which rank exactly; the column
    score then ends at the limits of a long.

    Null vectors, vectors with a null or non-finite component (also after scaling) and rows
    without vec_id take no part.  Vectors of unequal length are padded with zeros.  Of rows
    that repeat a query's vec_id the least vector is the query and none is its candidate;
    other repeated rows count each.  Ties go to the smaller vec_id.  An empty table gives
    no rows.  Other columns are not read.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    # floor(x * scale) as a double: a long would overflow, and doubles from 2**53 on have no fraction
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = rows.withColumn("embedding", F.transform("embedding", whole))
    facts = rows.agg(
        F.max(F.size("embedding")).alias("dims"), F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.when(F.col("vec_id") % query_mod == 0, F.col("vec_id"))).alias("queries"),
        F.max(F.coalesce(F.array_max(F.transform("embedding", F.abs)), F.lit(0.0))).alias("most"),
    ).first()
    dims, most = facts["dims"] or 0, int(facts["most"] or 0)
    bound = dims * most**2
    kind = np.float64 if bound < 2**53 else np.int64
    digits = len(str(bound)) if bound >= 2**62 else 0
    asks, blocks = max(1, -(-facts["queries"] // query_block)), max(1, -(-facts["n"] // row_block))
    queries = (rows.where(F.col("vec_id") % query_mod == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
               .withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(asks)).cast("int")))
    # dealt by place and not by id, which may repeat
    dealt = rows.withColumn("cb", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt = materialize(dealt, "vectors") if blocks > 1 else dealt

    def grid(asked: DataFrame, given: DataFrame, first: int, last: int) -> DataFrame:
        """Every block of queries with the candidates' blocks first..last."""
        left = asked.select("vec_id", "embedding", "floor", F.lit(True).alias("ask"), "qb", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("cb"))
        right = given.select("vec_id", "embedding", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("ask"),
                             F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("qb"), "cb")
        return left.unionByName(right).groupBy("qb", "cb").applyInArrow(
            lambda part: _search(part, dims, k, block, candidates, digits, kind), "query_id long, vec_id long, score long, key string")

    best = Window.partitionBy("query_id").orderBy(F.col("key").desc(), F.col("score").desc(), F.col("vec_id"))
    low = F.lit(float("-inf"))
    out = grid(queries.withColumn("floor", low), dealt.where("cb = 0"), 0, 0)
    if blocks > 1:
        out = materialize(out, "first-scores")
        floors = (out.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").cast("double").alias("_least"))
                  .select("vec_id", F.when(F.col("_n") >= k, F.col("_least")).alias("floor")))
        asked = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", low))
        out = out.unionByName(grid(asked, dealt.where("cb > 0"), 1, blocks - 1))
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
