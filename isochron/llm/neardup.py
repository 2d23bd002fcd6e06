"""Near-duplicate groups by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, remove, small_batches, text_key
from .components import components, forest
from .minhash import band_hashes, set_keys, shingle_sets, super_minhash

#: Nodes of rows without doc_id lie above all ids.
NAMELESS = 1 << 62


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in part["text"].to_pylist()]


def _nodes(ids: list[int | None], keys: np.ndarray) -> np.ndarray:
    return np.array([NAMELESS | int(k) >> 3 if i is None else i for i, k in zip(ids, keys[:, 0], strict=True)], dtype=np.int64)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per document: the size and a 128-bit key of its shingle set, and its band hashes."""

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in parts:
            sets = shingle_sets(_texts(part), words)
            keys = set_keys(sets)
            hashes = band_hashes(super_minhash(sets, bands * rows), rows)
            offsets = pa.array(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(_nodes(part["doc_id"].to_pylist(), keys)), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(hashes.reshape(-1).view(np.int64)))],
                ["doc_id", "node", "n", "f1", "f2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sketch, "doc_id long, node long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int, broadcast_rows: int) -> DataFrame:
    """(node, shingles): the full sets of the given nodes, as sorted 8-byte hashes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = nodes.where(F.col("node") < NAMELESS).select(F.col("node").alias("doc_id"))
    # at most broadcast_rows ids of 8 bytes go out to all; beyond that texts are shuffled
    named = docs.join(F.broadcast(few) if few.count() <= broadcast_rows else few, "doc_id", "left_semi")
    wanted = named.unionByName(docs.where(F.col("doc_id").isNull()))

    def collect(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = shingle_sets(_texts(part), words)
            nodes = _nodes(part["doc_id"].to_pylist(), set_keys(sets))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return wanted.mapInArrow(collect, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for a, b in zip(part["sa"], part["sb"], strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                keep.append(shared > 0 and den * shared >= num * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part["a"].filter(keep), part["b"].filter(keep)], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long")


def _block_links(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """All links within one block pair, by exact intersection counts, reduced to stars."""
    pdf = pdf.drop_duplicates(["node", "side"]).sort_values("node")
    sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
    sizes, node = np.array([len(s) for s in sets]), pdf["node"].to_numpy()
    vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    x, y = (pdf["side"].to_numpy() == 0).nonzero()[0], (pdf["side"].to_numpy() == 1).nonzero()[0]
    y = y if len(y) else x
    shared = np.zeros((len(x), len(y)), dtype=np.float32)
    spot_x, spot_y = np.full(len(sets), -1), np.full(len(sets), -1)
    spot_x[x], spot_y[y] = np.arange(len(x)), np.arange(len(y))
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for lo in range(0, len(vocabulary), 4096):
        part = slice(*np.searchsorted(code, [lo, lo + 4096]))
        one = np.zeros((len(sets), min(4096, len(vocabulary) - lo)), dtype=np.float32)
        one[row[part], code[part] - lo] = 1
        shared += one[x] @ one[y].T
    union = sizes[x][:, None] + sizes[y][None, :] - shared
    i, j = np.nonzero((shared > 0) & (den * shared.astype(np.int64) >= num * union.astype(np.int64)))
    edges = forest(zip(node[x[i]].tolist(), node[y[j]].tolist(), strict=True))
    return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")


def groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = 24, rows: int = 4,
           small: int = 32, block: int = 512, block_bytes: int = 16 << 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of num/den or
    more are linked, and a component is what links reach; its smallest doc_id names it and
    is the one kept.  Steps:

    1. A SuperMinHash signature of bands * rows values per document; equal sets collapse
       to one node (the smallest doc_id), so copies cost one row each from here on.
    2. Nodes that share a band are candidates.  With 24 bands of 4 rows a link of
       similarity 0.8 is missed with a probability of (1 - 0.8**4)**24 = 3e-6.
    3. Each bucket's members are compared with its smallest and its largest node: the
       number of pairs is linear however large the bucket.  Full sets confirm links.
    4. Components so far settle most buckets.  In the others only members of different
       components are still open: small buckets give those pairs (with sizes that can
       reach the threshold at all); large ones are cut into blocks of at most ``block``
       members, and block pairs outside the bucket's largest component are compared by
       exact intersection counts, each returning at most a star per set.  No bucket meets
       in one task, none is cut short.

    Documents without words have no shingles and no links.  Null text counts as none.  A
    row without doc_id gets a null component_id unless a document with an id is reachable.
    Rows with one doc_id are one document: repeated rows share all values, different
    texts under one id count as linked.  Empty table: no rows.  Other columns are not read.
    Ids may be any 64-bit numbers: from ``NAMELESS`` on they leave no room for rows without
    one, and rows are numbered first (``_numbered``).
    """
    small_batches(docs.sparkSession)
    if (docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0) >= NAMELESS:
        how = {"words": words, "num": num, "den": den, "bands": bands, "rows": rows, "small": small, "block": block, "block_bytes": block_bytes}
        return _numbered(docs, broadcast_rows=broadcast_rows, **how)
    sketched = materialize(sketches(docs, words, bands, rows), "sketches")
    classes = (sketched.where("n > 0").groupBy("f1", "f2")
               .agg(F.min("node").alias("node"), F.max("n").alias("n"), F.first("bands").alias("bands")))
    classes = materialize(classes, "classes")
    members = classes.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = materialize(
        members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("low"), F.max("node").alias("high"))
        .where("members > 1"), "buckets")
    live = materialize(members.join(buckets, "bucket"), "live")
    sets = materialize(_sets(docs, live.select("node").distinct(), words, broadcast_rows), "sets")
    fits = lambda a, b: (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)
    stars = (live.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a != b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tested = materialize(stars, "pairs")
    links = materialize(_verified(tested, sets, num, den), "links")
    found = components(links)

    marked = live.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = materialize(marked.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"), F.max("members").alias("members")), "parts")
    open_ = (parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max("c").alias("c"), F.max("members").alias("members"))
             .where("k > 1").select("bucket", "c", "members"))
    major = (parts.join(open_.select("bucket", "c"), ["bucket", "c"]).groupBy("bucket").agg(F.min("component").alias("major"), F.max("c").alias("c")))
    major = materialize(major, "major")
    opened = materialize(marked.join(major, "bucket"), "opened")

    little = opened.where(F.col("members") <= small).select("bucket", "node", "n", "component")
    other = little.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = (little.join(other, "bucket").where((F.col("node") > F.col("b")) & (F.col("component") != F.col("cb")) & fits("n", "nb"))
             .select(F.col("node").alias("a"), "b").distinct().join(tested, ["a", "b"], "left_anti"))
    # each Python step ends in a table: two in one stage would be two workers a core
    open_pairs = materialize(pairs, "pairs")
    more = materialize(_verified(open_pairs, sets, num, den), "more-links")

    large = opened.where(F.col("members") > small).join(sets, "node")
    bytes_ = F.coalesce(F.length("shingles"), F.lit(0)).cast("long")
    inside = F.col("component") == F.col("major")
    counts = (large.groupBy("bucket").agg(
        F.count(F.when(inside, 1)).alias("nm"), F.count(F.when(~inside, 1)).alias("no"),
        F.coalesce(F.sum(F.when(inside, bytes_)), F.lit(0)).alias("bm"), F.coalesce(F.sum(F.when(~inside, bytes_)), F.lit(0)).alias("bo")))
    blocks = lambda n, b: F.greatest(F.lit(1), F.ceil(F.col(n) / block), F.ceil(F.col(b) / block_bytes)).cast("int")
    counts = materialize(counts.select("bucket", blocks("nm", "bm").alias("pm"), blocks("no", "bo").alias("po")), "blocks")
    own = F.pmod(F.xxhash64("node"), F.when(inside, F.col("pm")).otherwise(F.col("po"))).cast("int")
    dealt = (
        large.join(counts, "bucket").withColumn("own", own)
        # outsiders (o) meet each other and the largest component's members (m): keys are block pairs
        .withColumn("to", F.expr("""
            CASE WHEN component = major THEN transform(sequence(0, po - 1), i -> struct(i AS i, own AS j, 1 AS side, true AS m))
            ELSE concat(transform(sequence(0, pm - 1), j -> struct(own AS i, j AS j, 0 AS side, true AS m)),
                        transform(sequence(0, po - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j, IF(own <= x, 0, 1) AS side, false AS m))) END"""))
        .select("bucket", "node", "shingles", F.explode("to").alias("to"))
        .select("bucket", "to.i", "to.j", "to.m", "to.side", "node", "shingles"))
    blocked = materialize(dealt.groupBy("bucket", "i", "j", "m").applyInPandas(lambda pdf: _block_links(pdf, num, den), "a long, b long"), "block-links")
    for done in (open_pairs, counts, major):
        remove(done)

    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(stars.unionByName(more).unionByName(blocked))
    named = materialize(
        classes.select("f1", "f2", "node").join(final, "node", "left")
        .select("f1", "f2", F.coalesce("component", "node").alias("component")), "named")
    for done in (sets, live, opened, tested, links, buckets, parts, more, blocked, classes):
        remove(done)
    component = F.coalesce(F.col("component"), F.col("node"))
    return (
        sketched.select("doc_id", "node", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(component < NAMELESS, component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))


def _numbered(docs: DataFrame, **how) -> DataFrame:
    """``groups`` of rows under numbers of their own; then rows of one doc_id are one document, and groups get their smallest doc_id."""
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = groups(rows.select(F.col("_row").alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("_row"), "n_shingles", F.col("component_id").alias("_c"))
    own = materialize(rows.select("_row", "doc_id").join(found, "_row"), "numbered")
    remove(rows)
    spread = own.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("_c").alias("b"), F.max("_c").alias("_top")).where("b < _top")
    same = own.join(spread, "doc_id").where("_c > b").select(F.col("_c").alias("a"), "b").distinct()
    merged = components(materialize(same, "same-id")).select(F.col("node").alias("_c"), F.col("component").alias("_m"))
    own = own.join(merged, "_c", "left").withColumn("_c", F.coalesce("_m", "_c"))
    names = own.groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    return own.join(names, "_c").select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def survivors(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of near duplicates, with all its columns; ``how`` goes to ``groups``.

    Rows are told apart by a key of their own, not by doc_id: copies without doc_id are
    dropped like others, repeated rows of one doc_id are copies, and different texts under
    one doc_id are different documents.  A group's smallest doc_id is kept, a row without
    doc_id only if no row of its group has one; ties go by text, then by row.  Rows without
    words have no links and stay; of rows with the same doc_id and text one stays.
    """
    names = docs.columns
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    facts = rows.select("_row", "doc_id", *text_key(F.col("text")))
    found = groups(rows.select(F.col("_row").alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("_row"), "n_shingles", "component_id")
    alone = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    own = [F.when(~alone, F.col("component_id")).alias("_c"), *(F.when(alone, F.col(c)).alias(f"_g{i}") for i, c in enumerate(("doc_id", "_t1", "_t2")))]
    first = (facts.join(found, "_row").groupBy(*own)
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_t1", "_t2", "_row")).alias("first")))
    return rows.join(first.select("first._row"), "_row", "left_semi").select(*names)
