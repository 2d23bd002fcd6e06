"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_key


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of a whole text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(column: str, k: int, value: str) -> Column:
    """``value`` of each run of k words; of all words if there are fewer; nothing without words.

    In ``value``, %s stands for the array of words.
    """
    run, none = value % f"slice({column}, i, {k})", value % "array(y)"
    return F.expr(f"CASE WHEN size({column}) > 0 THEN transform(sequence(1, greatest(size({column}) - {k - 1}, 1)), i -> {run}) "
                  f"ELSE transform({column}, y -> {none}) END")


def _runs(column: str, k: int, short: list[int], value: str) -> Column:
    """``value`` of the document's k-word shingles, and of its runs of each of the ``short`` lengths."""
    more = [F.expr(f"CASE WHEN size({column}) >= {n} THEN transform(sequence(1, size({column}) - {n - 1}), i -> {value % f'slice({column}, i, {n})'}) "
                   f"ELSE transform(slice({column}, 1, 0), y -> {value % 'array(y)'}) END") for n in short]
    return F.concat(_shingles(column, k, value), *more) if more else _shingles(column, k, value)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100,
                 broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: the items that lie in a document.

    An item lies in a document if num/den or more of its distinct ``k``-word shingles occur
    there.  Only DataFrame functions are used.

    1. Items are partitioned by size, in classes of powers of two.  An item's sketch is
       the bottom of its MinHash order: the u - ceil(u * num / den) + 1 shingles with the
       smallest hashes, where u is the largest size of its class.  So many shingles cannot
       all be missing from a document that contains the item, whatever the document's
       length: the search loses nothing.  (A MinHash signature of the long side would: an
       item of 40 shingles in a document of 20,000 has a Jaccard similarity of 0.002, which
       no banding finds.  So the long side offers its full hash set to the sketches.)
    2. Documents probe the sketches shingle by shingle; those too small for an item are
       passed over.  Sketches of up to ``broadcast_rows`` shingles (some 20 MB) are
       broadcast, larger ones are joined by shuffling, where skewed keys are split.
    3. Candidates are verified by exact containment of the shingles as texts.

    Texts are compared as lower-cased runs of letters and digits.  An item of fewer than
    ``k`` words is one shingle and lies wherever these words follow one another; documents
    are cut into runs of such a length only if there are items of it.  Items and
    documents that are null or have no words are in no result.  Repeated rows, of items and of
    documents, count once; if texts differ under one id, the highest containment counts.
    A row without doc_id is reported with a null one.  Empty tables: no rows.  Other
    columns are not read.
    """
    return (
        _held(docs, benchmark, k, num, den, broadcast_rows)
        .groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("best"))
        .select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment"))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns.

    Texts decide, by their 128-bit keys, not ids: a row without doc_id goes if its text holds
    an item, and a clean text stays though a contaminated one has the same doc_id.
    """
    hits = materialize(_held(docs, benchmark, k, num, den, broadcast_rows).select("_t1", "_t2").distinct(), "contaminated")
    few = F.broadcast(hits) if hits.count() <= broadcast_rows else hits
    return docs.withColumns(dict(zip(("_t1", "_t2"), text_key(F.col("text")), strict=True))).join(few, ["_t1", "_t2"], "left_anti").drop("_t1", "_t2")


def _held(docs: DataFrame, benchmark: DataFrame, k: int, num: int, den: int, broadcast_rows: int) -> DataFrame:
    """doc_id, _t1, _t2, item_id, n_item, n_shared of each row and item that lies in it."""
    docs = docs.select("doc_id", "text", *text_key(F.col("text")))
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    items = materialize(items.withColumn("own", F.array_distinct(_shingles("w", k, "array_join(%s, ' ')")))
                        .select(F.monotonically_increasing_id().alias("item"), "item_id", "w", "own", F.size("own").alias("n_item")), "items")
    short = sorted(r[0] for r in items.where(F.size("w") < k).select(F.size("w")).distinct().collect())  # k - 1 lengths at most
    need = lambda n: F.ceil(n * num / den)
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_item"))) + 1) - 1
    order = Window.partitionBy("item").orderBy("h")
    sketch = (
        items.select("item", "n_item", F.explode(F.transform("own", lambda s: F.xxhash64(F.split(s, " ")))).alias("h")).distinct()
        .withColumn("class", F.floor(F.log2("n_item"))).withColumn("length", largest - need(largest) + 1)
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("length"))
        .select("h", "item", need(F.col("n_item")).cast("int").alias("need")))
    sketch = materialize(sketch, "sketches")
    small = F.broadcast(sketch) if sketch.count() <= broadcast_rows else sketch
    hashed = docs.select("_t1", "_t2", words(F.col("text")).alias("w")).select(
        "_t1", "_t2", F.greatest(F.size("w") - (k - 1), F.lit(1)).alias("size"), F.explode(_runs("w", k, short, "xxhash64(%s)")).alias("h"))
    found = (hashed.join(small, "h").where(F.col("size") >= F.col("need")).select("_t1", "_t2", "item").distinct()
             .groupBy("_t1", "_t2").agg(F.collect_list("item").alias("items")))
    found = materialize(found, "candidates")
    few = F.broadcast(found) if found.count() * 1.0 <= broadcast_rows / 4 else found
    texts = docs.join(few, ["_t1", "_t2"]).select("doc_id", "_t1", "_t2", "items", words(F.col("text")).alias("w"))
    held = texts.select("doc_id", "_t1", "_t2", "items", F.array_distinct(_runs("w", k, short, "array_join(%s, ' ')")).alias("has"))
    pairs = held.select("doc_id", "_t1", "_t2", "has", F.explode("items").alias("item")).join(items.drop("w"), "item")
    return (
        pairs.select("doc_id", "_t1", "_t2", "item_id", F.col("n_item").cast("long").alias("n_item"),
                     F.size(F.array_intersect("own", "has")).cast("long").alias("n_shared"))
        .where(F.col("n_shared") * den >= F.col("n_item") * num))
