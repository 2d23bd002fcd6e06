"""Planted passages of over 50 words: the width in bytes alone decides whether they go."""

import random

from pyspark.sql import functions as F

from isochron.llm import suffixes

from . import brute
from .test_small import given


def planted(items):
    """Every item in two documents between words of their own, and two items in a row in two more."""
    rng = random.Random(8)
    own = lambda: "".join(rng.choice("qvwxz ") for _ in range(rng.randrange(40, 200)))
    return [own() + t + own() for t in [*items, items[0] + " " + items[1]] for _ in range(2)]


def test_planted_passages_go_at_their_own_width_and_stay_below_it(spark):
    items = [r["text"] for r in given(spark, "benchmark") if len(r["text"].split()) > 50]
    sizes = [len(t.encode()) for t in items]
    assert len(items) > 1 and 256 < min(sizes) and max(sizes) < 400
    texts = planted(items)
    rows = [{"text": t} for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    result = {}
    for width in (400, min(sizes)):
        out = suffixes.dedup_passages(docs, width=width).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256), "spans").collect()
        result[width] = sorted(map(tuple, out))
        assert [r[:5] for r in result[width]] == [(i, *x) for i, x in enumerate(brute.repeats(rows, width))]
    for i, (wide, narrow) in enumerate(zip(result[400], result[min(sizes)], strict=True)):
        # items 0 and 1 also lie in the double passage, but each alone is shorter than 400 bytes
        assert (wide[2] > 0) == (i >= 2 * len(items)) and wide[1] == narrow[1]
        passage = items[i // 2] if i // 2 < len(items) else items[0] + " " + items[1]
        at = texts[i].encode().index(passage.encode())
        assert any(a <= at and at + len(passage.encode()) <= z for a, z in narrow[5])
