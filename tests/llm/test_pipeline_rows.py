"""Pipeline stages on rows without doc_id, repeated rows and texts that share a doc_id."""

import random
from collections import Counter

import corpus_pipeline

from .test_small import SF, given

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)


def fresh(n=60):
    return " ".join("".join(rng.choice("bcdfgh") for _ in range(6)) for _ in range(n))


def stage(spark, name, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], COLUMNS).repartition(3)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.columns == corpus_pipeline.COLUMNS
    return Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())


def test_one_row_of_each_group(spark):
    a, b, c, d, e, f, g = (fresh() for _ in range(7))
    near = a + " another end"
    rows = [
        (5, a, "s"), (None, a, "s"), (3, near, "s"), (None, near, "s"),  # 3 is the smallest with an id
        (None, b, "s"), (None, b, "s"), (None, b + " more", "s"),  # none has an id: one stays
        (7, c, "s"), (7, c, "s"), (7, c, "s"),  # repeated rows
        (9, d, "s"), (9, e, "s"), (1, d, "s"),  # 9 is two texts; only d has a copy
        (11, f, "s"), (11, f + " x", "s"),  # two near texts under one id
        (None, g, "s"), (13, "", "s"), (13, "", "s"), (14, "", "s"),
    ]
    out = stage(spark, "near_duplicates", rows)
    assert sum(n for (_, t, _), n in out.items() if t in (b, b + " more")) == 1
    assert sum(n for (i, _, _), n in out.items() if i == 11) == 1
    rest = {k: n for k, n in out.items() if k[1] not in (b, b + " more", f, f + " x")}
    assert rest == Counter([(3, near, "s"), (7, c, "s"), (9, e, "s"), (1, d, "s"), (None, g, "s"), (13, "", "s"), (14, "", "s")])


def test_contaminated_texts_go_whatever_their_id(spark):
    item = given(spark, "benchmark")[0]["text"]
    bad = f"{fresh()} {item} {fresh()}"
    own = [fresh() for _ in range(4)]
    rows = [(None, bad, "a"), (2, bad + " x", "a"), (2, own[0], "a"), (3, bad, "b"), (3, bad, "c"), (None, own[1], "a"), (4, own[2], "a"), (4, own[2], "b"), (5, "", "a")]
    assert stage(spark, "decontaminate", rows) == Counter([(2, own[0], "a"), (None, own[1], "a"), (4, own[2], "a"), (4, own[2], "b"), (5, "", "a")])
