"""Decontamination, licences and the pipeline against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isochron.llm import decontam, langid, licenses, queries

from . import brute
from .test_small import DOCS, SF, check_packing, empty, given, odd  # noqa: F401

ITEMS = "item_id long, text string, doc_id long, h long, w string"


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def contained(docs, items, k=5):
    runs = lambda w: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    out = {}
    for d in docs:
        words = plain_words(d["text"])
        for i in items:
            item = plain_words(i["text"])
            own, m = runs(item), min(k, max(len(item), 1))
            n = len(own & {tuple(words[j : j + m]) for j in range(len(words) - m + 1)})
            if own and n * 100 >= 80 * len(own):
                out[d["doc_id"], i["item_id"]] = max((n / len(own), len(own), n), out.get((d["doc_id"], i["item_id"]), (0, 0, 0)))
    return sorted(((*k, v[1], v[2], v[0]) for k, v in out.items()), key=str)


@pytest.mark.parametrize("bound", [10**6, 0])
def test_contamination(spark, odd, empty, bound):  # noqa: F811
    docs, items = given(spark), given(spark, "benchmark")
    got = decontam.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"), broadcast_rows=bound)
    assert sorted(map(tuple, got.collect()), key=str) == contained(docs, items)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, texts = [], []
    for i, n in enumerate([1, 3, 4, 5, 6, 8, 20, 40, 70, 130]):
        own = [word() for _ in range(n)]
        rows.append((i, " ".join(own), 1, 1, "x"))
        for share in (1.0, 0.9, 0.8, 0.7):
            part = own[: max(1, round(n * share))]
            texts.append(" ".join([word() for _ in range(200)] + part + [word() for _ in range(300)]))
        texts += ["; ".join(own).upper() + "!", " ".join(own)]
        changed = list(own)
        changed[n // 2] = word()
        texts.append(" ".join(changed))
    rows += [(20, None, 1, 1, "x"), (21, " .. ", 1, 1, "x"), (None, rows[7][1], 1, 1, "x"), rows[6], rows[6]]
    odd_docs = odd.select("doc_id", "text", "source", "n", "node").unionByName(
        spark.createDataFrame([(1000 + i, t, "s", 1, 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n long, node long"))
    benchmark = spark.createDataFrame(rows, ITEMS)
    got = decontam.contaminated(odd_docs, benchmark, broadcast_rows=bound).collect()
    want = contained([r.asDict() for r in odd_docs.collect()], [r.asDict() for r in benchmark.collect()])
    assert sorted(map(tuple, got), key=str) == want and len(want) > 20
    # items of fewer words than a shingle lie in long documents too
    assert {n for _, _, n, _, _ in want} >= {1} and sum(d is not None and d >= 1000 and i in (0, 1, 2) for d, i, *_ in want) > 9
    assert decontam.contaminated(empty, benchmark).collect() == []
    assert decontam.contaminated(odd, benchmark.limit(0)).collect() == []


def plain_find(text, templates, least, exclusive):
    """The rules of the scan word by word: from each start the window that shares most, then licences compete for words."""
    words = licenses.normalise(text)
    grams = list(zip(words, words[1:], strict=False))
    told = lambda g: any(w.isdigit() or w.decode() in licenses.MARKS for w in g)
    found = []
    for name, texts in templates.items():
        for own in map(licenses.normalise, texts):
            bag = list(zip(own, own[1:], strict=False))
            for i in range(len(grams)):
                best = None
                if grams[i] not in bag:
                    continue
                for j in range(i + 1, len(grams) + 1):
                    if grams[j - 1] not in bag or (j - i) * least > len(bag) * (2 - least) + 1e-9:
                        continue
                    left, shared = list(bag), 0
                    for g in grams[i:j]:
                        if g in left:
                            left.remove(g)
                            shared += 1
                    if 2 * shared >= least * (j - i + len(bag)):
                        best = max(best or (0, 0), (shared, i - j))
                if best is None:
                    continue
                shared, j = best[0], i - best[1]
                dice = 2 * shared / (j - i + len(bag))
                more = own[-1].isdigit() and words[j + 1 : j + 2] and words[j + 1].isdigit() and words[j + 1] != b"0"
                if {g for g in bag if told(g)} <= set(grams[i:j]) and not more:
                    found.append((-shared, -dice, i, name, j - i + 1))
    taken, best = [], {}
    for shared, dice, i, name, n in sorted(found):
        if not exclusive or all(i >= e or i + n <= s for s, e in taken):
            taken.append((i, i + n))
            if name not in best or -dice > best[name][0]:
                best[name] = (-dice, i, n)
    return [(k, round(best[k][0], 9), *best[k][1:]) for k in sorted(best)]


@pytest.mark.parametrize("exclusive", [True, False])
def test_licenses(spark, odd, empty, exclusive):  # noqa: F811
    templates = {"a": ["one two three four five six", "six one two one"], "b": ["all rights are reserved"], "c": ["two three four five"], "d": ["one one one two one one"],
                 "e": ["one lesser two three 2"], "f": ["one two three 2"]}
    rng = random.Random(6)
    pool = ["one", "two", "three", "four", "five", "six", "all", "rights", "reserved", "é", "2", "lesser", "1"]
    texts = [None, "", "ALL rights, ARE reserved!", "one"] + [" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(250)]
    texts += ["x one two three four five six y", "one two x three four five six", "one lesser two three 2.1", "one lesser two three 2.0", "one two three 2 one two three 2"]
    texts += [" ".join(w for w in " ".join(rng.choice(list(templates.values()))[0] for _ in range(4)).split() if rng.random() > 0.1) for _ in range(80)]
    rows = [(i if i % 7 else None, t, "mit") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    for least in (0.7, 0.8):
        got = sorted(((r["doc_id"], r["license"], round(r["dice"], 9), r["first_word"], r["n_words"]) for r in licenses.scan(docs, templates, least, exclusive).collect()), key=str)
        want = sorted(((i, *x) for i, t, _ in rows for x in plain_find(t or "", templates, least, exclusive)), key=str)
        assert got == want and len(want) > 60
    assert licenses.scan(empty).collect() == [] and len(licenses.scan(odd).collect()) == 0


def named(text):
    return [m.license for m in licenses.Templates(licenses.TEMPLATES, 0.8).find(text)]


def test_licences_are_told_from_their_neighbours():
    whole = licenses.TEMPLATES
    assert named("This work is licensed under the GNU General Public License, version 1.") == ["GPL-1.0"]
    assert named("Licensed under the GNU Lesser General Public License, version 2.1.") == ["LGPL-2.1"]
    assert named("Licensed under the GNU Library General Public License, version 2.") == ["LGPL-2.0"]
    assert named("Licensed under the GNU General Public License, version 9.") == []
    assert named("Licensed under the Apache License, Version 1.1.") == ["Apache-1.1"]
    for kind in ("BY", "BY-ND", "BY-NC-ND", "BY-NC-SA", "BY-NC", "BY-SA"):
        assert named(f"Licensed under CC {kind} 4.0.") == [f"CC-{kind}-4.0"] and named(f"licensed under cc {kind.lower()} 3.0") == [f"CC-{kind}-3.0"]
    assert named(whole["BSD"][0]) == ["BSD"]
    assert named(whole["BSD-2-Clause"][0]) == ["BSD-2-Clause"]
    assert named("x " + whole["BSD-3-Clause"][0].replace("the copyright holder", "Some Company, Inc.") + " y") == ["BSD-3-Clause"]
    assert named("You may not claim all rights reserved by others") == []
    assert named("(c) 2020 A. Person. All rights reserved.") == named("2020 A Person All rights reserved\nmore") == ["all-rights-reserved"]
    for name, texts in whole.items():
        for text in texts:
            assert named("before. " + text + " After.") == [name]


def test_many_licence_notices_take_linear_time():
    import time

    known = licenses.Templates(licenses.TEMPLATES, 0.8)
    for text in ("Released under the MIT License. ", "All rights reserved. ", licenses.TEMPLATES["BSD-3-Clause"][0] + " "):
        took = []
        for n in (2, 16):
            began = time.process_time()
            known.find(text * (n * 20_000 // len(text)))
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 1.0


def test_license_lines_of_documents(spark):
    found = {(r["doc_id"], r["license"]) for r in queries.op4_licenses(spark, "/root/testdata/sf0.01").collect()}
    lines = {"All rights reserved.": "all-rights-reserved", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    docs = given_at(spark, "/root/testdata/sf0.01")
    assert found == {(d["doc_id"], name) for d in docs for line, name in lines.items() if line in (d["text"] or "").split("\n")}


def given_at(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_pipeline_stages(spark, tmp_path):
    """Each stage against its plain version, on the rows that the stage before left."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "12 !!", "en", "s", 5), (None, "a word", None, None, 6)], docs.schema)
    docs = docs.unionByName(extra)
    rows = [r.asDict() for r in docs.collect()]
    one = stages["language"](spark, docs, SF)
    assert one.columns == corpus_pipeline.COLUMNS
    kept = [r.asDict() for r in one.collect()]
    want = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    two = [r.asDict() for r in stages["lines"](spark, one, SF).collect()]
    assert len(two) == len(kept)
    drops = {d: n for d, n in zip([r["doc_id"] for r in kept], brute.lines(kept, 10), strict=True)}
    assert sum(n for _, n, _ in drops.values()) == sum((a["text"].count("\n")) for a in kept) - sum(b["text"].count("\n") for b in two) - sum(
        1 for b in two if b["text"] == "" and drops[b["doc_id"]][1] == drops[b["doc_id"]][0]) * -1
    assert all(r["n_chars"] == len(r["text"]) for r in two)
    before = spark.createDataFrame(two, docs.schema)
    three = [r.asDict() for r in stages["near_duplicates"](spark, before, SF).collect()]
    groups = brute.near(two, 5)
    assert sorted(str(r["doc_id"]) for r in three) == sorted(str(r["doc_id"]) for r, (_, c) in zip(two, groups, strict=True) if c is None or c == r["doc_id"])
    four = [r.asDict() for r in stages["decontaminate"](spark, spark.createDataFrame(three, docs.schema), SF).collect()]
    hits = {d for d, *_ in contained(three, given(spark, "benchmark"))}
    assert sorted(str(r["doc_id"]) for r in four) == sorted(str(r["doc_id"]) for r in three if r["doc_id"] not in hits)
    packed = stages["pack"](spark, spark.createDataFrame(four, docs.schema), SF).collect()
    check_packing(four, packed)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert set(langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).columns) >= {"held_out", "lang_pred", "score"}
    assert out.where(F.col("length") > 2048).count() == 0
