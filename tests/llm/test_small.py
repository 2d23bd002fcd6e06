"""Operators against plain versions: given tables, and rows with everything odd in them."""

import functools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.llm import components, cuckoo, langid, linededup, minhash, neardup, packing, queries, sharding, suffixes, topk, warc

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, n long, _h long, _key string, score double, n_lines long"


def odd_rows():
    """Nulls, empties, white space, repeats, ties, near copies, a very long text and a hot source."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeß") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(120)]
    texts = [None, "", " \t\n", "one", "one", "one two three", "A b\nC d", "a B\nc d", "\n\n", "é x", "1234 !!", "x" * 5000, "ab" * 900]
    for i in range(30):
        own = list(base)
        for _ in range(i % 8):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [texts[20]] * 12 + ["\n".join(["Shared line " * 3, word(), "  shared LINE " * 3]) for _ in range(14)]
    texts.append(" ".join(word() for _ in range(9000)))
    rows = [(i, t, "en" if i % 3 else None, "hot" if i % 3 else None, len(t or ""), 7, 7, 7, "k", 0.5, 3) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[21], (None, texts[20], "en", "a", None, None, None, None, None, None, None), (None, None, None, None, None, 1, 1, 1, "", 0.0, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def given(spark, table="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()]


def check_shards(rows, out, n=16):
    assert Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows) == Counter(
        (r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    if out:
        sizes = [len(by[s]) for s in range(n)]
        assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n))


def test_sharding(spark, odd, empty):
    check_shards(given(spark), queries.op1_sharding(spark, SF).collect())
    check_shards([r.asDict() for r in odd.collect()], sharding.interleave(odd).collect())
    assert sharding.interleave(empty).collect() == []


def test_shards_have_the_mixture(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    out = sharding.interleave(docs).join(docs, "doc_id")
    share = Counter((r["shard"], r["source"]) for r in out.collect())
    total = Counter(r["source"] for r in docs.collect())
    assert all(abs(share[s, k] - n / 16) <= 2 for s in range(16) for k, n in total.items())


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, odd, empty, words):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [r.asDict() for r in docs.collect()]
        # rows with one id are one document
        want = sorted(((r["doc_id"], *x) for r, x in zip(rows, brute.near(rows, words), strict=True)), key=str)
        for how in ({}, {"small": 1, "block": 4, "broadcast_rows": 0}):
            out = neardup.groups(docs, words=words, **how).collect()
            assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == want
            assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["component_id"] is None) for r in out)
    assert neardup.groups(empty).collect() == []


def test_near_duplicates_of_any_ids(spark, odd):
    """Ids of 2**62 and above, negative ones, none, and one id with several texts."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(2**62 + 5, text), (2**62 + 6, text), (-(2**63), text + " x"), (2**63 - 1, "alone here"), (None, text), (None, "no one else"), (None, "no one else"), (2**63 - 1, "other text of one id"),
            (7, "alone here"), (8, None), (9, "")]
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()), key=str)
    least = -(2**63)
    want = [(2**62 + 5, 27, least, False), (2**62 + 6, 27, least, False), (least, 28, least, True), (2**63 - 1, 1, 7, False), (None, 27, least, False), (None, 1, None, True), (None, 1, None, True),
            (2**63 - 1, 2, 7, False), (7, 1, 7, True), (8, 0, 8, True), (9, 0, 9, True)]
    assert out == sorted(want, key=str)
    far = 2**63 - 200
    all_of = lambda docs, less: sorted((tuple(None if x is None else x - less if isinstance(x, int) and not isinstance(x, bool) and i != 1 else x for i, x in enumerate(r))
                                        for r in neardup.groups(docs, words=4).collect()), key=str)
    assert all_of(odd.withColumn("doc_id", F.col("doc_id") + far), far) == all_of(odd, 0)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(edges)
    want = dict(components.forest(edges))
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r["node"]: r["component"] for r in got} == want


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (20, 300, 3000):
        x = rng.integers(0, 2**64, 3 * n, dtype=np.uint64)
        a, b = np.sort(x[: 2 * n]), np.sort(x[n:])
        sig = minhash.super_minhash([a, b], 256)
        assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.12
        assert np.array_equal(minhash.super_minhash([a[::-1]], 256)[0], sig[0])


def test_line_dedup(spark, odd, empty):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [r.asDict() for r in docs.collect()]
        for least in (1, 8):
            want = sorted(zip([r["doc_id"] for r in rows], brute.lines(rows, 5, least), strict=True), key=str)
            index = linededup.LineIndex.create(docs, 5, least)
            for bound, indexed in ((10**6, True), (10**6, False), (0, True)):
                out = index.clean(docs, bound, indexed).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text_kept").cast("binary"), 256).alias("s")).collect()
                assert sorted(((r["doc_id"], (r["n_lines"], r["n_dropped"], r["s"])) for r in out), key=str) == want
    assert linededup.dedup_lines(empty).collect() == []


def test_line_index_is_reversible(spark, odd):
    part = odd.where("doc_id % 2 = 0 or doc_id is null")
    rest = odd.subtract(part).where("doc_id % 2 = 1")
    first = linededup.LineIndex.create(part, 3)
    first.filters()
    back = first.insert(rest).delete(rest)
    rows = lambda x: sorted(map(tuple, x.counts.collect()))
    assert rows(first) == rows(back)
    clean = lambda x: sorted(((r["doc_id"], r["text_kept"]) for r in x.clean(odd).collect()), key=str)
    assert clean(first) == clean(back)


def test_line_filters_of_many_shards_decide(spark, odd, monkeypatch):
    """Small shards are kept through insertions and deletions; what no filter holds stays, what one mistakes is confirmed."""
    part = odd.where("doc_id % 2 = 0 or doc_id is null")
    rest = odd.subtract(part).where("doc_id % 2 = 1")
    whole = linededup.LineIndex.create(part, 3, shard_keys=2)
    after = whole.insert(rest)
    assert after.shards > 1 and after.shard_keys == 2
    again = after.delete(rest)
    rows = lambda x, **how: sorted(((r["doc_id"], r["text_kept"]) for r in x.clean(odd, **how).collect()), key=str)
    want = rows(whole, broadcast_keys=0)
    assert rows(whole) == rows(again) == want
    # nothing is dropped without the filters' word
    bare = linededup.LineIndex.create(part, 3)
    bare._filters = bare.filters().where("false")
    assert all(r["n_dropped"] == 0 for r in bare.clean(odd).collect())
    # keys that a filter mistakes are put right by the exact table, whether filters go out or meet keys by shard
    loose = linededup.LineIndex.create(part, 3)
    others = loose.counts.where("n < 3").select("k1", "k2").toPandas()
    full = cuckoo.build(*np.concatenate([np.array(loose.frequent.collect(), dtype=np.int64), others.to_numpy()]).T)
    loose._filters = spark.createDataFrame([(0, bytearray(full.to_bytes()))], "shard int, data binary")
    for most in (10**6, 0):
        monkeypatch.setattr(linededup, "FILTER_KEYS", most)
        assert loose.exceptions().count() == len(others) > 0
    assert rows(loose, indexed=False) == want


def test_line_batches_give_one_result(spark, odd):
    rows = lambda n: sorted(((r["doc_id"], r["text_kept"]) for r in linededup.dedup_lines(odd, 3, batches=n).collect()), key=str)
    assert rows(1) == rows(2) == rows(5)


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    k = rng.integers(0, 2**64, (2, 3000), dtype=np.uint64)
    made = cuckoo.build(*k[:, :2000])
    assert made.contains(*k[:, :2000]).all() and made.contains(*k[:, 2000:]).mean() < 0.01
    made.delete(*k[:, :1000])
    assert made.contains(*k[:, 1000:2000]).all() and made.contains(*k[:, :1000]).mean() < 0.01
    assert cuckoo.CuckooFilter.from_bytes(made.to_bytes()).contains(*k[:, 1000:2000]).all()


def test_language_accuracy(spark, odd, empty):
    out = {r["doc_id"]: r for r in queries.op6_language_id(spark, "/root/testdata/sf0.01").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [d for d, r in out.items() if r["held_out"]]
    assert all(out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in out)
    assert np.mean([out[d]["lang_pred"] == lang[d] for d in held]) > 0.97
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert all((r["lang_pred"] == "und") == (not letters(r["text"])) for r in rows)
    assert langid.identify(empty).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_languages(rows, dims=1024):
    """Profiles by the definition: a gram is the product of its letters' vectors, rolled by their place; documents add unit vectors."""
    full = (1 << 64) - 1

    def spread(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & full
        return x ^ x >> 31

    @functools.cache
    def letter(code):
        bits = "".join(format(byte, "08b") for i in range(dims // 64) for byte in spread((spread((i + (code << 16)) & full) + langid.SEED) & full).to_bytes(8, "little"))
        return np.array([1 if b == "1" else -1 for b in bits])

    def profile(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        line = " " + " ".join(words) + " "
        code = lambda c: 0 if c == " " else ord(c)
        out = np.zeros(dims)
        for a, b, c in zip(line, line[1:], line[2:]) if words else ():
            out += np.roll(letter(code(a)), 2) * np.roll(letter(code(b)), 1) * letter(code(c))
        return out

    profiles = [profile(r["text"]) for r in rows]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    sums = defaultdict(lambda: np.zeros(dims))
    for r, p in zip(rows, profiles, strict=True):
        if r["lang"] is not None and r["text"] is not None and (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5):
            sums[r["lang"]] += unit(p)
    out = []
    for p in profiles:
        cos = {k: float(unit(p) @ unit(v)) for k, v in sorted(sums.items())}
        out.append(max(cos.items(), key=lambda x: x[1]) if p.any() else ("und", 0.0))
    return out


def test_languages_by_definition(spark, odd):
    for docs in (odd.where("doc_id < 60 or doc_id is null"), spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")):
        rows = [r.asDict() for r in docs.collect()]
        got = langid.identify(docs).select("doc_id", "text", "lang_pred", "score").collect()
        key = lambda x: (str(x[0]), str(x[1]))
        want = sorted(((r["doc_id"], r["text"], *x) for r, x in zip(rows, plain_languages(rows), strict=True)), key=key)
        for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
            assert a[:3] == b[:3] and abs(a[3] - max(b[3], 0.0)) < 1e-4


def check_packing(rows, out, most=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), most)):
            own = np.array(ids[at : at + most], dtype="<u4")
            want[r["doc_id"], i, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    least = -(-sum(r["length"] for r in out) // most)
    return len(by), least


def test_packing(spark, odd, empty):
    bins, least = check_packing(given(spark), queries.op7_packing(spark, SF).collect())
    assert bins <= least * 1.02 + 1
    check_packing([r.asDict() for r in odd.collect()], packing.pack(odd, queries.tokenizer_path()).collect())
    assert packing.pack(empty, queries.tokenizer_path()).collect() == []


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_plan_keeps_every_capacity(by):
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 100) for _ in range(3000))
    rows, bins = packing.plan(histogram, tokens=100, docs=4, cost=6000 + 4000, by=by)
    held = defaultdict(list)
    seen = Counter()
    for length, first, count, bin_, offset in rows:
        assert first == seen[length]
        seen[length] += count
        for b in range(bin_, bin_ + count):
            assert sum(held[b]) == offset
            held[b].append(length)
    assert seen == histogram and set(held) == set(range(bins))
    assert all(sum(x) <= 100 and len(x) <= 4 and sum(y * y for y in x) <= 10000 for x in held.values())


def filled(rows):
    held = defaultdict(list)
    for length, _, count, bin_, _ in rows:
        for b in range(bin_, bin_ + count):
            held[b].append(length)
    return held


def test_capacities_choose_bins_at_no_cost():
    """Documents and attention cost limit bins and choose among them, and the count of bins stays that of tokens alone."""
    rng = random.Random(2)
    histogram = Counter(rng.choice([rng.randint(1, 12), rng.randint(20, 90)]) for _ in range(4000))
    alone, free = packing.plan(histogram, 100, 100, 10_000, weights=(1.0, 0.0, 0.0))
    rows, bins, caps = packing.fewest(histogram, 100)
    assert bins <= free and caps["docs"] < 100 and caps["cost"] <= 10_000
    held, loose = filled(rows), filled(alone)
    assert max(map(len, held.values())) <= caps["docs"] < max(map(len, loose.values()))
    assert all(sum(x * x for x in own) <= caps["cost"] for own in held.values())
    # no residual decides alone: with one of the three other bins are chosen
    caps = {"docs": caps["docs"], "cost": caps["cost"]}
    base = packing.plan(histogram, 100, **caps)[0]
    for weights in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)):
        assert packing.plan(histogram, 100, **caps, weights=weights)[0] != base
    assert packing.plan(histogram, 100, **caps, by="dot")[0] != base
    assert packing.fewest({}, 100)[1] == 0 and packing.fewest({100: 7}, 100)[1] == 7
    short, n, caps = packing.fewest(Counter({3: 50, 20: 400}), 100)
    assert n == packing.plan(Counter({3: 50, 20: 400}), 100, 100, 10_000)[1] and caps["cost"] < 10_000


def test_warc(spark, tmp_path):
    pages = given(spark, "pages")
    out = queries.op9_warc(spark, SF).collect()
    assert sorted(map(tuple, out)) == sorted(brute.warc(pages), key=lambda r: r[0])
    odd = [(1, "http://a/ b\r\nX: y", "<p>é</p>", "x"), (2, None, None, "x"), (3, "u", "", None), (9, "u", "<p>é</p>", "x"), (9, "u", "<p>é</p>", "x"),
           (None, "v", "q", "x"), (None, "v", "q", "x"), (None, "v", "", "x"), (12, "w", "z" * 300_000, "x")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string, file string").repartition(3)
    path = f"file://{tmp_path}/w"
    index = warc.write_archive(df, path)
    got = warc.read_archive(index, path, span=1000).collect()
    assert sorted(map(str, warc.read_archive(index, path, held_bytes=1).collect())) == sorted(map(str, got))
    want = brute.warc([{"page_id": a, "html": c} for a, _, c, _ in odd])
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert [bytes(r["payload"]) for r in got if r["page_id"] == 12] == [b"z" * 300_000]
    some = warc.read_archive(index.where("page_id = 3"), path).collect()
    assert [r["page_id"] for r in some] == [3]
    assert warc.read_archive(warc.write_archive(df.limit(0), f"{path}0"), f"{path}0").collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], i) for i in range(90)]
    rows += [(200 + i, rows[5][1], 1) for i in range(40)] + [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1),
             (304, [1.0, 2.0], 1), (320, [], 1), (None, [1.0] * 6, 1), (20, rows[20][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long").repartition(5)
    ok = [(i, np.floor(64 * np.array([np.float32(x) for x in v] + [0] * (6 - len(v)), dtype=np.float64))) for i, v, _ in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for how in ({"block": 2, "candidates": 16}, {"block": 3, "query_block": 3}, {"query_block": 2, "row_block": 25, "candidates": 7}):
        got = defaultdict(list)
        for r in topk.top_k(df, k=7, **how).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((-r["score"], r["vec_id"]))
        queries_ = dict(x for x in ok if x[0] % 20 == 0)
        assert set(got) == set(queries_)
        for q, v in queries_.items():
            assert got[q] == sorted((-int(v @ w), i) for i, w in ok if i != q)[:7]
    assert topk.top_k(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [2.0e5, 3.0e7, 1.0e12, 1.0e40, 1.0e200])
def test_top_k_of_large_components(spark, size):
    """Sums beyond 2**53 rank as whole numbers; beyond 2**63 the score ends at a long's limits."""
    rng = np.random.default_rng(7)
    x = rng.choice([-1.0, 1.0], (70, 12)) * size + rng.integers(0, 3, (70, 12))
    x[11] = x[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [1.7e308] * 12)], "vec_id long, embedding array<double>").repartition(3)
    whole = [[math.floor(64 * v) for v in r] for r in x.tolist()]
    got = defaultdict(list)
    for r in topk.top_k(df, k=5, row_block=20, block=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == {0, 20, 40, 60}
    for q in got:
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q)[:5]
        assert got[q] == [(max(min(-s, 2**63 - 1), -(2**63)), i) for s, i in best]


def test_archives_are_read_by_as_many_tasks_as_bytes_ask_for(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                    F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.sha2(F.concat("id", i).cast("string"), 256)), "").alias("html"))
    path = f"file://{tmp_path}/w"
    index = warc.write_archive(pages.repartition(3), path, file_bytes=1 << 20, broadcast_rows=0)
    got = warc.read_archive(index.coalesce(1), path, span=1 << 19)
    assert got.rdd.getNumPartitions() >= 5
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got.collect()) == sorted(map(tuple, pages.select("page_id", "html").collect()))


def passages(seed):
    """Texts that share passages around the threshold's length, at every kind of edge, and periodic ones."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    long = noise(1500)
    texts = [None, "", noise(399), "y" * 1500, "xy" * 700, long, long, "y" * 401]
    for n in (398, 399, 400, 401, 420, 700):
        at = rng.randrange(0, 1500 - n)
        texts.append(noise(rng.choice([0, 3, 300])) + long[at : at + n] + noise(rng.choice([0, 5, 500])))
    text = noise(900)
    texts.append(text[:600] + noise(50) + text[:450] + noise(9) + text[200:700])
    for _ in range(12):
        own = bytearray(text.encode("ascii", "replace"))
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = ord("z")
        texts.append(own.decode()[rng.randrange(200) :])
    texts += [noise(40) + long[100:560] + noise(60) for _ in range(30)] + [texts[-1]] * 4
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    rows = [(i if i % 9 else None, t, 1) for i, t in enumerate(passages(seed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long").repartition(3)
    want = sorted(((a, *x) for (a, _, _), x in zip(rows, brute.repeats([{"text": t} for _, t, _ in rows]), strict=True)), key=str)
    for bound in (10**6, 0):
        out = suffixes.dedup_passages(docs, bound=bound).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert sorted(map(tuple, out.collect()), key=str) == want


def test_passages_of_documents(spark, odd, empty):
    rows = given(spark)
    want = sorted((r["doc_id"], *x) for r, x in zip(rows, brute.repeats(rows), strict=True))
    assert sorted(map(tuple, queries.op5_suffix_dedup(spark, SF).collect())) == want
    rows = [r.asDict() for r in odd.collect()]
    out = suffixes.dedup_passages(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(((r["doc_id"], *x) for r, x in zip(rows, brute.repeats(rows), strict=True)), key=str)
    assert suffixes.dedup_passages(empty).collect() == []
