"""Host rules, fill-in-the-middle and spelling variants against plain versions, and rows with everything odd in them."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.llm import fim, quality, queries, spelling, wavelet

from .test_small import DOCS, SF, given, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def more_rows():
    texts = ["a<P>b", "x <S>", "The cat's 3 dogs\r\n ran.", "word " * 60, "same line here\n" * 40, "colour colours color " * 9, "naïve naive  Straße ÀÉ", "ab 😀 é!" * 30]
    return odd_rows() + [(1000 + i, t, "en", "few", len(t), 7, 7, 7, "k", 0.5, 3) for i, t in enumerate(texts * 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(more_rows(), DOCS).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len({i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}), len(lines))


def plain_rules(m):
    n, chars, symbols, dup, repeat, lines = m
    return [n < 50, 100 * repeat > 50 * n, 10 * symbols > n, 100 * dup > 30 * lines, chars < 3 * n or chars > 10 * n]


def plain_hosts(rows, host, limit):
    """Rejected hosts by the definition of the prior's moments."""
    bad = set()
    for rule in range(5):
        by = defaultdict(list)
        for r in rows:
            if r[host] is not None:
                by[r[host]].append(plain_rules(plain_measures(r["text"]))[rule])
        n = sum(map(len, by.values()))
        p = sum(map(sum, by.values())) / max(n, 1)
        spread = sum(len(x) * (sum(x) / len(x) - p) ** 2 for x in by.values())
        expected = p * (1 - p) * sum(1 - len(x) / n for x in by.values())
        room = p * (1 - p) * sum((len(x) - 1) * (1 - len(x) / n) for x in by.values())
        gamma = (spread - expected) / room if room > 1e-9 else 0
        strength = min(n, max(1, 1 / gamma - 1 if gamma > 1e-12 else n))
        bad |= {h for h, x in by.items() if sum(x) > limit * len(x) and (sum(x) + p * strength) / (len(x) + strength) > limit}
    return bad


@pytest.mark.parametrize("how", [{}, {"sent_hosts": 0, "salts": 3}, {"limit": 0.3}])
def test_host_rules(spark, odd, empty, how):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.length("text") < 500, "short").otherwise(F.col("source")))):
        rows = [r.asDict() for r in docs.collect()]
        bad = plain_hosts(rows, "source", how.get("limit", 0.5))
        want = []
        for r in rows:
            m = plain_measures(r["text"])
            base = any(plain_rules(m)[:2])
            want.append((r["doc_id"], *m, base, r["source"] in bad, not base and r["source"] not in bad))
        out = quality.host_quality(docs, **how)
        assert "text" not in out.columns
        assert sorted((tuple(r[c] for c in ("doc_id", *quality.RESULTS)) for r in out.collect()), key=str) == sorted(want, key=str)
    assert bad, "a host must be rejected here"
    assert quality.host_quality(empty, **how).collect() == []
    assert "text" in quality.host_quality(empty, keep_text=True, **how).columns


def test_beta_prior_is_the_one_that_drew():
    rng = np.random.default_rng(3)
    n = rng.integers(20, 400, 3000)
    f = rng.binomial(n, rng.beta(2.0, 8.0, 3000))
    p, strength = quality.beta_prior(3000, int(n.sum()), float((n * n).sum()), int(f.sum()), float((f * f / n).sum()))
    assert abs(p - 0.2) < 0.01 and 8 < strength < 12.5


def test_a_small_host_is_shrunk(spark):
    good, bad = "word%d other%d " * 40, "too short"
    rows = [(i, good % tuple(range(80)), f"h{i % 40}") for i in range(2000)] + [(5000 + i, bad, "tiny") for i in range(1)] + [(6000 + i, bad, "spam") for i in range(300)]
    rows += [(7000, good % tuple(range(80)), "spam"), (7001, good % tuple(range(80)), None)]
    kept = {r["doc_id"]: r for r in quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not kept[7000]["kept"] and kept[7000]["host_failed"] and not kept[7000]["base_failed"]
    assert kept[0]["kept"] and kept[7001]["kept"] and not kept[5000]["kept"]


def test_words_of_long_texts():
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "é", " ", "\n", "x"]) for _ in range(5000)).encode()
    for piece in (1, 7, 1 << 20):
        ids, known = quality.word_ids(text, piece)
        words = WORD.findall(text.decode())
        first = {}
        assert ids.tolist() == [first.setdefault(w, len(first)) for w in words] and known == len(first)


def test_hosts_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("host", quality.host_of(F.col("url"))).withColumnRenamed("html", "text")
    out = quality.host_quality(pages, host="host").collect()
    assert len(out) == pages.count() and all(r["host"] == re.match(r"https?://([^/]*)", r["url"])[1].lower() for r in out)


def plain_fim(doc_id, text):
    text = text or ""
    t = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(t), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd, empty):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        done = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
        out = done.collect()
        want = [plain_fim(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted((tuple(r[c] for c in ("doc_id", *fim.RESULTS)) for r in out), key=str) == sorted(want, key=str)
        assert all(r["back"] == (r["text"] or "") for r in out)
        assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty).collect() == []
    digests = {r["doc_id"]: r for r in queries.op12_fill_in_middle(spark, SF).collect()}
    for r in given(spark):
        assert digests[r["doc_id"]]["output_sha256"] == hashlib.sha256(plain_fim(r["doc_id"], r["text"])[-1].encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wavelet_ranks(n):
    seq = np.random.default_rng(n).integers(0, 5, n).astype(np.uint8)
    matrix, at = wavelet.WaveletMatrix(seq), np.arange(n + 1)
    for c in range(5):
        assert matrix.rank(c, at).tolist() == [int((seq[:i] == c).sum()) for i in range(n + 1)]


def plain_variants(rows):
    n = Counter()
    for r in rows:
        runs = Counter(re.findall("[A-Za-zÀ-ÿ]+", (r["text"] or "").translate({i: i + 32 for i in range(65, 91)})))
        for w, k in runs.items():
            h = zlib.crc32(f"{'null' if r['doc_id'] is None else r['doc_id']}:{w}".encode())
            if h % 97 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            n[w] += k
    return plain_forms({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})


@pytest.mark.parametrize("piece", [1, 3, 50, 1 << 20])
def test_runs_of_long_texts(piece):
    rng = random.Random(1)
    text = "".join(rng.choice("aBéÀ ñ÷zß1\n") for _ in range(4000)) + "Z" * 300
    want = [w for w in re.findall("[A-Za-zÀ-ÿ]+", text.translate({i: i + 32 for i in range(65, 91)})) if len(w) >= 5]
    assert [w for some in spelling.runs_of(text, 5, piece) for w in some] == want


def plain_near(words):
    """Pairs by what is left without one character."""
    holes, words_of = defaultdict(set), set(words)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (_, rest), met in holes.items():
        for w in met:
            near[w] |= met - {w}
            if rest in words_of:
                near[w].add(rest)
                near[rest].add(w)
    return near


def plain_forms(n):
    near, form = plain_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def same_variants(out, want):
    assert sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out.collect()) == want


@pytest.mark.parametrize("how", [{}, {"most": 5, "sent_nodes": 0}])
def test_spelling_variants(spark, odd, empty, how):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        same_variants(spelling.variants(docs, **how), plain_variants([r.asDict() for r in docs.collect()]))
    assert spelling.variants(empty, **how).collect() == []


def test_near_words_of_crowded_leaves(spark, monkeypatch):
    """Words of one letter multiset, of one group, with accents, very long ones, and chains of forms."""
    rng = random.Random(4)
    words = {"".join(x) for x in itertools.islice(itertools.permutations("kjqxzabc"), 0, 40320, 90)}
    words |= {"".join(rng.choice("kjqxz") for _ in range(6)) for _ in range(900)} | {"".join(rng.choice("éèêë") for _ in range(5)) for _ in range(300)}
    words |= {"y" * 3000, "y" * 3001, "y" * 1500 + "w" + "y" * 1499} | {"a" * i for i in range(5, 60)}
    n = {w: rng.randint(3, 400) for w in words} | {"a" * i: 3 * 2 ** (i - 5) for i in range(5, 60)}
    table = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    want = plain_near(n)
    for leaf, frontier, most in ((64, 1 << 16, None), (1, 5, 3)):
        # tasks import the module anew: what is set here must be set there, so the search is run here too
        monkeypatch.setattr(spelling, "LEAF", leaf)
        monkeypatch.setattr(spelling, "FRONTIER", frontier)
        order = sorted(words)
        trie = spelling.CountTrie(order, np.array([len(w) for w in order]))
        found = set()
        for longer in (False, True):
            nodes = np.array([len(w) + longer for w in order])
            found |= {(order[a], trie.words[b]) for a, b in trie.search(order, nodes, np.full(len(order), longer))}
        both = defaultdict(set)
        for a, b in found:
            assert a not in both[b], "a pair is found once"
            both[a].add(b)
            both[b].add(a)
        assert {w: both[w] for w in words} == {w: want[w] for w in words}
        pairs = Counter(frozenset((r["a"], r["b"])) for r in spelling.near_pairs(table, most).collect())
        assert set(pairs.values()) == {1} and set(pairs) == {frozenset((a, b)) for a in words for b in want[a]}
    forms = {w: f for w, f, *_ in plain_forms(n)}
    table = spark.createDataFrame([(w, f) for w, f in forms.items()], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(table).collect()} == {w: root for w, f, root, *_ in plain_forms(n) if f}
