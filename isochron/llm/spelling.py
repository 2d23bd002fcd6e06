"""Spelling variants: words that differ by one character, found in a trie of letter counts."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, remove, small_batches

#: Letter groups in the order of the trie's levels; all other characters go by code point to one of five more.
GROUPS = ("e", "a", "t", "i", "n", "o", "r", "s", "l", "h", "du", "cm", "gpb", "fwyv", "kjqxz")
OTHERS = 5
WIDTH = len(GROUPS) + OTHERS
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
#: Rows of a search frontier that are held at once, and words of a leaf that are compared one by one.
FRONTIER, LEAF = 1 << 16, 64
#: Levels of the trie that a round of joins goes down.
STEP = 3
#: Nodes that go out to all tasks.
SENT_NODES = 100_000


def runs_of(text: str, least: int, piece: int = 1 << 20) -> Iterator[list[str]]:
    """The maximal runs of ``least`` letters or more, A-Z in lower case, a piece of the text at a time."""
    letters = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + piece) if len(text) - at > piece else None
        end = gap.start() if gap else len(text)
        yield letters.findall(text[at:end].encode().lower().decode())  # bytes have only ASCII letters lowered
        at = end


def add_runs(held: dict[str, int], key: str, text: str, least: int, every: int) -> None:
    """Add a document's runs to the counts; each whose hash with the key is divisible by ``every`` loses a character.

    What loses a character gets shorter, so runs of fewer than ``least`` letters need no look.
    """
    start, runs = zlib.crc32(f"{key}:".encode()), Counter()
    for some in runs_of(text, least):
        runs.update(some)
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < least:
                continue
        held[run] = held.get(run, 0) + n


def word_counts(docs: DataFrame, key: str = "doc_id", every: int = 97, least_chars: int = 5, least: int = 3, flush: int = 200_000) -> DataFrame:
    """(word, n): all words of ``least_chars`` characters or more that occur ``least`` times or more.

    A task adds its documents up first, so that a word that stands everywhere reaches
    the shuffle a few times per task; it holds about ``flush`` words at once.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[str, int] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for part in parts:
            for doc, text in zip(part["key"].to_pylist(), part["text"].to_pylist(), strict=True):
                add_runs(held, doc, text or "", least_chars, every)
                if len(held) >= flush:
                    yield flushed()
        if held:
            yield flushed()

    small_batches(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), "text")
    return keyed.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def group_of() -> np.ndarray:
    """The letter group of each code point below 256."""
    table = len(GROUPS) + np.arange(256) % OTHERS
    for g, letters in enumerate(GROUPS):
        table[[ord(c) for c in letters]] = g
    return table


def count_vector(word: Column) -> Column:
    """The trie's path of a word: its length, then its characters of each group."""
    table = group_of()
    letters = ["".join(chr(i) for i in range(256) if table[i] == g and (97 <= i < 123 or i >= 0xC0)) for g in range(WIDTH)]
    return F.array(F.length(word), *(F.length(word) - F.length(F.translate(word, x, "")) for x in letters))


def _pack(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words one after another (a byte each), and where each begins."""
    ends = np.cumsum([0, *map(len, words)], dtype=np.int64)
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), ends


def vectors(words: list[str]) -> np.ndarray:
    """Characters of each group, a row a word."""
    buf, ends = _pack(words)
    at = np.repeat(np.arange(len(words)), np.diff(ends)) * WIDTH + group_of()[buf]
    return np.bincount(at, minlength=len(words) * WIDTH).reshape(-1, WIDTH)


class CountTrie:
    """Words below some nodes, arranged by successive group counts.

    A node of a level is known by its number among the level's nodes in the order of their
    paths; ``keys`` of a level are (parent, count) pairs as sorted integers.
    """

    BASE = 1 << 31

    def __init__(self, words: list[str], nodes: np.ndarray):
        table = np.column_stack([nodes, vectors(words)])
        order = np.lexsort(table.T[::-1])
        table = table[order]
        self.words = [words[i] for i in order]
        self.packed = _pack(self.words)
        self.keys: list[np.ndarray] = []
        parent = np.zeros(len(words), np.int64)
        for level in range(WIDTH + 1):
            key = parent * self.BASE + table[:, level]
            new = np.append(True, key[1:] != key[:-1])
            self.keys.append(key[new])
            parent = np.cumsum(new) - 1
        self.leaf = np.append(np.flatnonzero(new), len(words))
        self.found: dict[int, dict] = {}

    def child(self, level: int, parent: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of (parent, count) are nodes of a level, and their numbers."""
        key = parent * self.BASE + count
        at = np.minimum(np.searchsorted(self.keys[level], key), len(self.keys[level]) - 1)
        return (self.keys[level][at] == key) & (count >= 0), at

    def search(self, words: list[str], nodes: np.ndarray, longer: np.ndarray) -> Iterator[tuple[int, int]]:
        """(query, word) pairs that are near, by depth-first search below each query's node.

        ``longer``: the word sought has one character more, else as many.  The budget, one
        surplus and for words of one length one deficit, is spent on the way: a surplus is
        one character more in a group than the query has, a deficit one less.  Of two words
        of one length, the one with the first surplus is found from the other, so the surplus
        is spent before the deficit.
        """
        v, packed = vectors(words), _pack(words)
        known, root = self.child(0, np.zeros(len(nodes), np.int64), nodes)
        q = np.flatnonzero(known)
        stack = [(0, q, root[q], np.ones(len(q), np.int64), np.where(longer[q], 0, 1))]
        while stack:
            level, q, node, s, d = stack.pop()
            for lo in range(FRONTIER, len(q), FRONTIER):  # the rest waits
                part = slice(lo, lo + FRONTIER)
                stack.append((level, q[part], node[part], s[part], d[part]))
            q, node, s, d = q[:FRONTIER], node[:FRONTIER], s[:FRONTIER], d[:FRONTIER]
            if level == WIDTH:
                done = (s == d) & ~(longer[q] & (s > 0))
                yield from self.verified(words, packed, q[done], node[done], longer, s[done] > 0)
                continue
            own, parts = v[q, level], []
            for step, may in ((0, None), (1, s > 0), (-1, (s == 0) & (d > 0))):
                at = np.arange(len(q)) if may is None else np.flatnonzero(may)
                hit, child = self.child(level + 1, node[at], own[at] + step)
                at, child = at[hit], child[hit]
                parts.append((q[at], child, s[at] - (step > 0), d[at] - (step < 0)))
            found = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            if len(found[0]):
                stack.append((level + 1, *found))

    def verified(self, words: list[str], packed: tuple[np.ndarray, np.ndarray], q: np.ndarray, leaf: np.ndarray, longer: np.ndarray, unspent: np.ndarray) -> Iterator[tuple[int, int]]:
        """The pairs among queries and words of their leaves that differ by one character; an unspent budget takes only words after the query's."""
        size = self.leaf[leaf + 1] - self.leaf[leaf]
        for i in np.flatnonzero(size > LEAF).tolist():
            query, here = words[q[i]], self._erased(int(leaf[i]))
            holes = (query,) if longer[q[i]] else {query[:j] + "\0" + query[j + 1 :] for j in range(len(query))}
            met = {w for hole in holes for w in here[bool(longer[q[i]])].get(hole, ())}
            yield from ((int(q[i]), w) for w in met if self.words[w] != query and (not unspent[i] or self.words[w] > query))
        few = np.flatnonzero(size <= LEAF)
        rows = np.repeat(few, size[few])
        at = np.arange(len(rows)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + self.leaf[leaf[rows]]
        near = one_apart(packed, q[rows], self.packed, at, longer[q[rows]])
        for i, a, b in zip(rows[near].tolist(), q[rows[near]].tolist(), at[near].tolist(), strict=True):
            if not unspent[i] or self.words[b] > words[a]:
                yield a, b

    def _erased(self, leaf: int) -> tuple[dict, dict]:
        """Words of a large leaf by what is left if a character is replaced by a mark, and if it is taken out."""
        if leaf not in self.found:
            self.found.clear()
            marked: dict[str, list[int]] = {}
            without: dict[str, list[int]] = {}
            for w in range(int(self.leaf[leaf]), int(self.leaf[leaf + 1])):
                x = self.words[w]
                for j in range(len(x)):
                    marked.setdefault(x[:j] + "\0" + x[j + 1 :], []).append(w)
                    without.setdefault(x[:j] + x[j + 1 :], []).append(w)
            self.found[leaf] = marked, without
        return self.found[leaf]


def one_apart(a: tuple[np.ndarray, np.ndarray], i: np.ndarray, b: tuple[np.ndarray, np.ndarray], j: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For pairs a[i], b[j] of packed words, where b is longer by one or as long: whether one character is the whole difference."""
    (abuf, aend), (bbuf, bend) = a, b
    out, length = np.zeros(len(i), bool), np.diff(aend)[i]
    for n in np.unique(length).tolist():
        of = np.flatnonzero(length == n)
        for lo in range(0, len(of), max(1, (1 << 22) // max(1, n))):
            at = of[lo : lo + max(1, (1 << 22) // max(1, n))]
            x = abuf[aend[i[at]][:, None] + np.arange(n)]
            y = bbuf[bend[j[at]][:, None] + np.arange(n)]
            more, differs = longer[at], x != y
            out[at[~more]] = differs[~more].sum(axis=1) == 1
            at, x, differs = at[more], x[more], differs[more]
            shifted = x != bbuf[bend[j[at]][:, None] + 1 + np.arange(n)]
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), n)
            last = np.where(shifted.any(axis=1), n - 1 - shifted[:, ::-1].argmax(axis=1), -1)
            out[at] = last < first
    return out


def near_pairs(words: DataFrame, most: int | None = None, sent_nodes: int = SENT_NODES, made: list[DataFrame] | None = None) -> DataFrame:
    """(a, na, b, nb): each unordered pair of words one character apart, once.

    The trie is dealt to tasks by its nodes: from the root down, a node with at most ``most``
    words below it is cut off with all of them, others are followed ``STEP`` levels further;
    leaves are cut off whatever they hold.  Queries go down with their budget and reach the
    cut nodes that they may have near words in; each task searches below its nodes.
    Default for ``most``: half of a shuffle partition's share, 20,000 at the most.  The
    tables that the pairs are read from are added to ``made``.
    """
    made = [] if made is None else made
    tasks, total = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count()
    most = most or int(np.clip(total // (2 * tasks), 256, 20_000))
    index = words.select("word", "n", count_vector(F.col("word")).alias("v"))
    budget = lambda longer: F.struct(F.lit(longer).alias("longer"), F.lit(1).alias("s"), F.lit(0 if longer else 1).alias("d"))
    queries = index.select("word", "n", "v", F.explode(F.array(budget(True), budget(False))).alias("_b"))
    queries = queries.select("word", "n", "v", "_b.*", F.array(F.col("v")[0] + F.col("_b.longer").cast("int")).alias("node"))
    depth, cut_words, cut_queries = 1, [], []
    while True:
        for level in range(depth, min(depth + STEP, WIDTH + 1)):
            queries = _down(queries, level)
        depth = min(depth + STEP, WIDTH + 1)
        index = index.withColumn("node", F.slice("v", 1, depth))
        nodes = materialize(index.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "trie-nodes")
        sent = F.broadcast(nodes) if nodes.count() <= sent_nodes else nodes
        here, met = materialize(index.join(sent, "node"), "trie-words"), materialize(queries.join(sent, "node"), "trie-queries")
        made += [nodes, here, met]
        done = F.lit(True) if depth == WIDTH + 1 else F.col("size") <= most
        cut_words.append(here.where(done).select("node", "word", "n"))
        cut_queries.append(met.where(done).select("node", "word", "n", "longer"))
        index, queries = here.where(~done).select("word", "n", "v"), met.where(~done).drop("size")
        if index.isEmpty():
            break
    return _searched(functools.reduce(DataFrame.unionByName, cut_words), functools.reduce(DataFrame.unionByName, cut_queries), tasks, most, made)


def _down(queries: DataFrame, level: int) -> DataFrame:
    """Queries one level further: as many characters of the group, one more, or one less where that is left."""
    own, s, d = F.col("v")[level], F.col("s"), F.col("d")
    step = lambda k, s, d: F.struct((own + k).alias("_k"), s.cast("int").alias("s"), d.cast("int").alias("d"))
    options = F.concat(F.array(step(0, s, d)), F.when(s > 0, F.array(step(1, s - 1, d))).otherwise(F.array().cast("array<struct<_k:int,s:int,d:int>>")),
                       F.when((s == 0) & (d > 0) & (own > 0), F.array(step(-1, s, d - 1))).otherwise(F.array().cast("array<struct<_k:int,s:int,d:int>>")))
    return (queries.select("word", "n", "v", "longer", "node", F.explode(options).alias("_o"))
            .select("word", "n", "v", "longer", "_o.s", "_o.d", F.concat("node", F.array("_o._k")).alias("node")))


def _searched(words: DataFrame, queries: DataFrame, tasks: int, most: int, made: list[DataFrame]) -> DataFrame:
    """Near pairs below cut nodes, by tasks that hold some nodes' words and at most so many queries to each node at a time."""
    load = materialize(queries.groupBy("node").agg(F.count(F.lit(1)).alias("asked")), "trie-load")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("asked") / (8 * most))).cast("int")
    made.append(load)
    load = load.select("node", pieces.alias("pieces"))
    total = words.count()
    shards = max(tasks, -(-total // (2 * most)))
    shard = F.pmod(F.xxhash64("node", "_piece"), F.lit(shards)).cast("int").alias("shard")
    held = words.join(load, "node").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    asking = queries.join(load, "node").withColumn("_piece", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"))
    place = F.concat_ws(",", F.transform("node", lambda k: k.cast("string")), F.col("_piece").cast("string")).alias("node")

    def pairs(a: list, na: list, b: list, nb: list) -> pd.DataFrame:
        return pd.DataFrame({"a": np.array(a, object), "na": np.array(na, np.int64), "b": np.array(b, object), "nb": np.array(nb, np.int64)})

    def search(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        release()
        if not len(held) or not len(asking):
            return pairs([], [], [], [])
        names = pd.Index(held["node"].unique())
        trie = CountTrie(held["word"].tolist(), names.get_indexer(held["node"]))
        count = dict(zip(held["word"], held["n"].tolist(), strict=True))
        words, n = asking["word"].tolist(), asking["n"].tolist()
        found = list(trie.search(words, names.get_indexer(asking["node"]).astype(np.int64), asking["longer"].to_numpy()))
        near = [trie.words[b] for _, b in found]
        return pairs([words[a] for a, _ in found], [n[a] for a, _ in found], near, [count[w] for w in near])

    return (held.select(shard, place, "word", "n").groupBy("shard")
            .cogroup(asking.select(shard, place, "word", "n", "longer").groupBy("shard"))
            .applyInPandas(search, "a string, na long, b string, nb long"))


def variants(docs: DataFrame, key: str = "doc_id", every: int = 97, least_chars: int = 5, least: int = 3, ratio: int = 2, most: int | None = None, sent_nodes: int = SENT_NODES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of the texts.

    Runs of Latin letters (A-Z, a-z and U+00C0 to U+00FF) are taken from whole texts and A-Z
    lower-cased; of the runs of a document one in ``every`` loses a character, by a hash
    of document and run (a null id: the text null; a null text has no runs).  Words are
    results of ``least_chars`` characters or more that occur ``least`` times or more in
    all.  Words one inserted, deleted or replaced character apart are near.  A word's form is
    its most frequent near word (ties: the first in code point order) if that is at least
    ``ratio`` times (2 or more) as frequent, and its root the last of the chain of forms.
    Repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    words = materialize(word_counts(docs, key, every, least_chars, least), "words")
    made = [words]
    pairs = near_pairs(words, most, sent_nodes, made)
    both = F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col("n" + x).alias("n"), F.col(y).alias("near"), F.col("n" + y).alias("near_n")) for x, y in ("ab", "ba"))))
    best = F.min(F.struct((-F.col("near_n")).alias("_m"), F.col("near").alias("form")))
    found = pairs.select(both.alias("_p")).select("_p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_b"))
    strong = -F.col("_b._m") >= ratio * F.col("n")
    out = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("_b.form")).alias("form"), F.when(strong, -F.col("_b._m")).alias("form_n"))
    out = materialize(out, "forms")
    for table in made:
        remove(table)
    return out.join(roots(out), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form, by doubling: a word takes its pointer's pointer until that has no form.

    A form is at least twice as frequent as its word, so chains have at most 62 links.
    """
    left = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    ahead, done = left, None
    while True:
        step = left.join(ahead.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        step = materialize(step, "roots")
        ended = step.where(F.col("_next").isNull()).select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        left = step.where(F.col("_next").isNotNull()).select("word", F.col("_next").alias("root"))
        if left.isEmpty():
            return done
        ahead = done.unionByName(left)
