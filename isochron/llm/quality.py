"""Quality rules of documents and of the hosts that they come from."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RESULTS = (*MEASURES, "base_failed", "host_failed", "kept")
#: Rules of a document; the first two alone condemn it, all count against its host.
BASE = ("short", "repetitive")
#: Rejected hosts, and bytes of their names, that go out to all tasks.
SENT_HOSTS, SENT_BYTES = 100_000, 8 << 20
_WHITE = b" \t\n\v\f\r"
_REST = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_GAP = re.compile(rb"[ \t\n\v\f\r]")


def rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


def word_ids(data: bytes, piece: int = 1 << 20) -> tuple[np.ndarray, int]:
    """A number for each word, equal for equal words, and how many there are; words are made a piece at a time."""
    known: dict[bytes, int] = {}
    parts, at = [np.empty(0, np.int64)], 0
    while at < len(data):
        gap = _GAP.search(data, at + piece)
        end = gap.start() if gap else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(parts), len(known)


def repeated_words(ids: np.ndarray, known: int) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 3:
        return 0
    pairs = np.unique(ids[:-1] * known + ids[1:], return_inverse=True)[1]
    windows, which, n = np.unique(pairs[:-1] * known + ids[2:], return_inverse=True, return_counts=True)
    if len(windows) == len(which):
        return 0
    repeats, covered = n[which] > 1, np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : len(ids) - 2 + i] |= repeats
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of one text in the order of ``MEASURES``."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    ids, known = word_ids(text)
    chars = len(text.translate(None, _WHITE + _REST))
    return len(ids), chars, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids, known), len(lines)


def measured(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs, without their texts unless they are to be kept, with the measures of each whole text."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*RESULTS)
    columns = [c for c in docs.columns if keep_text or c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in parts:
            found = np.array([measure(x or b"") for x in part["text"].cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), *map(pa.array, found.T)], [*columns, *MEASURES])

    return docs.mapInArrow(run, ", ".join([schema, *(f"{m} long" for m in MEASURES)]))


def host_rates(docs: DataFrame, host: str) -> DataFrame:
    """(host, n, and per rule its failures f_<rule> and shrunk rate r_<rule>) of measured rows with a host.

    A rule's failures in a host of n documents are taken for beta-binomial.  Mean and
    strength of the beta prior are those that the hosts' rates have by their moments, the
    strength held between 1 and the number of documents; the shrunk rate is the
    posterior mean.  One row of sums reaches the driver, whatever the number of hosts.
    """
    counts = docs.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(rule).alias(f"f_{name}") for name, rule in rules().items()))
    counts = materialize(counts, "host-counts")
    n = F.col("n").cast("double")
    sums = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"),
                      *(F.sum(f"f_{name}").alias(f"f_{name}") for name in rules()),
                      *(F.sum(F.col(f"f_{name}").cast("double") * F.col(f"f_{name}") / n).alias(f"ff_{name}") for name in rules())).first()
    for name in rules():
        p, strength = beta_prior(sums["k"], sums["n"] or 0, sums["nn"] or 0.0, sums[f"f_{name}"] or 0, sums[f"ff_{name}"] or 0.0)
        counts = counts.withColumn(f"r_{name}", (F.col(f"f_{name}") + F.lit(p * strength)) / (n + F.lit(strength)))
    return counts


def beta_prior(k: int, n: int, nn: float, f: int, ff: float) -> tuple[float, float]:
    """Mean and strength from k hosts: sums of their n, n**2, failures f, and f**2 / n.

    With the hosts weighted by n, the spread of their rates beyond that of draws
    with one rate gives gamma = 1 / (strength + 1).
    """
    if not n:
        return 0.0, 1.0
    p = f / n
    own = p * (1 - p)
    room = own * (n - nn / n - (k - 1))
    gamma = (ff - f * p - own * (k - 1)) / room if room > 0 else 0.0
    return p, 1.0 if gamma >= 0.5 else float(n) if gamma <= 1 / (n + 1) else 1 / gamma - 1


def rejected_hosts(rates: DataFrame, limit: float) -> DataFrame:
    """Hosts of which more than ``limit`` of the documents fail one rule, shrunk and as counted."""
    bad = F.lit(False)
    for name in rules():
        bad = bad | ((F.col(f"f_{name}") > limit * F.col("n")) & (F.col(f"r_{name}") > limit))
    return rates.where(bad).select("host")


def host_quality(docs: DataFrame, host: str = "source", limit: float = 0.5, keep_text: bool = False, sent_hosts: int = SENT_HOSTS, salts: int = 32) -> DataFrame:
    """docs with the measures, base_failed, host_failed and kept.

    A document fails by itself with fewer than 50 words or with more than half of them in
    repeated windows of three; it also goes if its host is rejected (``rejected_hosts``).
    Words are what ASCII white space parts.  A row without host belongs to none and is
    judged by itself alone; a null or empty text has no words and fails.  Repeated rows
    count each.  An empty table gives no rows.  Other columns pass through (``text`` only if
    ``keep_text``); columns named as the results give way to them.

    Texts are measured once; the measured rows are written to the shared folder, since
    counts of all hosts come before any verdict.  Rejected hosts go out to all tasks up to
    ``sent_hosts``; beyond that rows are joined by host and one of ``salts`` parts, so
    that a host with a third of all rows is spread.
    """
    rows = materialize(measured(docs, keep_text), "measured")
    bad = rejected_hosts(host_rates(rows, host), limit)
    size = bad.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("host")), F.lit(0)).alias("size")).first()
    bad = bad.select(F.col("host").alias("_host"), F.lit(True).alias("_bad"))
    if size["n"] <= sent_hosts and size["size"] <= SENT_BYTES:
        joined = rows.join(F.broadcast(bad), F.col(host) == F.col("_host"), "left")
    else:
        bad = bad.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        part = (F.monotonically_increasing_id() % salts).cast("int")  # of a written table: the same when a task is run again
        joined = rows.withColumn("_salt", part).join(bad, (F.col(host) == F.col("_host")) & (F.col("_salt") == F.col("_part")), "left").drop("_salt", "_part")
    own = rules()
    base = own[BASE[0]] | own[BASE[1]]
    return (joined.withColumn("base_failed", base).withColumn("host_failed", F.coalesce("_bad", F.lit(False)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("_host", "_bad"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null if it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))
