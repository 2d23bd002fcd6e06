"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, release, small_batches

DIMS, N, SEED = 1024, 3, 20240229
#: Codes of symbols: 0 is the gap between words, others are code points of letters.
_FOLD: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    if "map" not in _FOLD:
        table = np.arange(0x110000, dtype=np.uint32)
        table[[i for i in range(0x110000) if not unicodedata.category(chr(i)).startswith("L")]] = 0
        _FOLD["map"] = table
    return _FOLD["map"]


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters of a text with one gap between words and at both ends; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _letters()[codes]
    if not codes.any():
        return codes[:0]
    codes = np.concatenate([codes[:1] * 0, codes, codes[:1] * 0])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


class Grams:
    """Random bipolar vectors of letters, and n-gram vectors bound from them.

    The vector of n-gram abc is roll(a, 2) * roll(b, 1) * c: the cyclic shift marks the
    place, the product binds.  A letter's vector follows from its code point alone, so all
    tasks agree.  Vectors of the n-grams met last are kept (at most ``keep``).
    """

    def __init__(self, dims: int = DIMS, n: int = N, keep: int = 30_000):
        self.dims, self.n, self.keep = dims, n, keep
        self.letters: dict[int, np.ndarray] = {}
        self.known: np.ndarray = np.empty(0, U64)
        self.place = np.empty(0, np.int64)
        self.vectors = np.empty((keep, dims), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            words = mix(mix(np.arange(self.dims // 64, dtype=U64) + (U64(code) << U64(16))) + U64(SEED))
            bits = np.unpackbits(words.view(np.uint8))
            self.letters[code] = (bits.astype(np.int8) * 2 - 1)
        return self.letters[code]

    def ids(self, s: np.ndarray) -> np.ndarray:
        s = s.astype(U64)
        out = np.zeros(max(0, len(s) - self.n + 1), dtype=U64)
        for i in range(self.n):
            out = (out << U64(21)) | s[i : len(s) - self.n + 1 + i]
        return out

    def bound(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct n-grams, a row each."""
        new = np.setdiff1d(ids, self.known, assume_unique=True)
        if len(new):
            if len(self.known) + len(new) > self.keep:
                self.known, self.place, new = self.known[:0], self.place[:0], ids
            rows = np.arange(len(self.known), len(self.known) + len(new))
            for r, gram in zip(rows, new.tolist(), strict=True):
                v = self.letter(gram & 0x1FFFFF)
                for place in range(1, self.n):
                    v = v * np.roll(self.letter((gram >> (21 * place)) & 0x1FFFFF), place)
                self.vectors[r] = v
            known, at = np.concatenate([self.known, new]), np.concatenate([self.place, rows])
            order = np.argsort(known)
            self.known, self.place = known[order], at[order]
        return self.vectors[self.place[np.searchsorted(self.known, ids)]]

    def bundle(self, texts: list[str | None], rows: int = 64) -> np.ndarray:
        """Sums of the vectors of all n-grams of each whole text."""
        out = np.zeros((len(texts), self.dims), np.float32)
        for lo in range(0, len(texts), rows):
            found = [np.unique(self.ids(symbols(t or "")), return_counts=True) for t in texts[lo : lo + rows]]
            grams = np.unique(np.concatenate([g for g, _ in found]))
            for a in range(0, len(grams), 4096):
                part = grams[a : a + 4096]
                counts = np.zeros((len(found), len(part)), np.float32)
                for r, (g, n) in enumerate(found):
                    own = slice(*np.searchsorted(g, [part[0], part[-1] + U64(1)]))
                    counts[r, np.searchsorted(part, g[own])] = n[own]
                out[lo : lo + len(found)] += counts @ self.bound(part).astype(np.float32)
        return out


def train(rows: DataFrame, dims: int = DIMS, n: int = N) -> pd.DataFrame:
    """Prototypes: one bundle of ``dims`` sums per language, over all training rows.

    Each task bundles its rows per language and Spark adds the partial bundles up by
    (language, dimension), so what reaches the driver is languages x dims numbers.
    """

    def bundle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        grams, held = Grams(dims, n), {}
        for part in parts:
            sums = grams.bundle(part["text"].to_pylist())
            norms = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
            langs = np.array(part["lang"].to_pylist(), dtype=object)
            for lang in set(langs):
                # long documents would drown the others: each adds one unit vector
                held[lang] = held.get(lang, 0) + np.rint((sums / norms)[langs == lang].astype(np.float64) * 2**20).astype(np.int64).sum(axis=0)
        for lang, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims)), pa.array(v)], ["lang", "dim", "value"])

    sums = rows.select("text", "lang").mapInArrow(bundle, "lang string, dim long, value long")
    out = sums.groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()
    return out.pivot(index="lang", columns="dim", values="value").sort_index() if len(out) else pd.DataFrame()


def predict(docs: DataFrame, prototypes: pd.DataFrame, dims: int = DIMS, n: int = N) -> DataFrame:
    """Add lang_pred and score, the cosine with the nearest prototype (not below 0)."""
    langs = list(prototypes.index)
    p = prototypes.to_numpy(np.float32) if langs else np.zeros((0, dims), np.float32)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    sent = docs.sparkSession.sparkContext.broadcast((langs, p))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        langs, p = sent.value
        grams = Grams(dims, n)
        for part in parts:
            sums = grams.bundle(part["text"].to_pylist())
            norms = np.linalg.norm(sums, axis=1)
            cos = (sums @ p.T) / np.maximum(norms, 1e-9)[:, None]
            best = cos.argmax(axis=1) if langs else np.zeros(len(sums), int)
            none = (norms == 0) | (not langs)
            pred = ["und" if x else langs[b] for x, b in zip(none, best, strict=True)]
            score = [0.0 if x else float(np.clip(cos[i, b], 0.0, 1.0)) for i, (x, b) in enumerate(zip(none, best, strict=True))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Every row of docs with held_out, lang_pred and score.

    The prototypes are learnt from the rows whose crc32(doc_id) mod 5 is not 0 and whose
    lang is not null; prediction sees the whole text and nothing else.  ``und`` with score
    0: null text, text without a letter, or nothing to learn from.  A row without doc_id is
    not held out.  Ties go to the language that sorts first.  Empty table: no rows.
    Other columns pass through; columns named as the results give way to them.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("held_out", "lang_pred", "score")
    prototypes = train(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return predict(docs.withColumn("held_out", held_out()), prototypes)
