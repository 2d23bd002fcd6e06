"""Waveform records: whole channels, annotations and patients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .waveform import read_blocks

SIGNAL = "record string, lead string, idx int, fs double, samples array<double>"
ANNOTATION = "record string, sample long, symbol string"
# Annotation codes of the format and their symbols.
CODES = {1: "N", 2: "L", 3: "R", 4: "a", 5: "V", 6: "F", 7: "J", 8: "A", 9: "S", 10: "E", 11: "j", 12: "/", 13: "Q", 14: "~", 16: "|", 18: "s", 19: "T",
         20: "*", 21: "D", 22: '"', 23: "=", 24: "p", 25: "B", 26: "^", 27: "t", 28: "+", 29: "u", 30: "?", 31: "!", 32: "[", 33: "]", 34: "e", 35: "n", 36: "@",
         37: "x", 38: "f", 39: "(", 40: ")", 41: "r"}


def encode_212(samples: np.ndarray) -> bytes:
    s = np.append(samples, 0) if len(samples) % 2 else samples
    s = (s.astype(np.int32) & 0xFFF).reshape(-1, 2)
    return np.stack([s[:, 0] & 0xFF, (s[:, 0] >> 8) | ((s[:, 1] >> 8) << 4), s[:, 1] & 0xFF], axis=1).astype(np.uint8).tobytes()


def decode_annotations(data: bytes) -> list[tuple[int, str]]:
    """(sample, symbol) of each annotation that has a symbol; skips, notes and sub-fields are stepped over."""
    words, at, now, out = np.frombuffer(data[: len(data) // 2 * 2], dtype="<u2"), 0, 0, []
    while at < len(words):
        code, step = int(words[at]) >> 10, int(words[at]) & 0x3FF
        at += 1
        if code == 0 and step == 0:
            break
        if code == 59:
            skip = (int(words[at]) << 16) | int(words[at + 1])
            now += skip - (1 << 32 if skip >= 1 << 31 else 0)
            at += 2
        elif code == 63:
            at += (step + 1) // 2
        elif code < 50:
            now += step
            if code in CODES:
                out.append((now, CODES[code]))
    return out


def encode_annotations(events: list[tuple[int, str]]) -> bytes:
    code, now, words = {v: k for k, v in CODES.items()}, 0, []
    for sample, symbol in events:
        step = sample - now
        if not 0 <= step < 1024:
            words += [59 << 10, (step >> 16) & 0xFFFF, step & 0xFFFF]
            step = 0
        words.append(code[symbol] << 10 | step)
        now = sample
    return np.array([*words, 0], dtype="<u2").tobytes()


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    name = F.regexp_extract(F.col("path"), r"([^/]+)\.[^./]+$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select(name.alias("record"), F.col("content").alias(suffix))


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """(record, lead, idx, fs, samples) in physical units, a row for each whole channel; ``waveform.read_blocks`` has no such rows."""
    parts = F.array_sort(F.collect_list(F.struct("start", "samples")))
    whole = read_blocks(spark, path).groupBy("record", "lead", "idx", "fs").agg(parts.alias("_p"))
    return whole.select("record", "lead", "idx", "fs", F.flatten(F.transform("_p", lambda p: p["samples"])).alias("samples"))


def read_annotations(spark: SparkSession, path: str, suffix: str = "atr") -> DataFrame:
    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r, s, x) for r, data in zip(part["record"], part[suffix], strict=True) for s, x in decode_annotations(bytes(data))]
            yield pd.DataFrame(rows, columns=["record", "sample", "symbol"])

    return _files(spark, path, suffix).mapInPandas(decode, ANNOTATION)


def patient_number(text: F.Column) -> F.Column:
    """``P07`` from a header comment such as "patient: 7" or "Patient number 12"; an error without a number."""
    found = F.regexp_extract(text, r"(?i)patient\s*(?:number)?\s*[:#]?\s*(\d+)", 1)
    return F.when(found != "", F.format_string("P%02d", found.cast("int"))).otherwise(F.raise_error(F.lit("no patient number in header")))


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """(record, patient) from the headers of a folder."""
    text = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.hea").load(path)
    return text.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.hea", 1).alias("record"), patient_number(F.col("value")).alias("patient"))


def beats(signals: DataFrame, annotations: DataFrame, symbols: dict[str, str], before: int = 90, after: int = 162) -> DataFrame:
    """Labelled beats with intervals and z-scored segments per lead.

    Symbols are filtered before intervals are taken and edges after it: a dropped edge
    beat still is a neighbour.
    """
    from ..operators import tables, windows

    marked = windows.intervals(tables.map_symbols(annotations, symbols), "record", ["sample"], "sample")

    def scale(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(samples=[(x - np.mean(x)) / (np.std(x) + 1e-8) for x in part["samples"]])

    scaled = signals.mapInPandas(scale, SIGNAL)
    cutting = marked.join(scaled.select("record", "lead", "idx", "fs", "samples", F.size("samples").alias("n")), "record")
    inside = tables.inside(cutting, "sample", "n", before, after)
    return inside.select("record", "sample", "pos", "label", (F.col("rr_pre") / F.col("fs")).alias("rr_pre"), (F.col("rr_post") / F.col("fs")).alias("rr_post"),
                         "lead", "idx", "fs", tables.cut("samples", "sample", before, after).alias("segment"))
