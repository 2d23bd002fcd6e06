"""Fill-in-the-middle: cuts between tokens, located by ranks of a wavelet matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, release, small_batches
from .wavelet import WaveletMatrix, classes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 from the seed and the key's text (a null key: the text null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cuts(texts: list[bytes], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, places, chars): tokens of each text; the byte offsets of its two cuts; characters before each.

    A token is a run of A-Z and a-z or any other single character.  The cuts fall after
    the smaller and the larger of first % (n + 1) and second % (n + 1) tokens.
    """
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    lo, hi = ends[:-1], ends[1:]
    matrix = WaveletMatrix(classes(np.frombuffer(b"".join(texts), np.uint8), lo))
    n = matrix.boundaries(hi) - matrix.boundaries(lo)
    after = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    at = np.stack([matrix.locate(k, lo, hi) for k in after])
    return n, at - lo, np.stack([matrix.characters(x) for x in at]) - matrix.characters(lo)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output.

    A text of n tokens is cut twice.  ``psm`` gives <P>prefix<S>suffix<M>middle, ``spm``
    <S>suffix<P>prefix<M>middle.  ``plain`` leaves the text as it is: if it is null or
    empty, if it holds one of the three marks, or if the third draw modulo 100 is
    ``plain_from`` or more; its prefix_chars and middle_chars are null and its output is
    the text (null: empty).  The fourth draw modulo 100 below ``spm_below`` means spm.

    All follows from the row's key and text: repeated rows, and rows without a key that
    have equal texts, come out alike.  An empty table gives no rows.  Other columns
    pass through; columns named as the results give way to them.  Texts are taken whole,
    about 4 MB at a time, a longer one alone, at some six bytes of memory for each of its bytes.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*RESULTS, "_d1", "_d2", "_plain", "_spm")
    columns, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    text, (d1, d2, d3, d4) = F.coalesce("text", F.lit("")), draws(F.col(key), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    drawn = docs.withColumns({"_d1": d1, "_d2": d2, "_plain": (text == "") | marked | (d3 % 100 >= plain_from), "_spm": d4 % 100 < spm_below})
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in parts:
            texts = [x or b"" for x in part["text"].cast(pa.binary()).to_pylist()]
            d1, d2 = (part[c].to_numpy() for c in ("_d1", "_d2"))
            for lo, hi in batches(texts, 4 << 20):
                own = slice(lo, hi)
                n, at, chars = cuts(texts[own], d1[own], d2[own])
                plain, spm = (np.array(part[c][own].to_pylist(), bool) for c in ("_plain", "_spm"))
                out = []
                for x, a, b, is_plain, is_spm in zip(texts[own], *at.tolist(), plain.tolist(), spm.tolist(), strict=True):
                    order = (s, x[b:], p, x[:a]) if is_spm else (p, x[:a], s, x[b:])
                    out.append(x if is_plain else b"".join((*order, m, x[a:b])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [*(part[c][own] for c in columns), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(chars[0], mask=plain),
                     pa.array(chars[1] - chars[0], mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    [*columns, *RESULTS])

    return drawn.mapInArrow(run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its three parts in their first order, exactly."""
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
