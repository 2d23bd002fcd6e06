"""Licence statements in whole texts by Dice similarity of word bigrams with templates."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Whole texts and notices of common public licences.
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = """
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_TEXTS = {
    "0BSD": [_ISC_GRANT + "." + _ISC_END],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [_BSD_OPENING],
    "BSD-2-Clause": [_BSD_OPENING + _BSD_CLAUSES + _BSD_END, "Released under the BSD 2-Clause License."],
    "BSD-3-Clause": [_BSD_OPENING + _BSD_CLAUSES + _BSD_THIRD + _BSD_END, "Released under the BSD 3-Clause License."],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "ISC": [
        _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.",
        _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END,
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", _MIT_GRANT,
        _MIT_GRANT + """, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "all-rights-reserved": ["All rights reserved."],
}
_GNU = {"GPL": ("General Public License", "program", ("1", "2", "3")), "LGPL": ("Lesser General Public License", "library", ("2.1", "3")),
        "AGPL": ("Affero General Public License", "program", ("1", "3"))}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_VERSIONED = {"Apache": ("Licensed under the Apache License, Version {}.", ("1.0", "1.1", "2.0")),
              "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. {}.", ("1.1", "2.0")),
              "EPL": ("This program is made available under the terms of the Eclipse Public License {}.", ("1.0", "2.0"))}
#: Words that tell neighbours apart; numbers do so too.
MARKS = frozenset("lesser library affero nc nd sa noncommercial noderivatives noderivs sharealike neither".split())


def _versions() -> dict[str, list[str]]:
    """Notices of licences that come in versions and variants, each with all its neighbours."""
    out: dict[str, list[str]] = {}
    for short, (title, thing, versions) in _GNU.items():
        for v in (*versions, *(("2",) if short == "LGPL" else ())):
            name = title.replace("Lesser", "Library") if (short, v) == ("LGPL", "2") else title
            out[f"{short}-{v if '.' in v else v + '.0'}"] = [
                f"This work is licensed under the GNU {name}, version {v}.", f"Licensed under the GNU {name}, version {v}.",
                f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
                f"Foundation, either version {v} of the License, or (at your option) any later version."]
    out["LGPL-2.0"] += [x.replace("Library General", "Lesser General") for x in out["LGPL-2.0"]]
    for short, title in _CC.items():
        for v, area in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            out[f"CC-{short}-{v}"] = [f"Licensed under CC {short} {v}.", f"This work is licensed under a Creative Commons {title} {v} {area} License."]
    for short, (notice, versions) in _VERSIONED.items():
        for v in versions:
            out[f"{short}-{v}"] = [notice.format(v)]
    return out


TEMPLATES = {k: _versions().get(k, []) + _TEXTS.get(k, []) for k in sorted({*_versions(), *_TEXTS})}

_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else c if c >= 128 else 32 for c in bytes(range(256)).lower())


def normalise(text: str) -> list[bytes]:
    """Words of a text: ASCII letters lower-cased, all ASCII but letters and digits are gaps."""
    return text.encode().translate(_PLAIN).split()


@dataclass
class Match:
    license: str
    dice: float
    first_word: int
    n_words: int
    shared: int


class Templates:
    """Templates as bags of word bigrams, and a table that tells which word pairs matter."""

    def __init__(self, templates: dict[str, list[str]], least: float, marks: frozenset[str] = MARKS):
        self.least = least
        texts = [(name, normalise(t)) for name, all_ in sorted(templates.items()) for t in all_]
        vocabulary = sorted({w for _, t in texts for w in t})
        self.word = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.n = len(vocabulary) + 1
        self.bags, users = [], []
        for i, (name, t) in enumerate(texts):
            pairs = list(zip(t, t[1:], strict=False))
            bag = Counter(self.word[a] * self.n + self.word[b] for a, b in pairs)
            told = {self.word[a] * self.n + self.word[b] for a, b in pairs if any(w.isdigit() or w.decode() in marks for w in (a, b))}
            users += [(v, i) for v in bag]
            # a window of s bigrams can reach the threshold only for smallest <= s <= largest
            size = sum(bag.values())
            self.bags.append((name, bag, told, size, size * least / (2 - least) - 1e-9, size * (2 - least) / least + 1e-9, len(t) <= 3, t[-1:] and t[-1].isdigit()))
        values = np.array(sorted({v for v, _ in users}), dtype=np.int64)
        #: for each known bigram its number; for each pair of bigram and template that has it, a row
        self.values = values
        by = np.searchsorted(values, [v for v, _ in users]) if users else np.empty(0, np.int64)
        order = np.argsort(by, kind="stable")
        self.users = np.array([i for _, i in users], dtype=np.int64)[order]
        self.starts = np.searchsorted(by[order], np.arange(len(values) + 1))
        self.code = np.full(self.n * self.n, -1, dtype=np.int32)
        self.code[values] = np.arange(len(values))

    def find(self, text: str, exclusive: bool = True) -> list[Match]:
        """The best window of the text for every licence that reaches the threshold.

        ``exclusive``: words speak for one licence only, the one whose template explains most
        of them, so a notice does not count for another licence whose wording is close.
        """
        words = normalise(text)
        get = self.word.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int64)
        codes = self.code[ids[:-1] * self.n + ids[1:]] if len(ids) > 1 else np.empty(0, np.int32)
        hits = np.flatnonzero(codes >= 0)
        best: dict[str, Match] = {}
        every: list[Match] = []
        phrases: _Phrases | None = None
        if len(hits):
            own = codes[hits]
            # how often each template's bigrams stand in the text: those with too few are not compared
            many = np.bincount(own, minlength=len(self.values))
            counts = np.zeros(len(self.bags), dtype=np.int64)
            there = np.flatnonzero(many)
            for c in there:
                counts[self.users[self.starts[c] : self.starts[c + 1]]] += many[c]
            for i in np.flatnonzero(counts):
                name, bag, told, size, smallest, largest, short, numbered = self.bags[i]
                if counts[i] < smallest or len(codes) < smallest:
                    continue
                member = np.zeros(len(self.values), dtype=bool)
                member[self.code[list(bag)]] = True
                at = hits[member[own]]
                for dice, first, last, shared in self._windows(at, ids, bag, told, size, largest):
                    if numbered and (tail := words[last + 2 : last + 3]) and tail[0].isdigit() and tail[0] != b"0":
                        continue  # version 2 is not version 2.1
                    if short:
                        phrases = phrases or _Phrases(text)
                        if not phrases.alone(first, last + 1):
                            continue
                    every.append(Match(name, dice, int(first), int(last - first + 2), int(shared)))
        taken: list[tuple[int, int]] = []
        for match in sorted(every, key=lambda m: (-m.shared, -m.dice, m.first_word, m.license)):
            end = match.first_word + match.n_words
            i = bisect_left(taken, (end, 0))
            if exclusive and i and taken[i - 1][1] > match.first_word:
                continue
            if exclusive:
                insort(taken, (match.first_word, end))
            held = best.get(match.license)
            if held is None or match.dice > held.dice:
                best[match.license] = match
        return [best[k] for k in sorted(best)]

    def _windows(self, at: np.ndarray, ids: np.ndarray, bag: Counter, told: set[int], size: int, largest: float, chunk: int = 1 << 20):
        """(dice, first, last, shared) of the best window from each of the template's bigrams on, if it reaches the threshold.

        Bigram j counts for a window from i on while the template has it more often than it
        stands between them: if the bag's number of occurrences before j lies before i.
        """
        value = ids[at] * self.n + ids[at + 1]
        before = np.full(len(at), -1, dtype=np.int64)
        order = np.argsort(value, kind="stable")
        edges = np.flatnonzero(np.diff(value[order])) + 1
        for group in np.split(order, edges):
            n = bag[int(value[group[0]])]
            before[group[n:]] = group[:-n]
        reach = np.searchsorted(at, at + largest - 1, side="right")  # a window has ``largest`` bigrams at most
        width = int((reach - np.arange(len(at))).max())
        for lo in range(0, len(at), max(1, chunk // width)):
            rows = np.arange(lo, min(len(at), lo + max(1, chunk // width)))
            span = rows[:, None] + np.arange(width)[None, :]
            ok = span < reach[rows][:, None]
            span = np.minimum(span, len(at) - 1)
            shared = np.cumsum((before[span] < rows[:, None]) & ok, axis=1)
            length = at[span] - at[rows][:, None] + 1
            # of those that reach the threshold the one that shares most, of equals the shortest
            last = np.where(ok & (2 * shared >= self.least * (length + size)), shared * (1 << 32) - length, -1).argmax(axis=1)
            pick = np.arange(len(rows))
            n, length = shared[pick, last], length[pick, last]
            dice = 2 * n / (length + size)
            good = 2 * n >= self.least * (length + size)
            for mark in told:
                spots = at[value == mark]
                nxt = np.searchsorted(spots, at[rows])
                good &= (nxt < len(spots)) & (np.append(spots, 1 << 62)[nxt] < at[rows] + length)
            for i in np.flatnonzero(good):
                yield float(dice[i]), int(at[rows[i]]), int(at[rows[i]] + length[i] - 1), int(n[i])


class _Phrases:
    """Where the words of a text lie, taken once."""

    def __init__(self, text: str):
        self.data = text.encode()
        self.spans = [m.span() for m in re.finditer(rb"[^ ]+", self.data.translate(_PLAIN))]

    def alone(self, first: int, last: int) -> bool:
        """Whether words first..last stand by themselves: after a mark, a line's end or with a capital, and before a mark or a line's end."""
        data, spans = self.data, self.spans
        ahead = data[spans[first - 1][1] : spans[first][0]] if first else b"."
        behind = data[spans[last][1] : spans[last + 1][0]] if last + 1 < len(spans) else b"."
        return (bool(ahead.strip(b" \t")) or data[spans[first][0] : spans[first][0] + 1].isupper()) and bool(behind.strip(b" \t"))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = 0.8, exclusive: bool = True) -> DataFrame:
    """doc_id, license, dice, first_word, n_words: a row for each licence stated in a document.

    Text and templates are normalised to words; windows of the whole text are compared
    with a template by the Dice coefficient of their bags of word bigrams.  Size bounds
    prune: a window of s bigrams reaches ``least`` with a template of t only if
    t * least / (2 - least) <= s <= t * (2 - least) / least, and a document with fewer of a
    template's bigrams than the lower bound is not compared with it.  From each bigram of
    the template on, of the windows that reach ``least`` the one that shares most counts (of
    equals the shortest); it must hold those of the template's bigrams that tell its neighbours apart (numbers,
    and words such as lesser, nc or nd), and a number at its end must not go on: version
    2.1 is not version 2.  Templates of three words or fewer count as phrases of their own only.

    Of a licence the most similar window is reported (the first of equals); unless
    ``exclusive`` is off, words of a window that shares more with its template do not count
    for another licence.

    Null, empty and wordless texts state nothing.  Each row is scanned on its own, repeated
    ones and those without doc_id too.  The work is linear in a text's length, however often
    a notice repeats in it.  Empty table: no rows.  Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for part in parts:
            rows, found = [], []
            for i, text in enumerate(part["text"].to_pylist()):
                for match in known.find(text or "", exclusive):
                    rows.append(i)
                    found.append(match)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].take(pa.array(rows, pa.int64())), pa.array([m.license for m in found], pa.string()), pa.array([m.dice for m in found], pa.float64()),
                 pa.array([m.first_word for m in found], pa.int64()), pa.array([m.n_words for m in found], pa.int64())],
                ["doc_id", "license", "dice", "first_word", "n_words"])

    return docs.select(F.col("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, license string, dice double, first_word long, n_words long")
