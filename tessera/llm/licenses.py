"""License scans: segments of a text against licence templates by Dice coefficient over word bigrams.

Segments are the lines, the paragraphs (between blank lines) and the whole of a
text, normalised to lower-case words. A segment can reach the threshold t only
with templates whose number of bigrams is within a factor (2 - t) / t of its
own, and only if t / (2 - t) of its bigrams are known at all; all others are
pruned unseen. A notice within a line, or one that goes on across a blank line,
is found by windows: as many words as a template has, beginning where
one of its bigrams stands, compared if t / (2 - t) of the template's bigrams can be there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import require, ship_package
from tessera.llm.decontaminate import words_of

THRESHOLD = 0.8
#: A word of bytes, letters of either case.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Notices and short forms of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-notice": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "reserved": "All rights reserved.",
}


class Templates:
    """Word bigrams of templates, in order of their number."""

    def __init__(self, templates: Mapping[str, str], threshold: float):
        self.threshold = threshold
        sets = {n: bigrams(words_of(t.encode())) for n, t in templates.items()}
        self.rows = sorted(((len(b), n, b) for n, b in sets.items() if b), key=lambda x: x[:2])
        self.known = frozenset().union(*(b for _, _, b in self.rows)) if self.rows else frozenset()
        words = {n: len(words_of(t.encode())) for n, t in templates.items()}
        self.windows = {n: (words[n], size, own) for size, n, own in self.rows}
        self.holders: dict[tuple[bytes, bytes], list[str]] = {}
        for _, n, own in self.rows:
            for b in own:
                self.holders.setdefault(b, []).append(n)
        self.least = threshold / (2 - threshold) * min((n for n, _, _ in self.rows), default=0)

    def best(self, words: list[bytes]) -> tuple[str, float] | None:
        """The template of the highest coefficient that reaches the threshold; ties go to the name that sorts first."""
        t = self.threshold
        if len(words) - 1 < self.least:
            return None
        own = bigrams(words)
        n = len(own)
        if n < self.least or len(own & self.known) * (2 - t) < t * n:
            return None
        found = None
        for size, name, other in self.rows:
            if size * (2 - t) < t * n:
                continue                                                # too small for this segment
            if n * (2 - t) < t * size:
                break                                                   # and from here on too large
            dice = 2 * len(own & other) / (n + size)
            if dice >= t and (found is None or (-dice, name) < (-found[1], found[0])):
                found = (name, dice)
        return found


def windows(words: list[bytes], templates: Templates) -> list[tuple[str, float, int, int]]:
    """(template, coefficient, first word, end) of the windows that reach the threshold and do not overlap.

    A window has as many words as its template, fewer at the end of the text, and begins at one of its bigrams. Of
    windows that overlap that with the most bigrams in common stays, then that of the higher coefficient, the earlier, the first name.
    """
    t, at, found = templates.threshold, {}, []
    for i, b in enumerate(zip(words, words[1:])):
        for name in templates.holders.get(b, ()):
            at.setdefault(name, []).append(i)
    for name, places in at.items():
        n_words, size, other = templates.windows[name]
        for k, i in enumerate(places):
            if (bisect_right(places, i + n_words - 2, k) - k) * (2 - t) < t * size:
                continue                                                # too few of its bigrams are here
            own = bigrams(words[i:i + n_words])
            common = len(own & other)
            dice = 2 * common / (len(own) + size)
            if dice >= t:
                found.append((-common, -dice, i, name, min(i + n_words, len(words))))
    out, firsts, ends = [], [], []
    for _, dice, i, name, end in sorted(found):
        k = bisect_right(firsts, i)
        if (k and ends[k - 1] > i) or (k < len(firsts) and firsts[k] < end):
            continue
        firsts.insert(k, i)
        ends.insert(k, end)
        out.append((name, -dice, i, end))
    return out


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


def segments(text: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first byte, end, words) of the lines with words, the paragraphs of several such lines, and the whole text."""
    at, held, every, alone = 0, [], [], []
    for line in (*text.split(b"\n"), b""):
        words = words_of(line)
        if words:
            row = (at, at + len(line), words)
            yield row
            held.append(row)
        if held and not line.strip():
            if len(held) > 1:
                yield held[0][0], held[-1][1], [w for _, _, own in held for w in own]
            every.extend(held)
            alone.append(len(held))
            held = []
        at += len(line) + 1
    if held:                                                            # a last line of white space ends it as well
        every.extend(held)
        alone.append(len(held))
    if len(alone) > 1:
        yield every[0][0], every[-1][1], [w for _, _, own in every for w in own]


def scan_text(text: bytes, templates: Templates) -> tuple[int, list[tuple[str, float, int, int]]]:
    """(segments, matches (template, coefficient, start, end) in code points by start and end); windows that overlap a
    segment's match tell nothing new and are left out."""
    n, found = 0, []
    for first, end, words in segments(text):
        n += 1
        hit = templates.best(words)
        if hit:
            found.append((*hit, first, end))
    inner = windows(words_of(text), templates)
    if inner:
        places = [m.span() for m in _WORD.finditer(text)]
        taken = sorted((first, end) for *_, first, end in found)
        starts, reach = [first for first, _ in taken], []
        for _, end in taken:
            reach.append(max(end, reach[-1] if reach else 0))
        for name, dice, i, j in inner:
            first, end = places[i][0], places[j - 1][1]
            k = bisect_right(starts, end - 1)
            if not k or reach[k - 1] <= first:
                found.append((name, dice, first, end))
    points = {0: 0}
    last = 0
    for at in sorted({x for *_, first, end in found for x in (first, end)}):
        points[at] = points[last] + len(text[last:at].decode())
        last = at
    return n, sorted(((name, dice, points[first], points[end]) for name, dice, first, end in found), key=lambda x: x[2:])


_MATCH = T.StructType([T.StructField("template", T.StringType()), T.StructField("dice", T.DoubleType()),
                       T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, *, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_segments long, matches array of (template, dice, first, end)) of every row; places are code points.

    Each segment gives its best template, ties by name; windows (see ``windows``) add what lies in no such segment. A null or empty text has no segments; repeated rows and null
    ids are scanned row by row; an empty table gives an empty result; other columns are not read. Templates of fewer
    than two words never match. No shuffle.
    """
    require(docs, id_col, text_col)
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        kind = pa.list_(pa.struct([("template", pa.string()), ("dice", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [scan_text(t or b"", known) for t in pc.cast(b.column(1), pa.binary()).to_pylist()]
            rows = [[dict(zip(("template", "dice", "first", "end"), m)) for m in ms] for _, ms in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(rows, kind)], [id_col, "n_segments", "matches"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("n_segments", T.LongType()), T.StructField("matches", T.ArrayType(_MATCH))]))
