"""License scans by patience alignment.

Templates are compared with texts word by word. Words unique to both the template and a stretch
of text are anchors; the longest increasing subsequence of anchors is kept and the gaps between
them are aligned in the same way. In a gap without such a word, the first occurrences of a word
are taken for one another, and so on. A template's coverage is the share of its words that align.

A template stands in a stretch of at most twice its number of words. Which stretches may hold it
follows from counts: at least as many words of the template, and as many different ones, as must
align. The counts of all stretches of all texts are running sums in numpy; only stretches that
pass, hardly any in other prose, are aligned, in windows that begin an eighth of the template's
length apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents
from .text import chunks, words

# License texts and notices, by name.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT": _MIT_GRANT,
    "MIT with warranty": _MIT_GRANT + _MIT_WARRANTY,
    "BSD-2-Clause": _BSD_TWO,
    "BSD-2-Clause with warranty": _BSD_TWO + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_TWO + _BSD_THIRD,
    "BSD-3-Clause with warranty": _BSD_TWO + _BSD_THIRD + _BSD_WARRANTY,
    "ISC": _ISC_GRANT,
    "ISC with warranty": (
        _ISC_GRANT + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
        "notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
        "are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "GPL-2.0 header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: Words of the stretch that may hold a template, in words of the template.
REACH = 2
#: Bytes that end a word: all ASCII characters but letters and digits.
_BREAK = np.ones(256, bool)
_BREAK[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_BREAK[128:] = False


class Template(NamedTuple):
    name: str
    words: list[int]
    distinct: int

    def needed(self, percent: int) -> tuple[int, int]:
        """How many words must align, and how many different ones these are at least."""
        most = -(-percent * len(self.words) // 100)
        return most, max(self.distinct - (len(self.words) - most), 1)


def template_index(templates: dict[str, str]) -> list[Template]:
    out = []
    for name, text in templates.items():
        buf = np.frombuffer(text.encode("utf-8"), np.uint8)
        h = words(buf, np.array([0, buf.size]), _BREAK).hashes()
        if h.size:
            out.append(Template(name, h.tolist(), np.unique(h).size))
    return out


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _anchors(a: list, i: int, n: int, b: list, j: int, m: int) -> list[tuple[int, int]]:
    """Pairs of words unique to both parts; without any, of equal occurrences of a word."""
    at_a: dict = {}
    for x in range(i, n):
        at_a.setdefault(a[x], []).append(x)
    at_b: dict = {}
    for y in range(j, m):
        if b[y] in at_a:
            at_b.setdefault(b[y], []).append(y)
    once = [(at_a[w][0], ys[0]) for w, ys in at_b.items() if len(ys) == 1 and len(at_a[w]) == 1]
    return sorted(once or [p for w, ys in at_b.items() for p in zip(at_a[w], ys)])


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, in order."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, n, j, m = work.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        anchors = _anchors(a, i, n, b, j, m)
        kept = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        out += kept
        if kept:
            edges = [(i - 1, j - 1), *kept, (n, m)]
            work += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def _stretches(member: np.ndarray, before: np.ndarray, row_start: np.ndarray, row_end: np.ndarray, size: int, least: int, distinct: int) -> np.ndarray:
    """Words at which a stretch of ``size`` words begins that has enough words of a template, and different ones.

    ``member`` lists the words of the template's vocabulary, ``before`` the previous occurrence of
    each; a stretch ends with its row. Only stretches that begin with such a word are looked at.
    """
    n = np.searchsorted(member, np.minimum(member + size, row_end)) - np.arange(member.size)
    some = np.flatnonzero(n >= least)
    if not some.size:
        return some
    # An occurrence is the first of its word in the stretches that begin after the one before it.
    lo = np.searchsorted(member, np.maximum(np.maximum(before + 1, member - size + 1), row_start))
    step = np.bincount(lo, minlength=member.size + 1) - np.bincount(np.arange(1, member.size + 1), minlength=member.size + 1)
    return member[some[np.cumsum(step)[some] >= distinct]]


def _best_place(t: Template, h: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> tuple[int, int, int]:
    """(aligned words, first, last) of the place with most aligned words, of equals the shortest, then the first."""
    size = len(t.words)
    best = (0, 0, 0)
    step = max(size // 8, 1)
    tried = -step
    for x in starts.tolist():
        if x < tried + step:
            continue
        tried = x
        for length in sorted({size, size + size // 4 + 1, size + size // 2 + 1, REACH * size}):
            a, b = x, min(x + length, hi)
            pairs = patience(t.words, h[a:b].tolist())
            if pairs:
                found = (len(pairs), a + pairs[0][1], a + pairs[-1][1])
                if (found[0], found[1] - found[2]) > (best[0], best[1] - best[2]):
                    best = found
            if len(pairs) == size or b == hi:
                break
        if best[0] == size and best[2] - best[1] == size - 1:
            break
    # The best place once more from its own first word: a step may have cut its beginning.
    for a in (max(best[1] - step, lo), best[1]):
        pairs = patience(t.words, h[a : min(a + REACH * size, hi)].tolist())
        if pairs and (len(pairs), pairs[0][1] - pairs[-1][1]) > (best[0], best[1] - best[2]):
            best = (len(pairs), a + pairs[0][1], a + pairs[-1][1])
    return best


def _scan(templates: list[Template], percent: int):
    vocabulary = np.unique(np.concatenate([np.array(t.words, np.uint64) for t in templates]))
    holds = [np.isin(vocabulary, np.array(t.words, np.uint64)) for t in templates]
    needs = [t.needed(percent) for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column(1)):
                w = words(buf, offs, _BREAK)
                h = w.hashes()
                at = np.minimum(np.searchsorted(vocabulary, h), vocabulary.size - 1)
                known = np.flatnonzero(vocabulary[at] == h)
                word = at[known]
                order = np.argsort(word, kind="stable")
                before = np.full(known.size, -1)
                same = word[order[1:]] == word[order[:-1]]
                before[order[1:][same]] = known[order[:-1][same]]
                row = np.searchsorted(w.offs, known, side="right") - 1
                found: dict[int, list] = {}
                for t, own, (least, distinct) in zip(templates, holds, needs):
                    mine = own[word]
                    r = row[mine]
                    starts = _stretches(known[mine], before[mine], w.offs[r], w.offs[r + 1], REACH * len(t.words), least, distinct)
                    of = np.searchsorted(w.offs, starts, side="right") - 1
                    for x in np.unique(of).tolist():
                        n, first, last = _best_place(t, h, starts[of == x], int(w.offs[x]), int(w.offs[x + 1]))
                        if 100 * n >= percent * len(t.words):
                            found.setdefault(x, []).append((t.name, n, len(t.words), int(w.starts[first] - offs[x]), int(w.ends[last] - offs[x])))
                rows = [(lo + x, *f) for x in sorted(found) for f in _largest(found[x])]
                if rows:
                    cols = list(zip(*rows))
                    share = [x / y for x, y in zip(cols[2], cols[3])]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array(share)],
                        names=["doc_id", "license", "n_aligned", "n_template", "begin_byte", "end_byte", "coverage"],
                    )

    return run


def _largest(found: list[tuple]) -> list[tuple]:
    """Results that do not lie within another one's span that has more aligned words."""
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (-f[1], f[2], f[0])):
        if not any(f[3] >= k[3] and f[4] <= k[4] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[0])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, percent: int = 80) -> DataFrame:
    """License templates that whole texts hold.

    One row per row of ``docs`` (``doc_id`` and ``text``; other columns are ignored) and template
    of which at least ``percent`` percent of the words align within a stretch of at most twice as
    many words: ``doc_id``, ``license``, ``n_aligned``, ``n_template``, ``begin_byte`` and
    ``end_byte`` (where in the text's UTF-8 bytes the aligned part lies) and ``coverage``; where a
    text holds a template several times, of the place with most aligned words, the shortest and
    then the first of equals. Of a family of templates that match the same part of a text the one
    with most aligned words is told. Words are runs of ASCII letters and digits and of all
    non-ASCII characters, with A-Z lower-cased. Null, empty and blank texts have no licenses.
    Repeated rows give repeated results; a null doc_id stays null. Templates without a word are
    left out.
    """
    index = template_index(TEMPLATES if templates is None else templates)
    schema = "doc_id long, license string, n_aligned long, n_template long, begin_byte long, end_byte long, coverage double"
    if not index:
        return docs.sparkSession.createDataFrame([], schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(index, percent), schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir))
