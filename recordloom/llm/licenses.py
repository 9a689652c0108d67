"""License scans by patience alignment of texts with templates."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bind, need, slices

#: Share of a template's words that must be aligned, in order.
COVERAGE = 0.8


class Template(NamedTuple):
    """A text that stands for a license. Its words ``must`` (those that tell it from others, the most telling first) have to be aligned, whatever the coverage."""

    license: str
    text: str
    must: str = ""


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = re.search("3[.].*\n", _BSD)[0]
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MOZILLA = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {n}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {n}General Public License for more details."
_FAMILY = [("GPL", "", "2"), ("GPL", "", "3"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3"), ("AGPL", "Affero ", "3")]
_CC = {"": "", "-NC": "NonCommercial", "-SA": "ShareAlike", "-ND": "NoDerivatives", "-NC-SA": "NonCommercial ShareAlike", "-NC-ND": "NonCommercial NoDerivatives"}


def _long(version: str) -> str:
    return version if "." in version else f"{version}.0"


#: Whole short licenses (-text), headers that stand for long ones (-header), openings, and the names by which notices call a license.
TEMPLATES = [
    Template("MIT-text", _MIT),
    Template("BSD-3-text", _BSD, "endorse neither"),
    Template("BSD-2-text", _BSD.replace(_BSD_3, "")),
    Template("ISC-text", _ISC),
    Template("Zlib-text", _ZLIB),
    Template("Unlicense-text", _UNLICENSE, "unencumbered"),
    Template("BSL-1.0-text", _BOOST),
    Template("Apache-2.0-header", _APACHE, "apache 2.0"),
    Template("MPL-2.0-header", _MOZILLA, "mozilla 2.0"),
    *[Template(f"{short}-{_long(v)}-header", _GNU.format(n=n, v=form), f"gnu {n}general {form}".lower()) for short, n, v in _FAMILY for form in dict.fromkeys([v, _long(v)])],
    Template("MIT-opening", _MIT[: _MIT.index(", including")]),
    Template("BSD-opening", _BSD[: _BSD.index(":")]),
    Template("ISC-opening", _ISC[: _ISC.index("\n")]),
    Template("MIT", "MIT License", "mit license"),
    Template("ISC", "ISC License", "isc license"),
    Template("Apache-2.0", "Apache License Version 2.0", "apache version 2.0"),
    Template("Apache-2.0", "Apache License 2.0", "apache license 2.0"),
    Template("Apache-2.0", "Apache 2.0", "apache 2.0"),
    Template("MPL-2.0", "Mozilla Public License 2.0", "mozilla public 2.0"),
    *[Template(f"BSD-{n}", f"BSD {n} Clause", f"bsd {n} clause") for n in "234"],
    *[Template(f"{short}-{_long(v)}", f"GNU {n}General Public License version {form}", f"gnu {n}general public version {form}".lower()) for short, n, v in _FAMILY for form in dict.fromkeys([v, _long(v)])],
    *[Template(f"{short}-{_long(v)}", text, text.lower()) for short, _, v in _FAMILY for text in (f"{short}v{v}", f"{short} v{v}", *dict.fromkeys([f"{short} {v}", f"{short} {_long(v)}"]))],
    *[Template(f"CC-BY{kind}-{v}", f"CC BY{kind} {v}", f"{v} cc by{kind.replace('-', ' ')}".lower()) for kind in _CC for v in ("1.0", "2.0", "2.5", "3.0", "4.0")],
    *[Template(f"CC-BY{kind}-{v}", f"Creative Commons Attribution {name} {v}", f"commons creative attribution {name} {v}".lower()) for kind, name in _CC.items() for v in ("2.0", "2.5", "3.0", "4.0")],
    Template("CC0-1.0", "CC0 1.0", "cc0 1.0"),
    Template("All-rights-reserved", "All rights reserved", "reserved all rights"),
]

_WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    """Lower-case words; a version number is one word."""
    return _WORDS.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising in both.

    Equal words at both ends are aligned first. Then the words that are unique in both are anchors, as far as they are on
    a longest increasing subsequence; the gaps between anchors are aligned in the same way. A gap without anchors is
    aligned by a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        places = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1}
        pairs = [(i, places[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and a[i] in places]
        if not pairs:
            out += _common(a, a0, a1, b, b0, b1)
            continue
        anchors = _increasing(pairs)
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by the first, that rises in the second: piles with back pointers."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[k] = ends[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[pile], ends[pile] = j, k
    out, k = [], ends[-1]
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[str], a0: int, a1: int, b: list[str], b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two short gaps."""
    n, m = a1 - a0, b1 - b0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[a0 + i] == b[b0 + j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[a0 + i] == b[b0 + j]:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def key_words(template: list[str], must: list[str], coverage: float) -> list[str]:
    """Words of which a text must hold one at least, to be aligned with the template: the first that must be there, or its longest at more places than may be missed."""
    if must:
        return must[:1]
    missable = len(template) - _least(len(template), coverage)
    out: list[str] = []
    for word in sorted(set(template), key=lambda w: (-len(w), w)):
        out.append(word)
        if sum(template.count(w) for w in out) > missable:
            return out
    return out


def _least(n: int, coverage: float) -> int:
    return max(1, -int(-coverage * n // 1))


class Scanner:
    """Templates with their key words, and where to look for each."""

    def __init__(self, templates: list[Template], coverage: float) -> None:
        self.coverage = coverage
        self.templates = [(t.license, words, words_of(t.must)) for t in templates if (words := words_of(t.text))]
        self.counts = [Counter(words) for _, words, _ in self.templates]
        self.by_word: dict[str, list[tuple[int, int]]] = {}  # key word: template, and the word's place in it
        for t, (_, words, must) in enumerate(self.templates):
            for key in key_words(words, must, coverage):
                for k, w in enumerate(words):
                    if w == key:
                        self.by_word.setdefault(key, []).append((t, k))

    def places(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(aligned words, template, first word, words) of each stretch that covers a template."""
        out, seen = set(), set()
        for at, word in enumerate(words):
            for t, k in self.by_word.get(word, ()):
                _, template, must = self.templates[t]
                n = len(template)
                start = max(0, at - k - n // 2)
                if (t, start) in seen:
                    continue
                seen.add((t, start))
                part = words[start : at - k + n + n // 2]
                there, least = set(part), _least(n, self.coverage)
                # No alignment has more words than the template has of those that are there.
                if not there.issuperset(must) or sum(c for w, c in self.counts[t].items() if w in there) < least:
                    continue
                pairs = patience(part, template)
                if len(pairs) >= least and set(must) <= {template[j] for _, j in pairs}:
                    out.add((len(pairs), t, pairs[0][0] + start, pairs[-1][0] - pairs[0][0] + 1))
        return list(out)

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(license, first word, words, coverage) of the best place of each license: of stretches that overlap, that with most aligned words counts, then the shortest, then the best covered, then the first."""
        words = words_of(text)
        share = lambda p: p[0] / len(self.templates[p[1]][1])
        taken: list[tuple[int, int]] = []
        best: dict[str, tuple] = {}
        for place in sorted(self.places(words), key=lambda p: (-p[0], p[3], -share(p), p[2], p[1])):
            aligned, t, first, n = place
            at = bisect_left(taken, (first,))
            if (at and taken[at - 1][1] > first) or (at < len(taken) and taken[at][0] < first + n):
                continue
            insort(taken, (first, first + n))
            name = self.templates[t][0]
            rank = (-share(place), -aligned, n, first)
            best[name] = min(best.get(name, rank), rank)
        return sorted((name, first, n, -share_) for name, (share_, _, n, first) in best.items())


def license_scan(docs: DataFrame, templates: list[Template] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id``, ``license``, ``start_word``, ``n_words`` and ``coverage`` for each license that a text names or contains.

    A template is contained if patience alignment (:func:`patience`) of its words with a stretch of the text aligns at
    least ``coverage`` of them, in order, and among them all that it ``must`` have: names, versions and variants.
    Stretches have twice the words of the template and lie around each of its key words. Where stretches of several
    templates overlap, only the one with most aligned words is meant (a tie: the shortest, the best covered, the first).
    For each license its best covered place is given, then the one of most words, the shortest, the first. Texts without
    any key word of any template can't be covered and are left out before.

    Null, empty and blank texts give no rows. Very long texts are scanned whole. Rows without ``doc_id`` give a null id.
    Repeated rows give repeated results. An empty table gives no rows. Other columns don't matter, whatever their names.
    """
    need(docs, "doc_id", "text")
    scanner = Scanner(templates, coverage)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [w for w in scanner.by_word if not any(k in w and k != w for k in scanner.by_word)]  # a word that contains another key word is found with it
    holds = bind(F.lower("text"), lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in keys], F.lit(False)))
    rows = rows.where("text IS NOT NULL").where(holds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, got = batch.column(0), []
            for t, text in enumerate(batch.column(1).to_pylist()):
                got += [(t, *x) for x in scanner.scan(text)]
            t, name, start, n, share = zip(*got, strict=True) if got else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(t, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(share, pa.float64())],
                names=["doc_id", "license", "start_word", "n_words", "coverage"],
            )

    return rows.mapInArrow(run, "doc_id long, license string, start_word int, n_words int, coverage double")
