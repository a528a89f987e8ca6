"""License scans by patience alignment of texts with templates.

Words are ``[a-z0-9]+`` of the lower-cased text. A template's words that a document has at all bound its coverage from
above, which leaves few pairs to align. In these, every window (at most ``stretch`` times the template's length) whose
words could reach the threshold is aligned, and of overlapping matches the best one counts: anchors are the words unique to both sides, the longest increasing
subsequence of their places keeps order, and the gaps between anchors are aligned in the same way; a gap without
anchors is closed by its longest common subsequence. Coverage is aligned words over template words.

Defined cases: null and empty texts match nothing; a template that occurs several times gives a span each; spans are
in the order of template names, then of places, and of overlapping matches of equal coverage the first counts; repeated rows are scanned each; any length is scanned whole; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read, text_of

#: Published license texts and the notices by which works refer to a license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
WORDS = re.compile(r"[a-z0-9]+")


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by their first, whose seconds increase (patience piles)."""
    tops: list[int] = []
    pile: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = pile[k - 1] if k else -1
        tops[k : k + 1], pile[k : k + 1] = [y], [i]
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of two short lists."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: increasing pairs of places with equal words."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: x for x, w in enumerate(b[k:m], k) if once_b[w] == 1}
        anchors = rising([(x, place[w]) for x, w in enumerate(a[i:j], i) if once_a[w] == 1 and w in place])
        if not anchors:
            out += [(i + x, k + y) for x, y in common(a[i:j], b[k:m])]
            continue
        out += anchors
        edges = [(i - 1, k - 1), *anchors, (j, m)]
        gaps += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float, stretch: float = 1.5):
        self.threshold, self.stretch = threshold, stretch
        self.templates = {n: WORDS.findall(t.lower()) for n, t in sorted(templates.items())}
        self.counts = {n: Counter(t) for n, t in self.templates.items()}
        self.vocabulary = {w for t in self.templates.values() for w in t}

    def spans(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word + 1) of every match."""
        words = WORDS.findall(text.lower())
        have = self.vocabulary.intersection(words)
        out = []
        for name, t in self.templates.items():
            count = self.counts[name]
            if sum(count[w] for w in have if w in count) < self.threshold * len(t):
                continue
            at = [i for i, w in enumerate(words) if w in count]
            out += [(name, n / len(t), first, end) for n, first, end in self.matches(words, at, t, count, 0, len(words))]
        return out

    def matches(self, words: list[str], at: list[int], t: list[str], count: Counter, begin: int, stop: int) -> list[tuple[int, int, int]]:
        """(aligned words, first word, last word + 1) of the matches among the words from begin to stop.

        Of overlapping matches the one of best coverage counts, of equal ones the first; the words that it leaves before
        it are searched again.
        """
        need, span = self.threshold * len(t), int(self.stretch * len(t)) + 1
        at = at[bisect_left(at, begin) : bisect_left(at, stop)]
        out: list[tuple[int, int, int]] = []
        inside: Counter = Counter()
        useful, hi, opened = 0, 0, 0
        best: tuple[int, int, int] | None = None

        def close() -> None:
            if best[1] - opened >= need:
                out.extend(self.matches(words, at, t, count, opened, best[1]))
            out.append(best)

        for first in at:  # a window begins at each template word
            if best and first >= best[2]:
                close()
                best = None
            while hi < len(at) and at[hi] < first + span:
                w = words[at[hi]]
                inside[w] += 1
                useful += inside[w] <= count[w]
                hi += 1
            if useful >= need and (not best or useful > best[0]):
                pairs = align(words[first : min(first + span, stop)], t)
                if len(pairs) >= need and (not best or len(pairs) > best[0]):
                    opened = opened if best else first
                    best = (len(pairs), first + pairs[0][0], first + pairs[-1][0] + 1)
            w = words[first]
            useful -= inside[w] <= count[w]
            inside[w] -= 1
        if best:
            close()
        return out


def license_spans(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and spans: array of (license, coverage, first_word, end_word), for every row. A scan without shuffle."""
    scanner = Scanner(templates or TEMPLATES, threshold)
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("license", "coverage", "first_word", "end_word"), s)) for s in scanner.spans(t)] for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("id"), pa.array(found, pa.list_(span))], names=["id", "spans"])

    narrow = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return arrow_map(narrow, run, f"id {kind}, spans array<struct<license:string,coverage:double,first_word:long,end_word:long>>").withColumnRenamed("id", id_col)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = license_spans(read(spark, sf_dir, "documents", "doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct("spans.license")), ",")
    return spans.select("doc_id", F.size("spans").alias("n_spans"), names.alias("licenses"), F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)).alias("best_coverage"), F.array_min("spans.first_word").alias("first_word"))


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE_SQL: dict[str, str] = {}
