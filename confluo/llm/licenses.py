"""License scans by patience alignment with license texts and notices."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm._base import LOWER, bound_batches, rolling_hash, slices, text_bytes, word_hashes, word_spans

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS '
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: License notices and texts as published by their stewards (fixed values); long ones lie in the folder licenses_data.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        'appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": f"{_BSD} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD} {_BSD_THIRD} {_BSD_DISCLAIMER}",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    **{p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).resolve().parent / "licenses_data").glob("*.txt"))},
}
#: All bytes that end a word, once A-Z are in lower case.
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False
_GRAM = 2


def _words(text: str) -> list[bytes]:
    return [w for w in bytes(32 if _BREAK[c] else c for c in text.encode().translate(LOWER.tobytes())).split(b" ") if w]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places that align a with b.

    Words found once in each are anchors; the longest increasing subsequence of them stands, and the gaps between are
    aligned in the same way. A gap without anchors gives what it shares at its start and its end.
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
        if a0 == a1 or b0 == b1:
            continue
        places: dict = {}
        for side, words, lo, hi in ((0, a, a0, a1), (1, b, b0, b1)):
            for i in range(lo, hi):
                places.setdefault(words[i], ([], []))[side].append(i)
        pairs = sorted((p[0][0], p[1][0]) for p in places.values() if len(p[0]) == len(p[1]) == 1)
        if not pairs:
            continue
        tails, last, before = [], [], [-1] * len(pairs)  # longest run of pairs that increases on both sides
        for i, (_, y) in enumerate(pairs):
            at = bisect_left(tails, y)
            before[i] = last[at - 1] if at else -1
            tails[at : at + 1] = [y]
            last[at : at + 1] = [i]
        chain, i = [], last[-1]
        while i >= 0:
            chain.append(pairs[i])
            i = before[i]
        chain.reverse()
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _scan(templates: dict[str, list[bytes]], least: float):
    names = list(templates)
    grams: dict[int, dict[int, list[int]]] = {}  # places in each template
    for t, words in enumerate(templates.values()):
        data = np.frombuffer(b" ".join(words), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        for q, h in enumerate(rolling_hash(word_hashes(data, starts, ends), min(_GRAM, len(words))).tolist()):
            grams.setdefault(h, {}).setdefault(t, []).append(q)
    known = np.array(sorted(grams), np.uint64)

    def stretches(words: list[bytes], t: int, at: list[int], shifts: list[list[int]], lo: int, hi: int):
        """Alignments with a template in [lo, hi) that don't overlap, best coverage first; then those of the places left between them.

        at: places of shared word pairs, in order; shifts: where the template would start, by each of its places with that pair.
        """
        template, size = templates[names[t]], len(templates[names[t]])
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            x, y = bisect_left(at, lo), bisect_left(at, hi)
            # enough pairs and words to cover what it must of the template
            if (y - x) * (_GRAM + 1) < least * size / 2 or hi - lo < least * size:
                continue
            votes = Counter(d for ds in shifts[x:y] for d in ds)
            windows = {(s, min(hi, s + 3 * size)) for s in range(lo, max(lo + 1, hi - size), size)}
            windows |= {(max(lo, d - slack), min(hi, d + size + slack)) for d, n in votes.items() if 16 * n >= least * size for slack in (0, size // 4, size)}
            made = []
            for s, e in windows:
                if e - s >= least * size:
                    pairs = patience(words[s:e], template)
                    if len(pairs) >= least * size:
                        made.append((-len(pairs) / size, pairs[-1][0] - pairs[0][0], s + pairs[0][0], s + pairs[-1][0] + 1))
            taken: list[tuple[int, int]] = []
            for coverage, _, start, end in sorted(made):
                i = bisect_left(taken, (start, end))
                if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                    insort(taken, (start, end))
                    yield {"license": names[t], "coverage": -coverage, "start": start, "end": end}
            if taken:
                todo += [(a, b) for (_, a), (b, _) in zip([(lo, lo), *taken], [*taken, (hi, hi)], strict=True)]

    def found(words: list[bytes], hits: list[tuple[int, int, list[int]]]) -> list[dict]:
        """hits: (place, template, places in it) of shared word pairs of one text, in order."""
        out, by = [], {}
        for p, t, qs in hits:
            at, shifts = by.setdefault(t, ([], []))
            at.append(p)
            shifts.append([p - q for q in qs])
        for t in sorted(by):
            size, (at, shifts) = len(templates[names[t]]), by[t]
            i = free = 0
            while i < len(at):
                j = i
                while j + 1 < len(at) and at[j + 1] - at[j] <= size:
                    j += 1
                # the cluster covers what it can of the template only if it has enough pairs
                if (j - i + 1) * (_GRAM + 1) >= least * size / 2:
                    hi = min(len(words), at[j] + size, at[j + 1] if j + 1 < len(at) else len(words))
                    some = list(stretches(words, t, at, shifts, max(free, at[i] - size), hi))
                    free = max([free, *(x["end"] for x in some)])
                    out += some
                i = j + 1
        return sorted(out, key=lambda x: (-x["coverage"], -len(templates[x["license"]]), x["license"], x["start"]))

    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    @arrow_udf("array<struct<license string, coverage double, start bigint, end bigint>>")
    def run(col: pa.Array) -> pa.Array:
        parts = []
        for batch in slices([pa.RecordBatch.from_arrays([col], names=["text"])]):
            data, off = text_bytes(batch.column(0))
            data = LOWER[data]
            starts, ends, first = word_spans(data, off, _BREAK)
            g = rolling_hash(word_hashes(data, starts, ends), _GRAM)
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g) if len(g) else np.zeros(0, np.int64)
            doc = np.searchsorted(first, hit, "right") - 1
            inside = hit + _GRAM <= first[doc + 1]
            by: dict[int, list] = {}
            for d, p, h in zip(doc[inside].tolist(), hit[inside].tolist(), g[hit[inside]].tolist(), strict=True):
                by.setdefault(d, []).extend((p - int(first[d]), t, qs) for t, qs in grams[h].items())
            out = [[] for _ in range(len(batch))]
            raw = data.tobytes()
            for d, hits in by.items():
                out[d] = found([raw[x:y] for x, y in zip(starts[first[d] : first[d + 1]].tolist(), ends[first[d] : first[d + 1]].tolist(), strict=True)], hits)
            parts.append(pa.array(out, kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.75) -> DataFrame:
    """The columns of docs with ``licenses``: array of (license, coverage, start, end), best coverage first, longer templates before shorter.

    docs: ``text`` and any other columns. Words are runs of letters and digits once A-Z are in lower case. Wherever word pairs of a template
    occur, the stretch around them is aligned with it, and each alignment that overlaps no better one of the same template is given; coverage is the share of the template's words that align, and ``least`` of them must.
    start and end are word places. templates: texts by name, sent to the tasks.

    Null and empty texts have none. Rows are scanned one by one, so repeated rows and null ids don't matter. A column named licenses is replaced.
    """
    bound_batches(docs.sparkSession)
    made = {k: _words(v) for k, v in (templates or TEMPLATES).items()}
    made = {k: v for k, v in made.items() if len(v) >= _GRAM}
    if not made:
        return docs.withColumn("licenses", F.array().cast("array<struct<license string, coverage double, start bigint, end bigint>>"))
    return docs.withColumn("licenses", _scan(made, least)(F.coalesce(F.col("text"), F.lit(""))))
