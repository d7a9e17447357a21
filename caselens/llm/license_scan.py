"""License scans by patience alignment.

A template is found where the alignment of its words with the words of a stretch
of text covers enough of them.  Words that stand once in both are anchors; the
longest increasing subsequence of their places is kept, and the gaps between
them are aligned in the same way, down to gaps without anchors, whose equal
beginnings and ends are taken.  A match as long as ``MIN_DENSITY`` allows lies
whole in one of the windows, which start a quarter of a template's length apart
and also where the template would start if a word of the text is one of its
first ones (so copies in a row are found one by one).  What lies beside a match
is aligned again.  A window is aligned only if it holds a signal word of the
template: its longest words, so many that the other words could not reach the
coverage by themselves, so nothing that could match is left out.

``MIN_COVERAGE`` is the least covered share of the template's words, and
``MIN_DENSITY`` the least share of matched words in the stretch from the first
to the last of them.  Numbers of a notice (its version) and the words of
``MARKS`` tell licenses apart: those of the template must be matched, and a mark
that the template does not have must not stand in the stretch.  Of overlapping
matches, whatever their templates, the one with the most matched words is kept.

Defined cases: null and empty texts have no licenses; templates without words
are never found; equal rows are scanned and returned each; other columns are
ignored.  Places are code points, ends exclusive.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import ALNUM, LOWER, Chunk, chunks, rolling_prefix, span_hash

MIN_COVERAGE = 0.8
MIN_DENSITY = 0.6
#: words that tell one license of a family from another
MARKS = ("nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike", "lesser", "library", "affero")
#: versions count as marks in templates of so many words at most
NOTICE_WORDS = 110

# Public license texts and notices (first paragraphs of the long ones), placeholders left out.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "MIT-notice": "Released under the MIT License",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "LGPL-3.0-notice": "licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1-notice": "licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0-notice": "licensed under the GNU Affero General Public License, version 3",
    "EPL-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0",
    "GPL-3.0-notice": "licensed under the GNU General Public License, version 3",
    "GPL-2.0-notice": "licensed under the GNU General Public License, version 2",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "All-rights-reserved": "All rights reserved",
}


# -- alignment ------------------------------------------------------------


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for k, value in enumerate(values):
        at = bisect_left(tops, value)
        if at:
            before[k] = piles[at - 1]
        tops[at : at + 1] = [value]
        piles[at : at + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Increasing pairs of places of equal words, by patience alignment."""
    pairs: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {word: k for k, word in enumerate(b[b0:b1], b0) if right[word] == 1}
        both = [(k, place[word]) for k, word in enumerate(a[a0:a1], a0) if left[word] == 1 and word in place]
        anchors = [both[k] for k in longest_increasing([y for _, y in both])]
        if not anchors:
            continue
        pairs += anchors
        x0, y0 = a0, b0
        for x, y in [*anchors, (a1, b1)]:
            work.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
    return sorted(pairs)


@dataclass
class Template:
    name: str
    words: list[int]
    signals: set[int]
    marks: set[int]  # words that must be matched
    others: set[int]  # words that must not stand in the stretch


def _hashed(text: str) -> tuple[list[int], list[int], list[str]]:
    """Hash, length and text of each word."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    starts, ends, _ = Chunk(data, np.array([0, len(data)]), 0).words(ALNUM)
    words = span_hash(rolling_prefix(data), starts, ends, data).tolist()
    return words, (ends - starts).tolist(), [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]


_MARKS = set(_hashed(" ".join(MARKS))[0])


def template(name: str, text: str, coverage: float = MIN_COVERAGE) -> Template:
    words, lengths, spelt = _hashed(text)
    size = dict(zip(words, lengths, strict=True))
    left, signals = Counter(words), set()
    for word in sorted(size, key=lambda w: (-size[w], w)):
        if sum(left.values()) < coverage * len(words):
            break
        signals.add(word)
        del left[word]
    versions = {w for w, x in zip(words, spelt, strict=True) if x.isdigit()} if len(words) <= NOTICE_WORDS else set()
    marks = {w for w in words if w in _MARKS}
    return Template(name, words, signals, marks | versions, _MARKS - marks)


def _match(words: list[int], a: int, b: int, t: Template, coverage: float, density: float) -> tuple[int, int, int] | None:
    """First word, end word and matched words of a match of the template in ``words[a:b]``."""
    m, window = len(t.words), words[a:b]
    if len(window) < coverage * m or sum((Counter(window) & Counter(t.words)).values()) < coverage * m:
        return None
    pairs = align(t.words, window)
    if len(pairs) < coverage * m or len(pairs) < density * (pairs[-1][1] + 1 - pairs[0][1]):
        return None
    if Counter(w for w in t.words if w in t.marks) != Counter(t.words[x] for x, _ in pairs if t.words[x] in t.marks):
        return None
    first, end = pairs[0][1], pairs[-1][1] + 1
    if t.others.intersection(window[first:end]):
        return None
    return a + first, a + end, len(pairs)


def _apart(found: list[tuple]) -> list[tuple]:
    """Of overlapping matches (first word, end word, matched words, ...) those with the most matched words, in order."""
    kept: list[tuple] = []
    for match in sorted(set(found), key=lambda f: (-f[2], f[1] - f[0], *f)):
        at = bisect_left(kept, match[:1])
        if (at == len(kept) or kept[at][0] >= match[1]) and (at == 0 or kept[at - 1][1] <= match[0]):
            kept.insert(at, match)
    return kept


def find(words: list[int], at: list[int], t: Template, coverage: float, density: float) -> list[tuple[int, int, int]]:
    """Matches of a template in a document's words, as (first word, end word, matched words); ``at`` has the places of its signal words."""
    m, n = len(t.words), len(words)
    step, longest = max(1, m // 4), int(m / density) + 1
    length = longest + step
    firsts: dict[int, list[int]] = {}
    for k, word in enumerate(t.words[: m - int(-(-coverage * m // 1)) + 1]):  # one of them is matched, or too few are
        firsts.setdefault(word, []).append(k)
    starts, grid = set(), set()
    for p in at:  # windows that hold a signal word
        low = max(0, p - length + 1)
        grid.update(range(low // step, p // step + 1))
    for k in sorted(grid):
        base = k * step
        starts.add(base)
        for p in range(base, min(n, base + step)):
            starts.update(p - x for x in firsts.get(words[p], ()) if p >= x)
    found: list[tuple[int, int, int]] = []
    for base in sorted(starts):
        if match := _match(words, base, min(n, base + length), t, coverage, density):
            found.append(match)
    kept = _apart(found)
    for a, b in zip([0, *(e for _, e, _ in kept)], [*(s for s, _, _ in kept), n], strict=True):  # beside the matches
        for base in sorted({a, *(s for s in starts if a < s < b)}) if kept and b - a >= coverage * m else ():
            if match := _match(words, base, min(b, base + length), t, coverage, density):
                found.append(match)
    return _apart(found)


# -- the operator ---------------------------------------------------------


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = MIN_COVERAGE, density: float = MIN_DENSITY) -> DataFrame:
    """``doc_id, licenses array<struct<name,start,end,coverage>>`` of every row, by start, then name."""
    known = [t for t in (template(n, x, coverage) for n, x in (templates or TEMPLATES).items()) if t.words]
    signals = np.array(sorted(set().union(*(t.signals for t in known))), np.uint64)
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                low = LOWER[chunk.data]
                starts, ends, at = Chunk(low, chunk.off, chunk.first).words(ALNUM)
                hashes = span_hash(rolling_prefix(low), starts, ends, low)
                out: list[list] = [[] for _ in range(len(chunk))]
                if len(hashes) and len(signals):
                    place = np.minimum(np.searchsorted(signals, hashes), len(signals) - 1)
                    hits = np.flatnonzero(signals[place] == hashes)
                    owner = np.searchsorted(at, hits, "right") - 1
                    for d in np.unique(owner).tolist():
                        own = hashes[at[d] : at[d + 1]].tolist()
                        where = (hits[owner == d] - at[d]).tolist()
                        base = int(chunk.off[d])
                        matches = []
                        for t in known:
                            mine = [p for p in where if own[p] in t.signals]
                            matches += [(*match, t.name, match[2] / len(t.words)) for match in find(own, mine, t, coverage, density)] if mine else []
                        if not matches:
                            continue
                        chars = np.concatenate(([0], np.cumsum((chunk.data[base : chunk.off[d + 1]] & 0xC0) != 0x80)))
                        for first, end, _, name, share in _apart(matches):
                            span = starts[at[d] + first] - base, ends[at[d] + end - 1] - base
                            out[d].append({"name": name, "start": int(chars[span[0]]), "end": int(chars[span[1]]), "coverage": share})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(out, kind)], ["doc_id", "licenses"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, licenses array<struct<name:string,start:long,end:long,coverage:double>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    tell = lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", F.transform("licenses", tell)).alias("licenses"),
        F.round(F.array_max(F.transform("licenses", lambda x: x["coverage"])), 6).alias("best_coverage"),
    )


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLE_SQL: dict[str, str] = {}
