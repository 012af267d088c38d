"""Licence scan by Dice coefficient over word bigrams.

Lines of a text, and the text as a whole, are normalised (lower case,
letters and digits only) and compared with normalised licence templates:
Dice = 2 |A and B| / (|A| + |B|) over the sets of word bigrams. A Dice of at
least t needs |A| between t / (2 - t) and (2 - t) / t times |B|, so a segment
only meets the templates of its size, and most lines meet none.

A notice may also be wrapped over lines or stand inside a longer line. So
windows of the word sequence, across line ends, are segments too. Only windows
that begin and end with a bigram of the template are tried: any other has a
shorter one that is no worse. A line that matches is not searched inside, and a
line or text that has the size of a template is judged as it stands, without
windows inside it for that template; else every near miss would be cut down to
a match. Of windows that overlap, n_segments counts the one that shares most
with its template, unless it holds words of a line that counts already. A
sentence that two licences share counts for the one it is listed under, until
the rest of the text tells them apart.

Defined results: null or empty text, and text without a matching segment,
has null licence, score 0.0 and 0 segments; equal scores go to the smaller
licence name; rows that repeat are scanned alike. Segments of one word have
no bigram and match nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import narrow

THRESHOLD = 0.8
#: Licence templates: notices, identifiers, and the texts of short licences (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)


def normalised(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    w = normalised(text)
    return sorted({f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)})


def _least(m: int, threshold: float) -> int:
    """Bigrams that a match shares with a template of m."""
    return math.ceil(m * threshold / (2 - threshold) - 1e-9)


class Matcher:
    """Finds the segments of a text that match a template."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold, self.templates = threshold, []
        self.known: dict[tuple[str, str], list[int]] = {}
        for name, text in templates:
            w = normalised(text)
            own = set(zip(w[:-1], w[1:], strict=True))
            if not own:
                continue
            for g in own:
                self.known.setdefault(g, []).append(len(self.templates))
            # name, bigrams, least shared, sizes, bigrams of the longest window with repeats
            low, high = threshold / (2 - threshold) * len(own) - 1e-9, (2 - threshold) / threshold * len(own) + 1e-9
            self.templates.append((name, own, _least(len(own), threshold), low, high, int((2 - threshold) / threshold * (len(w) - 1) + 1e-9)))
        self.least = min((t[2] for t in self.templates), default=0)
        self.high = max((t[4] for t in self.templates), default=0)

    def _compared(self, grams: set) -> tuple[list[tuple[float, str]], list[int]]:
        """(score, name) of the templates that the segment matches, and the templates of its size."""
        fits = [k for k, t in enumerate(self.templates) if t[3] <= len(grams) <= t[4]]
        scores = [(2.0 * len(grams & self.templates[k][1]) / (len(grams) + len(self.templates[k][1])), self.templates[k][0]) for k in fits]
        return [x for x in scores if x[0] >= self.threshold], fits

    def _windows(self, k: int, at: list[int], pairs: list[tuple[str, str]], line: list[int], judged: set[int]):
        """(score, shared bigrams, first, last bigram) of the best matching window from each of the places `at` of the template's bigrams; none within a judged line."""
        _, own, least, _, high, longest = self.templates[k]
        for i in range(len(at) - least + 1):
            a = at[i]
            if at[i + least - 1] - a >= longest:
                continue
            best, seen, shared, within = None, set(), 0, line[a] in judged
            for b in range(a, min(a + longest, len(pairs))):
                g = pairs[b]
                if g not in seen:
                    seen.add(g)
                    shared += g in own
                    if len(seen) > high:
                        break
                if g in own and not (within and line[b + 1] == line[a]):
                    score = 2.0 * shared / (len(seen) + len(own))
                    if score >= self.threshold and (best is None or score >= best[0]):  # a repeated bigram of the template belongs to it
                        best = (score, shared, a, b)
            if best:
                yield best

    def __call__(self, text: str) -> tuple[list[tuple[float, str]], int]:
        """(score, name) of every match, and the number of matching segments."""
        places, n = self.places(text)
        return sorted({x[:2] for x in places}), n

    def places(self, text: str) -> tuple[list[tuple[float, str, int, int]], int]:
        """(score, name, first, last word) of every match, words of letters and digits counted from 0, and the number of matching segments."""
        lines = text.split("\n")
        words, line = [], []
        for n, own in enumerate(map(normalised, lines)):
            words += own
            line += [n] * len(own)
        pairs = list(zip(words[:-1], words[1:], strict=True))
        hits = [i for i, g in enumerate(pairs) if g in self.known]
        if not self.least or len(hits) < self.least:
            return [], 0
        found, n, judged, matched = [], 0, {}, set()
        within: dict[int, int] = {}
        for i in hits:
            if line[i] == line[i + 1]:
                within[line[i]] = within.get(line[i], 0) + 1
        for own in (x for x, count in within.items() if count >= self.least):
            a, b = bisect_left(line, own), bisect_right(line, own)
            got, judged[own] = self._compared(set(pairs[a : b - 1]))
            if got:
                found += [(*x, a, b - 1) for x in got]
                n += 1
                matched.add(own)
        whole: list[int] = []
        if len(lines) > 1 and len(grams := set(pairs)) <= self.high:
            got, whole = self._compared(grams)
            found += [(*x, 0, len(words) - 1) for x in got]
            n += bool(got)
        at: dict[int, list[int]] = {}
        for i in hits:
            for k in self.known[pairs[i]]:
                at.setdefault(k, []).append(i)
        windows = []
        for k, places in at.items():
            if k not in whole and len(places) >= self.templates[k][2]:
                own = matched | {x for x, fits in judged.items() if k in fits}
                windows += [(*x, self.templates[k][0]) for x in self._windows(k, places, pairs, line, own)]
        taken: list[tuple[int, int]] = []
        for _, _, a, b, _ in sorted(windows, key=lambda x: (-x[1], -x[0], x[2])):
            i = bisect_left(taken, (a, b))
            if (i == 0 or taken[i - 1][1] < a - 1) and (i == len(taken) or taken[i][0] > b + 1):
                taken.insert(i, (a, b))
                n += matched.isdisjoint(line[a : b + 2])  # else its line counts already
        return sorted({*found, *((x[0], x[4], x[2], x[3] + 1) for x in windows)}), n


def _scanned(templates: tuple[tuple[str, str], ...], threshold: float):
    def run(batches):
        match = Matcher(templates, threshold)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("name", pa.string())]))
        for batch in batches:
            got = [match(t or "") for t in batch.column("text").to_pylist()]
            hits = pa.array([[{"score": s, "name": n} for s, n in found] for found, _ in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), hits, pa.array([n for _, n in got], pa.int64())], names=["doc_id", "_f", "n_segments"])

    return run


def _placed(templates: tuple[tuple[str, str], ...], threshold: float):
    def run(batches):
        match = Matcher(templates, threshold)
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in match.places(t or "")[0]]
            ids, scores, names, first, last = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc_id", "licence", "score", "first_word", "last_word"])

    return run


def spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, score, first_word, last_word: one row for each match, overlapping ones included."""
    return narrow(docs).mapInArrow(_placed(templates, threshold), "doc_id long, licence string, score double, first_word long, last_word long")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, score, n_segments: one row for each row of docs."""
    rows = narrow(docs).mapInArrow(_scanned(templates, threshold), "doc_id long, _f array<struct<score: double, name: string>>, n_segments long")
    score = F.round(F.coalesce(F.array_max(F.transform("_f", lambda x: x["score"])), F.lit(0.0)), 6)
    named = F.array_min(F.transform(F.filter("_f", lambda x: F.round(x["score"], 6) == F.col("score")), lambda x: x["name"]))
    return rows.withColumn("score", score).select("doc_id", named.alias("licence"), "score", "n_segments")


def sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over a view `documents`, every segment but the windows against every template."""
    rows = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{g}'" for g in bigrams(text))) for name, text in templates)
    return f"""
WITH t(name, b) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(l) > 1 THEN list_concat(list_transform(range(1, len(l) + 1), lambda i: {{'i': i, 's': l[i]}}), [{{'i': 0, 's': t}}]) ELSE [{{'i': 1, 's': t}}] END) AS x FROM d),
w AS (SELECT doc_id, x.i AS i, string_split(trim(regexp_replace(lower(x.s), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT doc_id, i, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k+1])) AS g FROM w WHERE len(w) >= 2),
m AS (SELECT doc_id, i, name, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS score FROM g, t WHERE len(list_intersect(g, b)) > 0),
k AS (SELECT doc_id, i, name, round(score, 6) AS score FROM m WHERE score >= {threshold}),
b AS (SELECT doc_id, max(score) AS score, CAST(count(DISTINCT i) AS BIGINT) AS n_segments FROM k GROUP BY doc_id)
SELECT d.doc_id, (SELECT min(name) FROM k WHERE k.doc_id = d.doc_id AND k.score = b.score) AS licence, coalesce(b.score, 0.0) AS score, coalesce(b.n_segments, 0) AS n_segments
FROM d LEFT JOIN b ON b.doc_id = d.doc_id
"""
