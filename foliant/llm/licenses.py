"""License scans: patience alignment of texts with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import batches, texts
from foliant.llm.latent import plain

#: A license is found where so much of a template's words is aligned.
COVERAGE = 0.8
#: Public license notices and texts, by identifier.
TEMPLATES = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies."""),
    ("GPL-3.0", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("BSD-2-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
)
#: Words that don't make a window worth an alignment.
COMMON = frozenset(b"a an and any are as at be by for in is it not of on or that the this to with you".split())


def rising(places: list[int]) -> list[int]:
    """Positions, in ``places``, of a longest strictly rising subsequence: patience piles with links back."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        pile = bisect_left(tops, p)
        back.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(p)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = p, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words: equal ends, then words unique to both sides in rising order, then the gaps between them in turn."""
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        shared = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        anchors = [shared[i] for i in rising([j for _, j in shared])]
        if not anchors:
            continue
        out += anchors
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if i0 + 1 < i1 and j0 + 1 < j1:
                waiting.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(out)


class Scanner:
    def __init__(self, templates, least: float) -> None:
        self.least = least
        self.names = [(name, form) for name, form, _ in templates]
        self.words = [plain(text.encode()) for _, _, text in templates]
        every = sorted({w for words in self.words for w in words if w not in COMMON})
        self.ids = {w: i for i, w in enumerate(every)}
        self.of = np.zeros((len(templates), len(every)), bool)
        for t, words in enumerate(self.words):
            self.of[t, [self.ids[w] for w in words if w in self.ids]] = True
        self.need = [max(1, int(sum(w in self.ids for w in words) * (least - (1 - least)))) for words in self.words]

    def scan(self, text: bytes) -> list[tuple[int, float, int, int]]:
        """(template, coverage, first word, end) of the best place of each template that reaches the least coverage.

        All places of all templates are settled, the best covered first, the longest template of equals; a window that has
        words of a settled place is aligned again in the parts between. The best place left to a template is reported.
        """
        words = plain(text)
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        waiting: list[tuple] = []
        kinds = ids[at]

        def place(t: int, a: int, b: int) -> None:
            own = self.words[t]
            pairs = aligned(own, words[a:b])
            if pairs and len(pairs) >= self.least * len(own):
                heappush(waiting, (-len(pairs) / len(own), -len(own), t, a, b, a + pairs[0][1], a + pairs[-1][1] + 1))

        for t, own in enumerate(self.words):
            hits = at[self.of[t, kinds]]
            if len(hits) < self.need[t]:
                continue
            n = len(own)
            # Windows of twice the template, one template apart, hold any place of the template's length; those of three
            # times hold any that other words have made twice as long. In the short ones fewer words stand twice.
            for start in sorted({max(0, h - back) for h in np.unique(hits // n).tolist() for back in range(3)}):
                a, held = start * n, 0
                for b in (a + 2 * n, a + 3 * n):
                    found = int(np.searchsorted(hits, b) - np.searchsorted(hits, a))
                    if found >= self.need[t] and found > held:
                        place(t, a, min(b, len(words)))
                        held = found
        best: dict[int, tuple[int, float, int, int]] = {}
        taken: list[tuple[int, int]] = []  # in rising order, apart
        while waiting:
            less, _, t, a, b, first, end = heappop(waiting)
            i = bisect_left(taken, (first, first))
            if (i == len(taken) or taken[i][0] >= end) and (i == 0 or taken[i - 1][1] <= first):
                taken.insert(i, (first, end))
                best.setdefault(t, (t, -less, first, end))
            i = bisect_left(taken, (a, a))
            for x, y in [*taken[max(0, i - 1) : bisect_left(taken, (b, b))], (b, b)]:
                if x - a >= self.least * len(self.words[t]):
                    place(t, a, x)
                a = max(a, y)
        return sorted(best.values())


def licenses(docs: DataFrame, templates=TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """``doc_id, license, form, coverage, first_word, end_word``: a row for each row of ``docs`` and each template found in it.

    Coverage is the part of the template's words that patience alignment finds in the best place that no better template has. Texts are read
    whole; null and empty texts have no license; repeated rows give the same rows each, rows that share a doc_id stay apart, and an
    empty table gives an empty result. Of places that are equally well covered the longer template's counts, then the first template's and
    the first place. Other columns aren't read. Templates are few and travel with the function; no row moves between tasks.
    """
    batches(docs.sparkSession)
    templates = tuple(templates)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in parts:
            rows = [(i, *f) for i, text in enumerate(texts(batch)) for f in scanner.scan(text)]
            names = [scanner.names[r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([n for n, _ in names], pa.string()), pa.array([f for _, f in names], pa.string()),
                 pa.array([round(r[2], 4) for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                ["doc_id", "license", "form", "coverage", "first_word", "end_word"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, form string, coverage double, first_word long, end_word long")
