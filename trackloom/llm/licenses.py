"""License scans by patience alignment.

Words (runs of letters and digits, lower case) of a text are aligned with those of
each template: words that are unique in both are anchors, their longest increasing
subsequence is kept, and the gaps between anchors are aligned in the same way; a
gap without anchors falls back to a longest common subsequence.  Coverage is the
share of the template's words that are aligned.  A long text is looked at in
overlapping windows, so that repeated words elsewhere do not hide an anchor: of
twice the template first; where none of these reaches the coverage, of four times
it, eight times it and so on, up to the whole text.  In these wider windows words
count as one occurrence as long as at most GAP foreign words stand between
neighbours, so words that lie about in a long text make no license.

Windows are passed over only where coverage cannot be reached: a window must hold
enough words of the template, counted with repeats.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8
#: Foreign words between two neighbouring words of an occurrence that is spread over more than twice the template.
GAP = 8
# Notices and short texts of common licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words and their places in the text."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, ascending in both places; `pairs` ascend in the first."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists, as pairs of places."""
    number = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([number[w] for w in own], np.int32) for own in (a, b))
    table = np.zeros((len(a) + 1, len(b) + 1), np.uint16 if min(len(a), len(b)) < 1 << 16 else np.int32)
    for i in range(len(a) - 1, -1, -1):
        # The best that ends with word i or without it; a row never falls from right to left.
        best = np.maximum(table[i + 1, :-1], table[i + 1, 1:] + (y == x[i]))
        np.maximum.accumulate(best[::-1], out=table[i, -2::-1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of words of `a` aligned with places of the same words of `b`, both ascending."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        if i >= j or p >= q:
            continue
        count_a, count_b = Counter(a[i:j]), Counter(b[p:q])
        place = {b[k]: k for k in range(p, q) if count_b[b[k]] == 1}
        anchors = _longest_increasing([(k, place[a[k]]) for k in range(i, j) if count_a[a[k]] == 1 and a[k] in place])
        if anchors:
            out += anchors
            left, below = i, p
            for x, y in [*anchors, (j, q)]:
                todo.append((left, x, below, y))
                left, below = x + 1, y + 1
        elif count_a.keys() & count_b.keys():
            out += [(i + x, p + y) for x, y in _common(a[i:j], b[p:q])]
    return sorted(out)


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str], coverage: float):
        import ahocorasick

        self.coverage = coverage
        self.templates = {name: words_of(text)[0] for name, text in templates.items() if words_of(text)[0]}
        #: A text that reaches the coverage has one of a template's key words: all other words together are too few.
        self.keys = ahocorasick.Automaton()
        owners: dict[str, set[str]] = {}
        for name, own in self.templates.items():
            count, spare = Counter(own), len(own) - self.coverage * len(own)
            held = 0
            for word in sorted(count, key=lambda w: (-len(w), w)):
                owners.setdefault(word, set()).add(name)
                held += count[word]
                if held > spare + 1e-9:
                    break
        for word, names in owners.items():
            self.keys.add_word(word, names)
        self.keys.make_automaton()

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end): for each template at or over the coverage its best place, the first one in a tie."""
        wanted: set[str] = set()
        for _, names in self.keys.iter(text.lower()):
            wanted |= names
        if not wanted:
            return []
        words, spans = words_of(text)
        out = []
        for name in sorted(wanted):
            template = self.templates[name]
            need = self.coverage * len(template) - 1e-9
            count = Counter(template)
            marked = [k for k, w in enumerate(words) if w in count]
            if len(marked) < need:
                continue
            if sum((Counter(words[k] for k in marked) & count).values()) < need:
                continue
            best = self._dense(words, marked, template, count, need) or self._spread(words, marked, template, count, need)
            if best:
                out.append((name, best[0] / len(template), spans[best[1]][0], spans[best[2]][1]))
        return out


    def _dense(self, words: list[str], marked: list[int], template: list[str], count: Counter, need: float) -> tuple[int, int, int] | None:
        """(words, first, last) of the best window of twice the template."""
        best: tuple[int, int, int] | None = None
        width, step = 2 * len(template), max(1, len(template) // 2)
        seen = -1
        for k in marked:
            # Windows begin on a grid, at a word of the template or before it.
            start = k - k % step
            if start == seen:
                continue
            seen = start
            for begin in (max(0, start - step), start):
                part = words[begin : begin + width]
                if sum((Counter(w for w in part if w in count) & count).values()) < need:
                    continue
                pairs = align(part, template)
                if len(pairs) >= need and (best is None or len(pairs) > best[0]):
                    best = (len(pairs), begin + pairs[0][0], begin + pairs[-1][0])
            if best and best[0] == len(template):
                break
        return best

    def _spread(self, words: list[str], marked: list[int], template: list[str], count: Counter, need: float) -> tuple[int, int, int] | None:
        """The same over ever wider windows, for words with at most GAP others between neighbours; wider windows are looked at as long as they show more."""
        width, best = 4 * len(template), None
        while True:
            before = best
            for begin in range(0, len(words), width // 2):
                # Only words of the template can be aligned.
                own = marked[bisect_left(marked, begin) : bisect_left(marked, begin + width)]
                part = [words[k] for k in own]
                if len(part) < need or sum((Counter(part) & count).values()) < need:
                    continue
                places = [own[i] for i, _ in align(part, template)]
                first = 0
                for k in range(1, len(places) + 1):
                    if k == len(places) or places[k] - places[k - 1] > GAP + 1:
                        if k - first >= need and (best is None or k - first > best[0]):
                            best = (k - first, places[first], places[k - 1])
                        first = k
            if best and best == before or width >= 2 * len(words):
                return best
            width *= 2


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        for batch in batches:
            rows = [(i, *hit) for i, text in enumerate(batch.column("text").to_pylist()) if text for hit in scanner.scan(text)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                "license": pa.array([r[1] for r in rows], pa.string()),
                "coverage": pa.array([r[2] for r in rows], pa.float64()),
                "start": pa.array([r[3] for r in rows], pa.int64()),
                "end": pa.array([r[4] for r in rows], pa.int64()),
            })

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, start, end): the templates found in each whole text.

    `start` and `end` are code points of the best place, the first one in a tie.
    Null and empty texts have none; repeated rows give repeated results; rows
    without an id keep a null id.  Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((templates or TEMPLATES, coverage))
    need = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return need.mapInArrow(_scan(shared), "doc_id long, license string, coverage double, start long, end long")
