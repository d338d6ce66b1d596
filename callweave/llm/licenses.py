"""License scans by patience alignment.

A template is a word sequence. A text is aligned to it by anchors: words that occur once in either; the longest
increasing subsequence of their places keeps those in common order, and the gaps between neighbours are aligned in the
same way until no anchor is left. What is left of a gap counts by the matching words at its two ends. The coverage is
the share of the template's words that are aligned.

Alignment happens inside windows: a template's rare words mark the places of a text where it can stand, and marks
within the template's length of each other share a window. All places apart are reported; a place may span twice the
template's length at most, and one within a place with more aligned words is part of that. A text that holds none of the marks of any template can't
reach the threshold (a template has more marks than it may miss words), so the scan skips it where it is read.

Edge cases: a null or empty text holds no license; repeated rows are judged one by one; of equally likely
places that overlap the first counts; a very long text is held whole by one task; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import map_arrow, slices

THRESHOLD = 0.8
#: Notices by which a text states its license.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
_word = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, rising in both places, of ``pairs`` that rise in the first (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
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


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """The aligned places (in text, in template), in order."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        n, m = Counter(text[a:b]), Counter(template[c:d])
        at = {w: k for k, w in enumerate(template[c:d], c) if m[w] == 1}
        anchors = _rising([(k, at[w]) for k, w in enumerate(text[a:b], a) if n[w] == 1 and w in at])
        if anchors:
            out.extend(anchors)
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            todo.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold, self.templates = threshold, {k: words(t) for k, t in templates.items()}
        n = Counter(w for t in self.templates.values() for w in set(t))
        #: Of each template more marks than words that it may miss: its longest words that few templates share.
        self.marks = {}
        for k, t in self.templates.items():
            may_miss, marks, held = len(t) - threshold * len(t), set(), 0
            for w in sorted(set(t), key=lambda w: (n[w] > 6, -len(w), w)):
                if held > may_miss:
                    break
                marks.add(w)
                held += t.count(w)
            self.marks[k] = marks

    def pattern(self) -> str:
        """A regular expression that every text with a license matches."""
        return r"(?iU)\b(?:" + "|".join(sorted({w for m in self.marks.values() for w in m})) + r")\b"

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """[(license, coverage, first word, end word)] of all places in a whole text, by name and place."""
        w = words(text)
        places: dict[str, list[int]] = {}
        every = set().union(*self.marks.values()) if self.marks else set()
        for i, x in enumerate(w):
            if x in every:
                places.setdefault(x, []).append(i)
        found = []
        for name, t in self.templates.items():
            spots = sorted(i for m in self.marks[name] for i in places.get(m, ()))
            at = 0
            while at < len(spots):
                n = at + 1
                while n < len(spots) and spots[n] - spots[n - 1] <= len(t):
                    n += 1
                lo, hi = max(0, spots[at] - len(t)), min(len(w), spots[n - 1] + len(t) + 1)
                found += [(name, k / len(t), first, end) for first, end, k in self._found(w, lo, hi, t, self.marks[name])]
                at = n
        # what lies within the place of one with more aligned words, or of equally many a greater coverage, is part of it
        held, out = sorted(found, key=lambda f: (-round(f[1] * len(self.templates[f[0]])), -f[1], f[2], f[0])), []
        spans: list[tuple[int, int]] = []  # apart and in order
        for f in held:
            k = bisect_left(spans, (f[2] + 1,)) - 1
            if k >= 0 and spans[k][1] >= f[3]:
                continue
            out.append(f)
            k += 1
            if (k == 0 or spans[k - 1][1] <= f[2]) and (k == len(spans) or spans[k][0] >= f[3]):
                spans.insert(k, (f[2], f[3]))
        return sorted(out, key=lambda f: (f[0], f[2]))

    def _found(self, w: list[str], lo: int, hi: int, t: list[str], marks: set[str]) -> Iterator[tuple[int, int, int]]:
        """(first word, end word, aligned words) of the places apart in w[lo:hi] where the template reaches the threshold."""
        size, need = len(t), Counter(t)
        least = self.threshold * size
        if sum(min(n, need[x]) for x, n in Counter(w[lo:hi]).items() if x in need) < least:
            return
        used = bytearray(hi - lo)

        def tried(a: int, b: int) -> tuple[int, int, int] | None:
            pairs = align(w[a:b], t)
            if len(pairs) < least:
                return None
            first, end = a + pairs[0][0], a + pairs[-1][0] + 1
            return None if end - first > 2 * size or any(used[first - lo : end - lo]) else (first, end, len(pairs))

        def taken(got: tuple[int, int, int]) -> tuple[int, int, int]:
            used[got[0] - lo : got[1] - lo] = b"\1" * (got[1] - got[0])
            return got

        if hi - lo <= 4 * size and (got := tried(lo, hi)):
            yield taken(got)
        # A text that states it several times has no unique words: one place at a time, the likeliest first, as long as
        # the template and then twice that.
        starts: dict[str, list[int]] = {}
        for k, x in enumerate(t):
            if x in marks:
                starts.setdefault(x, []).append(k)
        votes = Counter(i - k for i in range(lo, hi) if w[i] in starts for k in starts[w[i]])
        for start, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            a = max(lo, start)
            if used[min(a - lo + size // 2, len(used) - 1)]:
                continue
            if got := tried(a, min(hi, start + size)) or tried(max(lo, a - size // 2), min(hi, start + size + size // 2)):
                yield taken(got)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word): the licenses that each whole text states."""
    scanner = Scanner(TEMPLATES if templates is None else templates, threshold)
    likely = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text).alias("t"))
    likely = likely.where(F.col("t").rlike(scanner.pattern())) if scanner.templates else likely.where("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 4 << 20):
            at, rows = [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                for found in scanner.scan(t):
                    at.append(i)
                    rows.append(found)
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("i").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "license", "coverage", "first_word", "end_word"],
            )

    return map_arrow(likely, run, "doc_id long, license string, coverage double, first_word long, end_word long")


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs)
