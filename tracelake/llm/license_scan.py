"""License scan by patience alignment.

Where a text holds enough of a template's words, each as often as there, within ``SPREAD`` times
its length or ``NEAR`` words, that span and the template are aligned: words unique to both are
anchors, the longest increasing run of anchors stays, and the gaps between them are aligned again
the same way. Templates of ``LONG`` words or more are also aligned with the whole text. The share
of the template's words that the alignment reaches is its coverage. Every copy of every template
is listed.

Defined cases: null and empty texts hold no license; of templates with equal coverage the
longer one wins, then the first by name; repeated rows stay repeated; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, read
from tracelake.llm.textops import PLAIN, Words, slices, texts_of

COVERAGE = 0.8
#: A copy is looked for in so many times its template's length, or in so many words if that is more.
SPREAD, NEAR = 3, 40
#: Templates of so many words are also aligned with the whole text, however far their words lie apart; shorter ones would be found in any long text.
LONG = 20

# fixed values: wording of public licenses and notices; # stands for any one word
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version #.#",
    "CC-BY-NC-notice": "Licensed under CC BY-NC #.#",
    "CC-BY-notice": "This work is licensed under a Creative Commons Attribution #.# International License",
    "GPL-notice": "This work is licensed under the GNU General Public License, version #.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    out: list[int] = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places (text, template), ascending in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once: dict[int, int] = {}
        for i in range(a, b):
            once[text[i]] = -1 if text[i] in once else i
        seen: dict[int, int] = {}
        for j in range(c, d):
            seen[template[j]] = -1 if template[j] in seen else j
        anchors = [(once[w], j) for w, j in seen.items() if j >= 0 and once.get(w, -1) >= 0]
        kept = [anchors[k] for k in longest_increasing([i for i, _ in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        marked = text.replace("#", "0wild0")
        words = Words(texts_of(pa.array([marked, "0wild0"])), PLAIN)
        wild = words.hash[-1]
        self.name, self.words = name, words.hash[:-1]
        self.free = set(np.flatnonzero(self.words == wild).tolist())  # any one word may stand there
        self.needed = len(self.words) - len(self.free)
        self.times = {int(w): int(n) for w, n in zip(*np.unique(self.words[self.words != wild], return_counts=True), strict=True)}
        self.vocabulary = np.unique(self.words[self.words != wild])


def reach_of(template: Template) -> int:
    """The words that a copy may take up."""
    return max(SPREAD * len(template.words), NEAR)


def tight_spans(words: list[int], at: list[int], template: Template, least: float) -> list[tuple[int, int]]:
    """Word ranges, none in another, that hold ``least`` of the template's words, each word as often as there at most.

    No copy within ``reach_of`` the template is without such a range: it holds the words
    that an alignment would reach, in any order.
    """
    most = reach_of(template)
    want, need = template.times, least * template.needed
    held: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    have = first = 0
    for i, e in enumerate(at):
        w = words[e]
        held[w] = held.get(w, 0) + 1
        have += held[w] <= want[w]
        while have >= need or at[first] <= e - most:
            if have >= need:
                span = (at[first], e + 1)
                if out and out[-1][1] == span[1]:
                    out[-1] = span
                else:
                    out.append(span)
            w = words[at[first]]
            have -= held[w] <= want[w]
            held[w] -= 1
            first += 1
            if first > i:
                break
    return out


def matches(words: np.ndarray, member: np.ndarray, template: Template, least: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, end) of every copy of the template, the best aligned first where they overlap."""
    text, at = words.tolist(), np.flatnonzero(member).tolist()
    spans = tight_spans(text, at, template, least)
    size, goal = len(template.words), template.words.tolist()
    tried: set[tuple[int, int]] = set()
    found: list[tuple[float, int, int]] = []

    def reach(lo: int, hi: int) -> None:
        lo, hi = max(lo, 0), min(hi, len(text))
        if (lo, hi) in tried:
            return
        tried.add((lo, hi))
        pairs = [(i, j) for i, j in align(text[lo:hi], goal) if j not in template.free]
        if pairs and len(pairs) >= least * template.needed:
            found.append((len(pairs) / template.needed, lo + pairs[0][0], lo + pairs[-1][0] + 1))

    for k, (s, e) in enumerate(spans):
        more = -(-(e - s) * (template.needed - int(least * template.needed)) // max(1, int(least * template.needed))) + 1
        reach(s, e)
        reach(s, e + more)
        reach(s - more, e)
        reach(s - more, e + more)
        reach(s, s + size)
        reach(s, s + size + size // 2)
        if k == 0 or spans[k - 1][1] <= s:  # spans that overlap, as far as one copy can
            last = k
            while last + 1 < len(spans) and spans[last + 1][0] < spans[last][1] and spans[last + 1][1] <= s + reach_of(template):
                last += 1
            reach(s, spans[last][1])
    if template.needed >= LONG:  # patience over all of the template's words in the text
        pairs = [(at[i], j) for i, j in align([text[i] for i in at], goal) if j not in template.free]
        if len(pairs) >= least * template.needed:
            found.append((len(pairs) / template.needed, pairs[0][0], pairs[-1][0] + 1))
    kept: list[tuple[float, int, int]] = []
    for f in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        if all(f[2] <= k[1] or k[2] <= f[1] for k in kept):
            kept.append(f)
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """doc_id, license_id, coverage, first_word, end_word (of the best template), n_licenses, licenses: a row per document.

    ``licenses`` lists every copy of every template, the best first.
    """
    given = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(k, v) for k, v in sorted(given.items())]
        every = np.unique(np.concatenate([t.vocabulary for t in known])) if known else np.zeros(0, dtype=np.uint64)
        of_template = [np.isin(every, t.vocabulary) for t in known]
        bits = np.uint64((1 << 20) - 1)
        table = np.zeros(1 << 20, dtype=bool)
        table[(every & bits).astype(np.int64)] = True
        for b in batches:
            texts = texts_of(b.column("text"))
            rows: list[tuple] = []
            for lo, hi in slices(texts):
                w = Words(texts.slice(lo, hi - lo), PLAIN)
                code = np.full(len(w.hash), -1)
                at = np.flatnonzero(table[(w.hash & bits).astype(np.int64)])
                if len(every) and len(at):
                    k = np.minimum(np.searchsorted(every, w.hash[at]), len(every) - 1)
                    code[at] = np.where(every[k] == w.hash[at], k, -1)
                hits: list[list[tuple]] = [[] for _ in range(hi - lo)]
                for t, vocabulary in zip(known, of_template, strict=True):
                    member = np.append(vocabulary, False)[code]
                    sums = np.concatenate(([0], np.cumsum(member)))
                    for d in np.flatnonzero(sums[w.first[1:]] - sums[w.first[:-1]] >= least * t.needed):
                        s, e = w.first[d], w.first[d + 1]
                        held, n = np.unique(w.hash[s:e][member[s:e]], return_counts=True)
                        if sum(min(k, t.times[h]) for h, k in zip(held.tolist(), n.tolist(), strict=True)) < least * t.needed:
                            continue
                        hits[d] += [(f[0], t.needed, t.name, *f[1:]) for f in matches(w.hash[s:e], member[s:e], t, least)]
                for h in hits:
                    h.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
                    every_one = [{"license_id": x[2], "coverage": x[0], "first_word": int(x[3]), "end_word": int(x[4])} for x in h]
                    best = every_one[0] if h else {"coverage": 0.0}
                    rows.append((best.get("license_id"), best["coverage"], best.get("first_word"), best.get("end_word"), len({x[2] for x in h}), every_one))
            one = pa.struct([("license_id", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(one))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "license_id", "coverage", "first_word", "end_word", "n_licenses", "licenses"])

    kinds = "doc_id long, license_id string, coverage double, first_word long, end_word long, n_licenses int, licenses array<struct<license_id string, coverage double, first_word long, end_word long>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, kinds)


def query(spark, sf_dir):
    return scan(read(spark, sf_dir, "documents"))
