"""Licence scan by a generalised suffix automaton of template tokens (operator 8).

The automaton accepts every word sequence that occurs in a template. Streaming a file through it gives, at
each word, the length of the longest match that ends there (matching statistics). Maximal matches of at
least `MIN_MATCH` words are chained, per template, in the order of file and template; the words that a
chain covers, as a share of the template, make its coverage. A template's label is given from its own least
coverage on. Base phrases are found beside that and keep their labels.

Words outside the templates' vocabulary end every match, so the automaton walks runs of known words only.
Memory per file, a very long one too, is its words and matches; the automaton is of the templates' size. Of chains of
equal coverage the first in the file counts.

Defined results: null or empty text has no words, no labels and score 0; a null doc_id is a row like any
other; repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.llm.common import batches, texts

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
MIN_MATCH = 4
MAX_GAP = 40

#: Label: (least coverage, text). Public licence wordings; short notices have to be there nearly whole.
TEMPLATES: dict[str, tuple[float, str]] = {
    "mit": (0.4, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    "apache": (0.4, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    "gpl": (0.4, """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    "bsd": (0.4, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    "isc": (0.6, """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    "cc-by-nc": (0.8, "Licensed under CC BY-NC 4.0"),
    "cc-by": (0.8, "This work is licensed under a Creative Commons Attribution 4.0 International License"),
}

_SEPARATORS = bytes(32 if b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) else b for b in range(256))


def words(t: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, as UTF-8."""
    return t.lower().translate(_SEPARATORS).split()


class SuffixAutomaton:
    """Of several token sequences; each state knows the (template, end) places of its strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set] = [set()]
        for s, tokens in enumerate(sequences):
            last = 0
            for i, c in enumerate(tokens):
                last = self._extend(last, c, ends)
                ends[last].add((s, i + 1))
        for k in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            ends[self.link[k]] |= ends[k]
        self.ends = [sorted(x) for x in ends]

    def _state(self, n: int, link: int, nxt: dict, ends: list[set]) -> int:
        self.next.append(nxt)
        self.len.append(n)
        self.link.append(link)
        ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int, ends: list[set]) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list[set]) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q, ends)
        cur, p = self._state(self.len[last] + 1, 0, {}, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q, ends)
        return cur

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of each maximal match of `least` tokens or more."""
        out, state, n = [], 0, 0
        for i, c in enumerate(tokens):
            before, was = n, state
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.len[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            if n <= before and before >= least:
                out.append((i, before, was))
        if n >= least:
            out.append((len(tokens), n, state))
        return out


class Scanner:
    """Templates, their vocabulary and automaton."""

    def __init__(self, templates: dict[str, tuple[float, str]]):
        self.labels, self.least = list(templates), [x[0] for x in templates.values()]
        tokens = [words(x[1].encode()) for x in templates.values()]
        self.vocabulary: dict[bytes, int] = {}
        for w in [w for own in tokens for w in own] + [w for p, _ in PHRASES for w in p.encode().split()]:
            self.vocabulary.setdefault(w, len(self.vocabulary))
        self.sizes = [len(x) for x in tokens]
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in own] for own in tokens])
        self.phrases = [([self.vocabulary[w] for w in p.encode().split()], label) for p, label in PHRASES]

    def base(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(start, label) of every place of a base phrase."""
        out = []
        for phrase, label in self.phrases:
            m = len(ids) - len(phrase) + 1
            if m > 0:
                hit = ids[:m] == phrase[0]
                if hit.any():
                    for k in range(1, len(phrase)):
                        hit = hit & (ids[k : k + m] == phrase[k])
                    out += [(int(i), label) for i in np.flatnonzero(hit)]
        return out

    def spans(self, ids: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(label, coverage, first word, end word) of each template's best chain."""
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= MIN_MATCH
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            for end, n, state in self.automaton.matches(ids[a:b].tolist(), MIN_MATCH):
                for s, e in self.automaton.ends[state]:
                    found[s].append((a + end, n, e))
        return [(self.labels[s], *self._chain(own, self.sizes[s])) for s, own in sorted(found.items())]

    @staticmethod
    def _chain(own: list[tuple[int, int, int]], size: int) -> tuple[float, int, int]:
        """(coverage, first word, end word) of the best chain of (file end, length, template end)."""
        own = sorted(own)
        best: list[tuple[int, int]] = []  # covered words, first word
        for k, (end, n, e) in enumerate(own):
            top = (n, end - n)
            for j in range(k - 1, -1, -1):
                pe, _, pt = own[j]
                if end - n - pe > MAX_GAP:
                    break
                overlap = max(0, pe - (end - n), pt - (e - n))
                if pt < e and pe < end and overlap < n and best[j][0] + n - overlap > top[0]:
                    top = (best[j][0] + n - overlap, best[j][1])
            best.append(top)
        k = max(range(len(best)), key=lambda i: best[i][0])
        return min(1.0, best[k][0] / size), best[k][1], own[k][0]


def scan(docs: DataFrame, templates: dict[str, tuple[float, str]] = TEMPLATES) -> DataFrame:
    """A row per document: words, base places, labels, score, and the template spans found."""
    held = Scanner(templates)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, coverage: double, start: long, end: long>>"
    span = pa.list_(pa.struct([("label", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    columns = [*((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)]

    def one(t: bytes) -> tuple:
        own = words(t)
        ids = np.fromiter(map(held.vocabulary.get, own, repeat(-1)), np.int32, len(own))
        base, spans = held.base(ids), held.spans(ids)
        first, last = (min(x[0] for x in base), max(x[0] for x in base)) if base else (None, None)
        least = dict(zip(held.labels, held.least, strict=True))
        given = [x for x in spans if x[1] >= least[x[0]]]
        names = {x[1] for x in base}
        score = max([x[1] for x in spans] + [1.0] * bool(base), default=0.0)
        return len(own), len(base), first, last, ",".join(sorted(names)), ",".join(sorted(names | {x[0] for x in given})), score, [dict(zip(("label", "coverage", "start", "end"), x, strict=True)) for x in given]

    def run(b: pa.RecordBatch) -> dict:
        rows = zip(*map(one, texts(b.column(1))), strict=True)
        return {"doc_id": b.column(0)} | {n: pa.array(c, t) for (n, t), c in zip(columns, rows, strict=True)}

    return batches(docs.select("doc_id", "text"), run, schema)
