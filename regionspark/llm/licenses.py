"""Licence scans by a generalised suffix automaton of licence tokens.

The templates' words become numbers, and one suffix automaton holds all templates. A text's words stream through it:
a state and a length say which run of words that ends here is the longest that stands in some template (the matching
statistic). Base phrases are found on the way, as marked states on the suffix links. Where the statistic reaches
``MIN_MATCH`` words, the suffix links also tell how long the match is in each single template, so that one template does
not hide another that shares part of it. The maximal matches of each template are then chained into a span: matches that
go on in order in the text and in the template, with at most as many words between them in the text as the template has;
of all chains the one that covers most is taken. A template covered by ``MIN_COVERED`` or more gives its label; the score
is the largest share covered, and 1 where a base phrase stands.

The automaton has at most twice as many states as the templates have words, and each word of a template is one mark in
the order of a walk over the suffix links, so that the places of a state are one slice; both grow with the templates'
words only and go to every task.

Defined cases: a null or empty text has no words, no labels, no spans and score 0; A-Z are lower-cased, other characters
are not; very long texts stream like others; rows that repeat are scanned each; a null id stays null; of chains that
cover equally much the one that ends first is taken; an empty table gives an empty table. Only the id and the text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

MIN_MATCH, MIN_COVERED = 4, 0.6

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of well-known public licences, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
        "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "gpl-notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ],
    "cc-by-notice": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "Licensed under CC BY-SA 4.0",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
    ],
    "as-is": [
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    ],
    "copyright-notice": [
        "Copyright (c) The Authors. All rights reserved.",
    ],
}

#: Bytes as words see them: A-Z in lower case, digits, a-z and all bytes of other characters; the rest parts words.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Span:
    """A chain of matches with one template: its first and last word in the text and the share of the template covered."""

    template: int
    first: int
    last: int
    covered: float


class Automaton:
    """Generalised suffix automaton over word numbers, with the places where each state's longest run ends."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]) -> None:
        self.labels = [label for label, _ in templates]
        self.phrase_label = list(phrases.values())
        spelled = [words_of(t.encode()) for _, t in templates]
        marked = [words_of(p.encode()) for p in phrases]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for run in spelled + marked for w in run))}
        self.lengths = [len(run) for run in spelled]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        marks: list[tuple[int, int, int]] = []  # state, template, place
        for t, run in enumerate(spelled + marked):
            last = 0
            for i, w in enumerate(run):
                last = self.extend(last, self.number[w])
                if t < len(spelled):
                    marks.append((last, t, i))
        self.number_places(marks)
        at_phrase: dict[int, list[tuple[int, int]]] = {}
        for p, run in enumerate(marked):
            state = 0
            for w in run:
                state = self.next[state][self.number[w]]
            at_phrase.setdefault(state, []).append((p, len(run)))
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.phrases[state] = at_phrase.get(state, []) + self.phrases[self.link[state]]

    def number_places(self, marks: list[tuple[int, int, int]]) -> None:
        """Marks in the order of a walk over the suffix links: where a state's run ends, its suffixes' runs end, so a
        state's places are the marks from its first one on, up to the first one behind its subtree."""
        below: list[list[int]] = [[] for _ in self.length]
        for state in range(1, len(self.length)):
            below[self.link[state]].append(state)
        own: dict[int, list[tuple[int, int]]] = {}
        for state, t, at in marks:
            own.setdefault(state, []).append((t, at))
        self.marks: list[tuple[int, int]] = []
        self.first_mark, self.after_mark = [0] * len(self.length), [0] * len(self.length)
        stack = [(0, False)]
        while stack:
            state, left = stack.pop()
            if left:
                self.after_mark[state] = len(self.marks)
                continue
            self.first_mark[state] = len(self.marks)
            self.marks += own.get(state, [])
            stack.append((state, True))
            stack += [(child, False) for child in below[state]]

    def places(self, state: int) -> dict[int, list[int]]:
        """By template the places, in rising order, at which the state's runs end."""
        out: dict[int, list[int]] = {}
        for t, at in sorted(self.marks[self.first_mark[state] : self.after_mark[state]]):
            out.setdefault(t, []).append(at)
        return out

    def extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            to = self.next[last][w]
            if self.length[to] == self.length[last] + 1:
                return to
            return self.split(last, to, w)
        state = self.add(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            to = self.next[p][w]
            self.link[state] = to if self.length[to] == self.length[p] + 1 else self.split(p, to, w)
        return state

    def add(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def split(self, p: int, to: int, w: int) -> int:
        copy = self.add(self.length[p] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while p >= 0 and self.next[p].get(w) == to:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, list[str], list[str], float, list[Span]]:
        """n_base, first and last word, base labels, all labels, score, spans."""
        number, following, link, longest, phrases = self.number, self.next, self.link, self.length, self.phrases
        state = length = 0
        n_base, first, last, base = 0, None, None, set()
        hits: list[tuple[int, int, int]] = []  # last word, length, state
        for i, w in enumerate(map(number.get, words)):
            if w is None:
                state = length = 0
                continue
            while state > 0 and w not in following[state]:
                state = link[state]
                length = longest[state]
            if w in following[state]:
                state = following[state][w]
                length += 1
            else:
                length = 0
            for p, size in phrases[state]:
                if size <= length:
                    at = i - size + 1
                    n_base += 1
                    first = at if first is None or at < first else first
                    last = at if last is None or at > last else last
                    base.add(self.phrase_label[p])
            if length >= MIN_MATCH:
                hits.append((i, length, state))
        labels, score, spans = set(base), 1.0 if base else 0.0, []
        for t, matches in self.matches(hits).items() if hits else ():
            span = self.chain(t, matches)
            score = max(score, span.covered)
            if span.covered >= MIN_COVERED:
                labels.add(self.labels[t])
                spans.append(span)
        return n_base, first, last, sorted(base), sorted(labels), score, spans

    def matches(self, hits: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, list[int]]]]:
        """By template its maximal matches: last word in the text, length, places in the template where they end."""
        out: dict[int, list[tuple[int, int, list[int]]]] = {}
        open_now: dict[int, tuple[int, int, list[int]]] = {}
        known: dict[int, dict[int, list[int]]] = {}
        for i, length, state in hits:
            found: dict[int, tuple[int, int, list[int]]] = {}
            while state > 0 and length >= MIN_MATCH:
                if state not in known:
                    known[state] = self.places(state)
                for t, places in known[state].items():
                    if t not in found:
                        found[t] = (i, length, places)
                state = self.link[state]
                length = self.length[state]
            for t, match in open_now.items():
                if match[0] != i - 1 or t not in found or found[t][1] != match[1] + 1:
                    out.setdefault(t, []).append(match)
            open_now = found
        for t, match in open_now.items():
            out.setdefault(t, []).append(match)
        return out

    def chain(self, t: int, matches: list[tuple[int, int, list[int]]]) -> Span:
        """The chain of a template's matches that covers most of it."""
        size = self.lengths[t]
        ends: list[tuple[int, int, int, int, int]] = []  # chains by their last match: text end, template end, covered, first word, start
        best = (0, 0, 0, 0, 0)
        for end, length, places in matches:
            start = end - length + 1
            reach = [c for c in ends if start - c[0] - 1 <= size]
            for at in places:
                made = (end, at, length, start, start)
                for chain in reach:
                    fresh = min(length, at - chain[1], end - chain[0])
                    if fresh > 0 and chain[2] + fresh > made[2]:
                        made = (end, at, chain[2] + fresh, chain[3], start)
                ends.append(made)
                if made[2] > best[2]:
                    best = made
            ends = [c for c in ends if c[0] + 2 * size >= end]
        return Span(t, best[3], best[0], min(1.0, best[2] / size))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, number of the template,
    first and last word, share covered; by template)."""
    pairs = [(label, t) for label, some in (TEMPLATES if templates is None else templates).items() for t in some]
    automaton = Automaton(pairs, PHRASES if phrases is None else phrases)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True):
                words = words_of(text.as_py() or b"")
                n_base, first, last, base, labels, score, spans = automaton.scan(words)
                told = [(automaton.labels[x.template], x.template, x.first, x.last, x.covered) for x in sorted(spans, key=lambda x: x.template)]
                rows.append((doc_id, len(words), n_base, first, last, ",".join(base), ",".join(labels), score, told))
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        tidied(run),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label string, template int, first_word long, last_word long, covered double>>",
    )
