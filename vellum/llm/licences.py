"""Licence scans with a generalised suffix automaton (operator 7).

Licence templates become word sequences; one suffix automaton holds all their substrings. Texts are streamed: runs of
words that templates use are fed to the automaton, which gives matching statistics (the longest template substring
that ends at each word). Long matches are chained, template by template, in order of text and template and with
bounded gaps; a chain that covers enough of a template is a span with that template's label. Fixed phrases are counted
beside it. Nothing is shuffled; each row stands alone.

Words are runs of ASCII letters, digits and non-ASCII bytes after lower-casing A-Z.

Edge cases: null and empty texts have no words, no places, empty labels and score 0; very long texts are streamed in
memory proportional to themselves; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .textops import LOWER, slices, small_batches, word_hashes, words

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and grants as they are commonly printed.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

SEPARATORS = np.ones(256, bool)
SEPARATORS[48:58] = SEPARATORS[97:123] = SEPARATORS[128:] = False


def names_of(text: str) -> np.ndarray:
    buf = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(buf, np.array([0, len(buf)]), SEPARATORS)
    return word_hashes(buf, starts, ends)


class Automaton:
    """Suffix automaton of several sequences; for each state, the first end of its strings in each sequence."""

    def __init__(self, sequences):
        self.next, self.link, self.size, self.ends = [{}], [-1], [0], [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._add(last, word)
                self.ends[last].setdefault(number, place + 1)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            for number, place in self.ends[state].items():
                up = self.ends[self.link[state]]
                up[number] = min(place, up.get(number, place))

    def _new(self, size, moves, link):
        self.next.append(dict(moves))
        self.link.append(link)
        self.size.append(size)
        self.ends.append({})
        return len(self.size) - 1

    def _clone(self, p, word, q):
        copy = self._new(self.size[p] + 1, self.next[q], self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _add(self, last, word):
        if (q := self.next[last].get(word)) is not None:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, word, q)
        state, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self._clone(p, word, q)
        return state

    def matches(self, sequence, least: int):
        """Maximal matches of at least `least` words: (start, length, {sequence number: start there})."""
        state = length = 0
        for place, word in enumerate([*sequence, None]):
            before, had = state, length
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
            if length <= had and had >= least:
                yield place - had, had, {n: e - had for n, e in self.ends[before].items()}


def chain(matches, sizes, gap: int, cover: float):
    """Spans (template, start, end, covered share) of chains of matches that cover at least `cover` of a template."""
    open_: dict[int, list] = {}
    out = []

    def close(t):
        start, end, _, covered, best = open_.pop(t)
        if covered / sizes[t] >= cover:
            out.append((t, start, end, min(1.0, covered / sizes[t])))

    for start, length, places in matches:
        for t, at in places.items():
            if t in open_:
                s, end, reached, covered, _ = open_[t]
                shift = max(0, end - start, reached - at)
                if start - end <= gap and 0 <= at + length - reached and at - reached <= gap and length > shift:
                    open_[t] = [s, start + length, at + length, covered + length - shift, 0]
                    continue
                if length <= covered and start < end + gap and start + length <= end:
                    continue
                close(t)
            open_[t] = [start, start + length, at + length, length, 0]
    for t in list(open_):
        close(t)
    return sorted(out, key=lambda x: (x[1], x[0]))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start_word:long,end_word:long,covered:double>>"


def scan(df, templates=TEMPLATES, phrases=PHRASES, least: int = 3, gap: int = 12, cover: float = 0.7, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document: its words, the places of fixed phrases, the labels found, a score and the covered spans.

    score: the largest share of a template that a span covers, or 1 where a fixed phrase stands.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = [(label, names_of(phrase)) for phrase, label in phrases.items()]

    def run(batches):
        sequences = [names_of(text).tolist() for _, text in templates]
        sizes = [len(s) for s in sequences]
        machine = Automaton(sequences)
        known = np.unique(np.array([w for s in sequences for w in s], np.uint64))
        for batch in batches:
            for at, buf, offs in slices(batch.column("text")):
                buf = LOWER[buf]
                starts, ends, rows = words(buf, offs, SEPARATORS)
                names = word_hashes(buf, starts, ends)
                n = len(offs) - 1
                bounds = np.searchsorted(rows, np.arange(n + 1))
                base: list[list] = [[] for _ in range(n)]
                for label, phrase in wanted:
                    if len(names) < len(phrase):
                        continue
                    m = len(names) - len(phrase) + 1
                    hit = rows[:m] == rows[len(phrase) - 1 :]
                    for k, w in enumerate(phrase):
                        hit = hit & (names[k : k + m] == w)
                    for p in np.flatnonzero(hit):
                        base[rows[p]].append((int(p - bounds[rows[p]]), label))
                found: list[list] = [[] for _ in range(n)]
                if len(names):
                    ok = known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names
                    cut = np.flatnonzero(np.r_[True, (ok[1:] != ok[:-1]) | (rows[1:] != rows[:-1])])
                    lengths = np.diff(np.r_[cut, len(names)])
                    for a, k in zip(cut[ok[cut] & (lengths >= least)], lengths[ok[cut] & (lengths >= least)], strict=True):
                        shift = int(a - bounds[rows[a]])
                        found[rows[a]] += [(s + shift, size, where) for s, size, where in machine.matches(names[a : a + k].tolist(), least)]
                out: list[list] = [[] for _ in range(7)]
                for i in range(n):
                    spans = chain(found[i], sizes, gap, cover) if found[i] else []
                    places = sorted(base[i])
                    own = sorted({label for _, label in places})
                    row = (len(places), places[0][0] if places else None, places[-1][0] if places else None, own, sorted({*own, *(templates[t][0] for t, *_ in spans)}), 1.0 if places else max((s[3] for s in spans), default=0.0), [{"label": templates[t][0], "start_word": a, "end_word": b, "covered": c} for t, a, b, c in spans])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                strings = pa.list_(pa.string())
                kinds = [pa.int64(), pa.int64(), pa.int64(), strings, strings, pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())]))]
                columns = [batch.column("doc_id").slice(at, n), pa.array(np.diff(bounds))] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.mapInArrow(run, SCHEMA)
