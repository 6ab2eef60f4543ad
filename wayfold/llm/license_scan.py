"""Licence scans: matching statistics against a generalised suffix automaton of licence tokens, chained into template spans."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, utf8_list

# Short phrases whose words, standing consecutively, name a licence.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices and opening passages of public licence texts, by the label they give.
TEMPLATES = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "apache-2": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "gpl": ("Licensed under the GNU General Public License", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "cc-by": ("licensed under the Creative Commons Attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}

#: Bytes that end a word: all ASCII but digits and letters.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a text: A-Z lower-cased, cut at every ASCII byte that is neither digit nor letter."""
    return text.lower().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word ids; a sentinel that no text contains keeps the sequences apart."""

    def __init__(self, sequences: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        self.sequences, self.owner = sequences, []
        last, at = 0, 0
        for k, seq in enumerate(sequences):
            for w in seq:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)), at)
                self.owner.append(k)
                at += 1
            last = self._extend(last, -2 - k, at)
            self.owner.append(k)
            at += 1
        #: for each state, the sequences that are a suffix of its strings, as (length, sequence)
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(sequences):
            v = 0
            for w in seq:
                v = self.next[v][self.ids[w]]
            if seq:
                ends.setdefault(v, []).append((len(seq), k))
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in reversed(order):  # every place where a state's strings end
            self.ends[self.link[v]] = self.ends[self.link[v]] + self.ends[v]
        for v in order:
            self.whole[v] = self.whole[self.link[v]] + ends.get(v, [])
        self._held: dict[int, list[tuple[int, int, list[int]]]] = {}

    def held(self, v: int) -> list[tuple[int, int, list[int]]]:
        """For each sequence that holds a suffix of state v's strings: (sequence, the state of the longest such suffix, the places
        of the sequence where it ends)."""
        if v not in self._held:
            found: dict[int, tuple[int, list[int]]] = {}
            u = v
            while u > 0:
                places: dict[int, list[int]] = {}
                for end in self.ends[u]:
                    places.setdefault(self.owner[end], []).append(end)
                for k, own in places.items():
                    found.setdefault(k, (u, own))
                u = self.link[u]
            self._held[v] = [(k, u, own) for k, (u, own) in found.items()]
        return self._held[v]

    def _extend(self, last: int, c: int, at: int) -> int:
        def state(length: int, ends: list[int]) -> int:
            self.next.append({})
            self.link.append(0)
            self.length.append(length)
            self.ends.append(ends)
            return len(self.next) - 1

        cur = state(self.length[last] + 1, [at])
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[p] + 1 != self.length[q]:
                twin = state(self.length[p] + 1, [])
                self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = twin
                    p = self.link[p]
                self.link[q] = twin
                q = twin
            self.link[cur] = q
        return cur

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word, (state, length of the longest suffix of what was read that the sequences contain)."""
        v = length = 0
        nexts, link, longest = self.next, self.link, self.length
        for c in ids:
            while v and c not in nexts[v]:
                v = link[v]
                length = longest[v]
            if c in nexts[v]:
                v = nexts[v][c]
                length += 1
            yield v, length


@dataclass
class Scan:
    n_words: int
    #: (start word, label) of each whole phrase
    phrases: list[tuple[int, str]]
    #: (first word, word after the last, label, covered share of the template)
    spans: list[tuple[int, int, str, float]]


class Scanner:
    """Scans texts for phrases and templates.

    Matches of `least` or more words are maximal ends of the matching statistics, taken for each template by itself: where a longer
    match of another one stands, the suffix links lead to its own longest. Matches of one template whose places in text
    and template both go forward, at most `gap` words apart in the text, chain into a span. A span counts when its matches
    cover `cover` of the template's words.
    """

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: int = 6, gap: int = 40, cover: float = 0.5):
        self.least, self.gap, self.cover = least, gap, cover
        self.labels = [*phrases.values(), *(k for k, texts in templates.items() for _ in texts)]
        self.n_phrases = len(phrases)
        self.auto = Automaton([words(x.encode()) for x in [*phrases, *(t for texts in templates.values() for t in texts)]])
        self.starts, at = [], 0
        for seq in self.auto.sequences:
            self.starts.append(at)
            at += len(seq) + 1
        self.shortest = min([len(s) for s in self.auto.sequences[: self.n_phrases]] + [least])

    def scan(self, text: bytes) -> Scan:
        parts = words(text)
        ids = np.fromiter(map(self.auto.ids.get, parts, [-1] * len(parts)), np.int32, len(parts))
        out = Scan(len(parts), [], [])
        # no match crosses a word that the sequences lack, so shorter runs than the shortest match end nothing
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        matches: list[tuple[int, int, int, int]] = []
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                self._run(ids[a:b].tolist(), a, out, matches)
        self._chain(matches, out)
        return out

    def _run(self, ids: list[int], at: int, out: Scan, matches: list[tuple[int, int, int, int]]) -> None:
        # of each template the longest match that ends at the word before, with the template's places where it ends
        before: dict[int, tuple[int, list[int]]] = {}
        for i, (v, length) in enumerate([*self.auto.stream(ids), (0, 0)]):
            for n, k in self.auto.whole[v]:
                if k < self.n_phrases and n <= length:
                    out.phrases.append((at + i - n + 1, self.labels[k]))
            now: dict[int, tuple[int, list[int]]] = {}
            if length >= self.least:
                for k, u, ends in self.auto.held(v):
                    n = length if u == v else self.auto.length[u]
                    if k >= self.n_phrases and n >= self.least:
                        now[k] = n, ends
            for k, (n, ends) in before.items():
                if k not in now or now[k][0] != n + 1:
                    matches += [(k, at + i - n, end - self.starts[k] - n + 1, n) for end in ends]
            before = now

    def _chain(self, matches: list[tuple[int, int, int, int]], out: Scan) -> None:
        """Best chains by covered words: each match follows the best earlier one that it may."""
        for k in sorted({m[0] for m in matches}):
            own = sorted(m[1:] for m in matches if m[0] == k)
            size = len(self.auto.sequences[k])
            open_chains: list[list[int]] = []  # start, text end, template end, covered
            for at, place, n in own:
                best = None
                for c in reversed(open_chains):
                    if at - c[1] > self.gap:
                        break  # matches, and so chains, are in order of their text ends
                    if c[2] <= place + n - 1:
                        fresh = n - max(0, c[2] - place, c[1] - at)
                        if fresh > 0 and (best is None or c[3] + fresh > best[3]):
                            best = [c[0], at + n, place + n, c[3] + fresh]
                open_chains.append(best or [at, at + n, place + n, n])
            taken: list[tuple[int, int]] = []
            for start, end, _, covered in sorted(open_chains, key=lambda c: (-c[3], c[0])):
                if covered < self.cover * size:
                    break
                i = bisect(taken, (start, end))
                if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                    taken.insert(i, (start, end))
                    out.spans.append((start, end, self.labels[k], min(1.0, covered / size)))
        out.spans.sort()


SCHEMA = "id bigint, n_words bigint, phrases array<struct<start:bigint,label:string>>, spans array<struct<start:bigint,stop:bigint,label:string,covered:double>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: int = 6, gap: int = 40, cover: float = 0.5) -> DataFrame:
    """(id_col, n_words, phrases, spans) of every row of docs: whole phrases by start word, and covered template spans.

    Texts are streamed whole, one pass each; the automaton depends on the templates alone. Null or empty text: no words and
    empty lists. A long or repeated text takes time in proportion and no more memory than its words. Null and repeated ids
    keep their rows, other columns are not read, whatever their names, and an empty table gives an empty result; ids cast to
    bigint. Places of phrases are in text order; of spans that overlap the one with more words covered stands, then the earlier.
    """

    def scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, least, gap, cover)
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("covered", pa.float64())]))]
        for batch in by_bytes(batches, "text"):
            found = [scanner.scan(x) for x in utf8_list(batch.column("text"))]
            rows = [[s.n_words for s in found], [[{"start": a, "label": x} for a, x in sorted(s.phrases)] for s in found], [[dict(zip(("start", "stop", "label", "covered"), x, strict=True)) for x in s.spans] for s in found]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))], ["id", "n_words", "phrases", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scans, SCHEMA).withColumnRenamed("id", id_col)


def license_digest(scans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per scan: n_base, first_word and last_word over the phrases, base_labels, labels of phrases and spans, and score.

    score is 1 for a document with a phrase, else the best covered share of a template, else 0.
    """
    base = F.array_sort(F.array_distinct(F.col("phrases.label")))
    return scans.select(
        id_col,
        "n_words",
        F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"),
        F.array_max("phrases.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("spans.label"))), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.covered"), F.lit(0.0))).alias("score"),
        "spans",
    )
