"""Licence scans by a generalised suffix automaton of licence wordings.

All wordings (``TEMPLATES``) and base phrases (``PHRASES``) become one automaton over words, built once in each task: a state
stands for the substrings of the wordings that end at the same places. A text is streamed through it word by word, which gives the
matching statistics: at each word the length of the longest run ending there that occurs in a wording, and its state. Base phrases are
strings of the automaton too, so a phrase stands at a word if its state lies on the suffix links of the current state.

Runs of ``LEAST_RUN`` words or more that cannot go on are anchors: where they stand in the text and in the wordings. Anchors of
a wording are chained in the order of both, over gaps of ``MOST_GAP`` words at most (names, dates and edits), overlaps counted
once. A chain covers a share of its wording's words; from ``LEAST_SHARE`` on it is a span with the wording's label.

The work is linear in the text: an anchor looks back over ``MOST_GAP`` words only, and the wordings are fixed. No row moves. A
null text is empty and has no words; a text is one value, whatever its length. Repeated rows and rows without doc_id
each get their result; of equally good chains the one that ends first is taken; other columns play no part. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import map_texts

LEAST_RUN, MOST_GAP, LEAST_SHARE = 3, 12, 0.75

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Fixed values: (label, wording) of public licence notices.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
                "of the License, or (at your option) any later version"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
                "of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

# Words are ASCII letters and digits and all other characters beyond ASCII; in UTF-8 the latter are bytes from 0x80.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case."""
    return text.translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton of sequences of words.

    ``places`` has for each state (sequence, end) of all occurrences of its substrings.
    """

    def __init__(self, sequences: Iterable[list[bytes]]) -> None:
        self.steps: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: list[int] = []
        prefixes = []
        for number, words in enumerate(sequences):
            state = 0
            for end, word in enumerate(words, 1):
                state = self._extend(state, word)
                prefixes.append((state, (number, end)))
            self.whole.append(state)
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.steps]
        for state, place in prefixes:
            self.places[state].add(place)
        for state in sorted(range(1, len(self.steps)), key=lambda s: -self.length[s]):
            self.places[self.link[state]] |= self.places[state]

    def _state(self, length: int, steps: dict[bytes, int], link: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.steps) - 1

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the string of ``last`` followed by ``word``, made if it is missing."""
        if word in self.steps[last]:
            return self._parted(last, word)
        state = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.steps[last]:
            self.steps[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._parted(last, word)
        return state

    def _parted(self, at: int, word: bytes) -> int:
        """The state one word after ``at`` whose longest string is just that word longer."""
        after = self.steps[at][word]
        if self.length[after] == self.length[at] + 1:
            return after
        part = self._state(self.length[at] + 1, dict(self.steps[after]), self.link[after])
        self.link[after] = part
        while at >= 0 and self.steps[at].get(word) == after:
            self.steps[at][word] = part
            at = self.link[at]
        return part


class Scanner:
    """Streams texts through the automaton of base phrases and wordings."""

    def __init__(self, phrases: dict[str, str], templates: Iterable[tuple[str, str]]) -> None:
        templates = list(templates)
        first = [words_of(p.encode()) for p in phrases]
        wordings = [words_of(t.encode()) for _, t in templates]
        self.automaton = Automaton([*first, *wordings])
        self.labels = [label for label, _ in templates]
        self.sizes = [len(w) for w in wordings]
        self.vocabulary = {w for words in [*first, *wordings] for w in words}
        auto, n = self.automaton, len(first)
        own: dict[int, list[tuple[str, int]]] = {}
        for state, label, words in zip(auto.whole, phrases.values(), first):
            own.setdefault(state, []).append((label, len(words)))
        # Phrases at a state: those of its own string, if the match has its whole length, and those further up its links.
        self.own, self.shorter = own, {}
        for state in range(1, len(auto.steps)):
            up, found = auto.link[state], []
            while up > 0:
                found += own.get(up, [])
                up = auto.link[up]
            if found:
                self.shorter[state] = found
        self.at = [sorted((number - n, end) for number, end in of if number >= n) for of in auto.places]

    def statistics(self, words: list[bytes]):
        """(position, length, state) of the longest match that ends at each word that the wordings know."""
        steps, link, lengths = self.automaton.steps, self.automaton.link, self.automaton.length
        state = length = 0
        before, known = -2, self.vocabulary
        for j, word in enumerate(words):
            if word not in known:
                continue
            if j != before + 1:
                state = length = 0
            before = j
            while word not in steps[state]:
                state = link[state]
                length = lengths[state]
            state = steps[state][word]
            length += 1
            yield j, length, state

    def scan(self, text: bytes) -> tuple[int, list, list, float]:
        """Words, base places (label, start, end), spans (label, start, end, words covered, share) and the best share."""
        words = words_of(text)
        base, anchors, last = [], [], None
        for j, length, state in self.statistics(words):
            for label, size in self.shorter.get(state, ()):
                base.append((label, j - size + 1, j + 1))
            for label, size in self.own.get(state, ()):
                if length == size:
                    base.append((label, j - size + 1, j + 1))
            if last and last[1] >= LEAST_RUN and (j, length) != (last[0] + 1, last[1] + 1):
                anchors.append(last)
            last = (j, length, state)
        if last and last[1] >= LEAST_RUN:
            anchors.append(last)
        spans, best = self.chained(anchors) if anchors else ([], 0.0)
        return len(words), sorted(base, key=lambda b: b[1:]), spans, best

    def chained(self, anchors: list[tuple[int, int, int]]) -> tuple[list, float]:
        """Chains of anchors in each wording, and the largest share of a wording that one covers."""
        of: dict[int, list[tuple[int, int, int]]] = {}
        for j, length, state in anchors:
            for template, end in self.at[state]:
                of.setdefault(template, []).append((j + 1, end, length))
        spans, best = [], 0.0
        for template, places in of.items():
            size = self.sizes[template]
            for covered, start, end in self.chains(places):
                best = max(best, covered / size)
                if covered >= LEAST_SHARE * size:
                    spans.append((self.labels[template], start, end, covered, covered / size))
        return sorted(spans, key=lambda s: (s[1], s[2], s[0])), best

    @staticmethod
    def chains(places: list[tuple[int, int, int]]):
        """(words covered, start, end) of chains that share no anchor, best first; ``places``: (text end, wording end, length)."""
        covered, back, low = [], [], 0
        for i, (text_end, end, length) in enumerate(places):
            most, before = length, -1
            while places[low][0] < text_end - length - MOST_GAP:
                low += 1
            for k in range(low, i):
                other_text, other, _ = places[k]
                # What is new beyond the other anchor, in the text and in the wording alike.
                new = min(length, text_end - other_text, end - other)
                if new > 0 and end - length - other <= MOST_GAP and covered[k] + new > most:
                    most, before = covered[k] + new, k
            covered.append(most)
            back.append(before)
        used = set()
        for i in sorted(range(len(places)), key=lambda i: (-covered[i], i)):
            chain = []
            while i >= 0 and i not in used:
                chain.append(i)
                i = back[i]
            used.update(chain)
            if chain:
                # Where another chain took the front, what is left begins anew.
                total = covered[chain[0]] - (covered[i] if i >= 0 else 0)
                first = places[chain[-1]]
                yield total, first[0] - first[2], places[chain[0]][0]


_BASE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()),
                             ("share", pa.float64())]))


def scan_licenses(df: DataFrame, phrases: dict[str, str] | None = None,
                  templates: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``base`` (places of phrases), ``spans`` (chains that cover enough of a wording) and ``best_share``
    of every text; positions count words from 0, ends are exclusive."""
    phrases, templates = PHRASES if phrases is None else phrases, tuple(TEMPLATES if templates is None else templates)
    kind = df.schema["doc_id"].dataType.simpleString()

    def make():
        scanner = Scanner(phrases, templates)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [scanner.scan(t or b"") for t in texts]
            rows = [[dict(zip(("label", "start", "end"), b)) for b in f[1]] for f in found]
            spans = [[dict(zip(("label", "start", "end", "covered", "share"), s)) for s in f[2]] for f in found]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array(rows, _BASE),
                 pa.array(spans, _SPANS), pa.array([f[3] for f in found], pa.float64())],
                ["doc_id", "n_words", "base", "spans", "best_share"])

        return step

    return map_texts(
        df.select("doc_id", F.col("text").cast("string").alias("text")),
        f"doc_id {kind}, n_words long, base array<struct<label:string,start:long,end:long>>, "
        "spans array<struct<label:string,start:long,end:long,covered:long,share:double>>, best_share double", make)
