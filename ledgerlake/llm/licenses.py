"""Licence scan: a generalised suffix automaton of licence texts, streamed documents, chained matches.

The automaton accepts every substring of the templates' word sequences. Streaming a document gives, at each
word, the longest match that ends there (matching statistics). Maximal matches of at least ``LEAST_MATCH`` words
are located in their templates; matches that follow each other in document and template, with small gaps, are
chained, and the share of a template's words that its best chain covers decides its label. Words that no template
holds end a match at once, so most text is passed over by comparing word hashes alone.

Beside the templates, fixed phrases give base labels wherever their words stand consecutively; places may overlap.
Lower-casing is A-Z only. Null texts are empty: no places, no labels, score 0. Repeated rows are scanned alike;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.wordhash import words

KIND = "alnum_lower"
LEAST_MATCH = 4
MOST_GAP = 12
LEAST_COVER = 0.75

# Phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Characteristic passages of public licence texts and common notices, with their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license you may obtain a copy of the license at http www apache org licenses "
                   "license 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met redistributions of source code must retain the above copyright notice "
            "this list of conditions and the following disclaimer"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version 3 of the license or at your "
            "option any later version"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
                "was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify "
                  "publish use compile sell or distribute this software"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all "
            "of his or her rights to the work worldwide under copyright law"),
]


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences; each state knows one template place where it ends."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, template: int, symbols: list[int]) -> None:
        last = 0
        for at, c in enumerate(symbols):
            if c in self.next[last]:
                q = self.next[last][c]
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                p, last = last, self._state(self.length[last] + 1, {}, 0)
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = last
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][c]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            self.ends[last].add((template, at))

    def close(self) -> SuffixAutomaton:
        """Pass end places on to suffix links, longest states first."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]
        return self

    def maximal_matches(self, symbols: list[int], least: int):
        """(start, length, template ends) of matches of at least ``least`` symbols that cannot be extended."""
        state = size = 0
        for i, c in enumerate([*symbols, None]):
            if c not in self.next[state]:
                if size >= least:
                    yield i - size, size, self.ends[state]
                while state and c not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            else:
                state = size = 0


class Scanner:
    """Templates and phrases over word hashes."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _ in templates]
        hashed = [self._hashes(t) for _, t in templates]
        self.sizes = [len(h) for h in hashed]
        self.vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
        self.automaton = SuffixAutomaton()
        for k, h in enumerate(hashed):
            self.automaton.add(k, np.searchsorted(self.vocabulary, h).tolist())
        self.automaton.close()
        self.phrases = [(label, self._hashes(p)) for p, label in phrases.items()]

    @staticmethod
    def _hashes(text: str) -> np.ndarray:
        return next(words(pa.array([text]), KIND)).hashes

    def phrase_places(self, h: np.ndarray, row: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Word index of every place of each phrase."""
        out = []
        for label, p in self.phrases:
            at = np.flatnonzero(h[:len(h) - len(p) + 1] == p[0]) if len(h) >= len(p) else np.zeros(0, np.int64)
            for k in range(1, len(p)):
                at = at[h[at + k] == p[k]]
            out.append((label, at[row[at] == row[at + len(p) - 1]] if len(at) else at))
        return out

    def matches(self, symbols: np.ndarray, known: np.ndarray, lo: int, hi: int):
        """Maximal matches within words lo to hi: stretches of template words are streamed through the automaton."""
        edge = np.diff(known[lo:hi].astype(np.int8), prepend=0, append=0)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b - a >= LEAST_MATCH:
                for start, size, ends in self.automaton.maximal_matches(symbols[lo + a:lo + b].tolist(), LEAST_MATCH):
                    yield a + start, size, ends

    def covered(self, matches) -> dict[str, float]:
        """Best chain per label: share of a template's words that it covers. Matches come in document order."""
        chains: dict[int, list[tuple[int, int, int]]] = {}  # per template: document end, template end, words
        best: dict[int, int] = {}
        for start, size, ends in matches:
            for k, end in ends:
                begin = end - size + 1
                near = [c for c in chains.get(k, ()) if c[0] >= start - MOST_GAP]
                n = size + max((n for d, t, n in near if d <= start and 0 <= begin - t <= MOST_GAP), default=0)
                chains[k] = [*near, (start + size, end + 1, n)]
                best[k] = max(n, best.get(k, 0))
        out: dict[str, float] = {}
        for k, n in best.items():
            out[self.labels[k]] = max(out.get(self.labels[k], 0.0), min(1.0, n / self.sizes[k]))
        return out


_RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double, covers map<string,double>")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row: n_words, places and labels of phrases, labels of templates, score (best cover; 1 with a phrase), covers."""
    given = (TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)

    def run(batches):
        scanner = Scanner(*given)
        for batch in batches:
            for w in words(batch.column("text"), KIND):
                n = w.rows
                row = w.row_of()
                n_base = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                for label, at in scanner.phrase_places(w.hashes, row):
                    r, place = row[at], at - w.bound[row[at]]
                    np.add.at(n_base, r, 1)
                    np.minimum.at(first, r, place)
                    np.maximum.at(last, r, place)
                    for k in np.unique(r).tolist():
                        base[k].add(label)
                covers: list[dict[str, float]] = [{} for _ in range(n)]
                v = scanner.vocabulary
                slot = np.minimum(np.searchsorted(v, w.hashes), max(0, len(v) - 1))
                known = v[slot] == w.hashes if len(v) else np.zeros(len(w.hashes), bool)
                opens = np.zeros(len(known), bool)  # first words of rows, and words after an unknown one
                opens[1:] = ~known[:-1]
                opens[w.bound[:-1][np.diff(w.bound) > 0]] = True
                start = np.flatnonzero(known & opens)
                for k in np.unique(row[start]).tolist():
                    found = list(scanner.matches(slot, known, int(w.bound[k]), int(w.bound[k + 1])))
                    covers[k] = scanner.covered(found) if found else {}
                more = [sorted(b | {x for x, s in c.items() if s >= LEAST_COVER}) for b, c in zip(base, covers)]
                score = [max([1.0 if b else 0.0, *c.values()]) for b, c in zip(base, covers)]
                none = n_base == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[w.first:w.first + n], pa.array(np.diff(w.bound)), pa.array(n_base),
                    pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
                    pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(m) for m in more]),
                    pa.array(score, pa.float64()), pa.array([list(c.items()) for c in covers], pa.map_(pa.string(), pa.float64()))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "covers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _RESULT)
