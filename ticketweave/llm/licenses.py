"""License texts in documents: winnowed fingerprints find candidates, banded alignment measures them.

Texts are compared as lower-case runs of ASCII letters and digits and of all
other non-ASCII bytes.

1. *Fingerprints.* Of every window of hashed word runs the smallest is taken.
   Run and window are as long as each template allows: an occurrence with the
   wanted coverage has so few breaks that some stretch of it fills a window, and
   a stretch that template and document share picks the same fingerprint in both.
2. *Inverted index* of the templates' fingerprints, of fixed size, sent to the
   tasks. Each document is looked up where it is read, nothing is shuffled.
3. *Chains.* Hits of one template whose diagonals are within its length.
4. *Alignment* of the whole template in a band around the chain: the spread of
   its diagonals and a fifth of the template on either side.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

# Longest run and window of a fingerprint.
MAX_GRAM, MAX_WINDOW = 3, 8
MIN_COVERAGE = 0.8
MAX_INDEX_BYTES = 16 << 20

# Notices and short texts of common licenses.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "rights reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
    " copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " Software.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
    " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
    ' on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
    " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
    " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"
    " any later version.",
}

# Words that must occur in a row in an occurrence of a short template, so that another license or version is not taken for it.
MARKS = {
    "Apache-2.0 line": ("apache license", "2 0"),
    "CC-BY-NC-4.0 line": ("cc by nc 4 0",),
    "GPL-3.0 line": ("gnu general public license", "version 3"),
    "MIT line": ("mit",),
}

# Letters, digits and non-ASCII bytes make words.
BREAK = np.ones(256, dtype=bool)
for _a, _z in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    BREAK[_a:_z] = False


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = W.split_words(texts, lower=True, breaks=BREAK)
    return W.word_hashes(found), found.rows


def fingerprint_sizes(words: int, min_coverage: float) -> tuple[int, int]:
    """Run length and window for a template: their stretch is one that every occurrence without insertions holds.

    With e words missing, the others form at most e + 1 stretches.
    """
    missing = int((1 - min_coverage) * words + 1e-9)
    stretch = -(-(words - missing) // (missing + 1))
    gram = min(MAX_GRAM, max(stretch - 1, min(stretch, 2)))
    return gram, min(MAX_WINDOW, stretch - gram + 1)


def winnow(hashes: np.ndarray, rows: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all texts and the word each begins at: the smallest run of every window, the last of equal ones."""
    starts = W.window_starts(rows, gram)
    grams = W.range_hashes(hashes, starts, starts + gram, W.WORD_BASE)
    count = np.maximum(np.diff(rows) - gram + 1, 0)
    own = np.concatenate([[0], np.cumsum(count)])
    at = W.window_starts(own, window)
    chosen = at.copy()
    for shift in range(1, window):
        chosen = np.where(grams[at + shift] <= grams[chosen], at + shift, chosen)
    # A text of fewer runs than a window keeps them all.
    short = np.flatnonzero((count > 0) & (count < window))
    rest = [np.arange(own[i], own[i + 1]) for i in short]
    chosen = np.unique(np.concatenate([chosen, *rest]))
    return grams[chosen], starts[chosen]


class _Postings:
    """Sorted fingerprints of one size with the template and position of each."""

    def __init__(self, entries: list[tuple[np.ndarray, int, np.ndarray]]):
        grams = np.concatenate([g for g, _, _ in entries])
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.owner = np.concatenate([np.full(len(g), number) for g, number, _ in entries])[order]
        self.place = np.concatenate([p for _, _, p in entries])[order]

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among ``grams``, entry here) of every hit."""
        first = np.searchsorted(self.grams, grams, side="left")
        count = np.searchsorted(self.grams, grams, side="right") - first
        at = np.repeat(np.arange(len(grams)), count)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, np.repeat(first, count) + inner


class Index:
    """The inverted index of the templates' fingerprints, by their sizes."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE, marks: dict[str, tuple[str, ...]] | None = None):
        self.names = sorted(templates)
        self.words = [_hashes(pa.array([templates[name]]))[0] for name in self.names]
        by_size = defaultdict(list)
        for number, (name, own) in enumerate(zip(self.names, self.words)):
            if not 0 < len(own) <= 0xFFFF:
                raise ValueError(f"template {name!r} has no or more than {0xFFFF} words")
            sizes = fingerprint_sizes(len(own), min_coverage)
            grams, places = winnow(own, np.array([0, len(own)]), *sizes)
            by_size[sizes].append((grams, number, places))
        self.postings = {sizes: _Postings(entries) for sizes, entries in by_size.items()}
        self.marks = [[_hashes(pa.array([m]))[0] for m in (marks or {}).get(name, ())] for name in self.names]
        if sum(w.nbytes for w in self.words) + 3 * sum(p.grams.nbytes for p in self.postings.values()) > MAX_INDEX_BYTES:
            raise ValueError("the templates are too large to send to every task")

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of all texts, template, place in the template) of every hit, by word."""
        found = [(np.zeros(0, np.int64),) * 3]
        for (gram, window), postings in self.postings.items():
            grams, starts = winnow(hashes, rows, gram, window)
            at, entry = postings.lookup(grams)
            found.append((starts[at], postings.owner[entry], postings.place[entry]))
        word, owner, place = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(word, kind="stable")
        return word[order], owner[order], place[order]


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best alignment of the whole template in a band: (matched words, start, end in text).

    Word i of the template may stand at words i + ``low`` to i + ``high`` of the
    text. A match scores 2, a substitution or gap -1; the text's ends are free.
    """
    # A cell packs score, matched words and start, so that the larger one is the better one.
    score, match, never = 1 << 44, 1 << 28, -(1 << 62)
    place = np.arange(low, high + 1, dtype=np.int64)  # where a template's first i words may end, less i
    steps = np.arange(len(place), dtype=np.int64) * score
    row = np.where((place >= 0) & (place <= len(text)), place, never)
    for i, word in enumerate(template):
        end = place + i + 1
        here = np.clip(end - 1, 0, max(len(text) - 1, 0))
        same = (end >= 1) & (end <= len(text)) & (text[here] == word) if len(text) else np.zeros(len(end), dtype=bool)
        new = row + np.where(same, 2 * score + match, -score)
        # Past either border of the text there is no word to substitute.
        new[(end < 1) | (end > len(text))] = never
        np.maximum(new[:-1], row[1:] - score, out=new[:-1])
        new[(end < 0) | (end > len(text))] = never
        row = np.maximum.accumulate(new + steps) - steps
        row[(row < never // 2) | (end < 0) | (end > len(text))] = never
    best = int(np.argmax(row >> 44))
    if row[best] == never:
        return 0, 0, 0
    return int(row[best] >> 28) & 0xFFFF, int(row[best]) & (match - 1), int(place[best]) + len(template)


def _runs_at(text: np.ndarray, run: np.ndarray) -> bool:
    return len(text) >= len(run) and bool((np.lib.stride_tricks.sliding_window_view(text, len(run)) == run).all(axis=1).any())


def occurrences(
    template: np.ndarray, text: np.ndarray, low: int, high: int, min_coverage: float, marks: list[np.ndarray]
) -> list[tuple[int, int, int]]:
    """(start, end, matched) of the best alignment in the band, then of what lies before and after it."""
    need = min_coverage * len(template)
    found, parts = [], [(max(0, low), min(len(text), high + len(template)))]
    while parts:
        a, z = parts.pop()
        part = text[max(a, 0) : z]
        # Too few of the template's words: no alignment can reach the coverage.
        if len(part) < need or np.isin(template, part).sum() < need:
            continue
        lowest, highest = max(low - a, -len(template)), min(high - a, len(part))
        if lowest > highest:
            continue
        matched, start, end = align(template, part, lowest, highest)
        if matched >= need and all(_runs_at(part[start:end], m) for m in marks):
            found.append((a + start, a + end, matched))
        if end > start:
            parts += [(a, a + start), (a + end, z)]
    return found


def spans_of(index: Index, text: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray, min_coverage: float) -> list[tuple]:
    """Aligned occurrences in one text: (template, start, end, matched, words), no two overlapping."""
    found = []
    for number in np.unique(owner).tolist():
        template, size = index.words[number], len(index.words[number])
        diagonals = np.unique((at - place)[owner == number])
        slack = size // 5 + 1
        while len(diagonals):
            # A chain: hits within a template's length, with room for as many inserted words: more cost more than they join.
            near = int(np.searchsorted(diagonals, diagonals[0] + size, side="right"))
            low, high = int(diagonals[0]) - slack, int(diagonals[near - 1]) + slack
            diagonals = diagonals[near:]
            for start, end, matched in occurrences(template, text, low, high, min_coverage, index.marks[number]):
                found.append((number, start, end, matched, size))
    return apart(found)


def apart(found: list[tuple]) -> list[tuple]:
    """Of overlapping occurrences the one with more matched words, then the shorter, then that of the smaller name."""
    found = sorted(set(found), key=lambda f: (-f[3], f[2] - f[1], f[0], f[1]))
    starts: list[int] = []
    taken: dict[int, tuple] = {}
    for one in found:
        place = bisect.bisect_left(starts, one[1])
        clear = place == 0 or taken[starts[place - 1]][2] <= one[1]
        if clear and (place == len(starts) or one[2] <= starts[place]):
            starts.insert(place, one[1])
            taken[one[1]] = one
    return [taken[s] for s in starts]


SPANS = "doc_id bigint, license string, start int, end int, matched int, words int, coverage double"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Where documents (doc_id, text) hold a license text: a row per occurrence.

    Returns doc_id, license (name of the template), start and end (range of
    words, letters-and-digits runs counted from 0), matched (template words
    found in order), words (of the template) and coverage. Of overlapping
    occurrences the one with more matched words is reported, ties going to the
    shorter span, then to the smaller name. Short templates of ``TEMPLATES`` are
    reported only where their license and version (``MARKS``) agree.

    Null and empty texts hold none. Repeated rows are reported each; null ids
    are kept. Other columns are not used.
    """
    index = Index(TEMPLATES, min_coverage, MARKS) if templates is None else Index(templates, min_coverage)

    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text"):
                hashes, rows = _hashes(piece.column("text"))
                word, owner, place = index.hits(hashes, rows)
                bounds = np.searchsorted(word, rows)
                out = []
                for row in np.flatnonzero(np.diff(bounds)):
                    own = slice(bounds[row], bounds[row + 1])
                    text = hashes[rows[row] : rows[row + 1]]
                    for t, start, end, matched, size in spans_of(index, text, word[own] - rows[row], owner[own], place[own], min_coverage):
                        out.append((int(row), index.names[t], start, end, matched, size, round(matched / size, 6)))
                if out:
                    columns = list(zip(*out))
                    types = [pa.string(), *[pa.int32()] * 4, pa.float64()]
                    arrays = [piece.column("doc_id").take(pa.array(columns[0]))]
                    arrays += [pa.array(c, t) for c, t in zip(columns[1:], types)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SPANS.split(", ")])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, SPANS)
