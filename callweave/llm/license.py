"""License scans with a generalised suffix automaton of licence tokens.

The automaton is built once on the driver from a fixed set of templates, so
its size is bounded by them, and goes to the workers with the function. A file
is streamed through it word by word; after each word the automaton knows the
longest run of words ending there that occurs in some template (the matching
statistics). Runs that can't grow further and are long enough become matches.

Matches of one template are chained: the chain of the most template words, in
the order of both file and template, is found by dynamic programming, then what
stands before and after it is looked at in the same way. One pass over the file
finds all chains; taking one changes only those near to it. A chain that covers
enough of the template, and all of its numbers, is a span; so version numbers
decide between templates that differ only there. Of spans over the same words
that of the most words stays, so a licence's name isn't taken for a shorter one.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. Null and
empty texts have no word, no span and score 0; texts are streamed whole; ties
between templates go to the one listed first; repeated rows are scanned each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import keyed, map_texts

# Phrases that name a licence outright, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Public licence notices, headings and names, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "apache license version 2 0 january 2004"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "gnu general public license version 2 june 1991"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost-1", "boost software license version 1 0 august 17th 2003"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: A match counts from this many words, or the whole of a shorter template.
MIN_MATCH = 3
#: Share of a template's words that a chain has to cover.
MIN_COVER = 0.8

_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class SuffixAutomaton:
    """Of several word sequences; a state's `at` lists (sequence, end) of one
    longest string of it, through its suffix links of all."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.at: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for end, word in enumerate(seq, 1):
                last = self._extend(last, word)
                self.at[last].append((k, end))
        # A state ends wherever the states below it in the link tree end.
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.at[self.link[v]].extend(self.at[v])

    def _new(self, length: int, link: int, to: dict[bytes, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.at.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another sequence has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return cur

    def statistics(self, words: list[bytes]):
        """(end, state, length) where a matching run can't be extended."""
        state = size = 0
        nexts, link, length = self.next, self.link, self.length
        known = nexts[0]
        for i, word in enumerate(words):
            if not state and word not in known:
                continue
            if word not in nexts[state]:
                yield i, state, size
                while state and word not in nexts[state]:
                    state = link[state]
                    size = length[state]
                if word not in nexts[state]:
                    state = size = 0
                    continue
            state = nexts[state][word]
            size += 1
        if state:
            yield len(words), state, size


@dataclass
class Scan:
    n_words: int
    places: list[tuple[int, str]]  # of phrases: first word, label
    spans: list[tuple[int, int, str, float]] = field(default_factory=list)  # first word, end, label, share of the template


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER):
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.labels = [label for label, _ in templates] + [label for _, label in phrases]
        self.sequences = [words_of(t) for _, t in templates] + [p for p, _ in self.phrases]
        self.numbers = [[i for i, w in enumerate(seq) if w.isdigit()] for seq in self.sequences]
        self.automaton = SuffixAutomaton(self.sequences)
        self.min_match, self.min_cover = min_match, min_cover
        self.first_of = len(templates)

    def scan(self, text: str) -> Scan:
        words = words_of(text)
        places: list[tuple[int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for end, state, size in self.automaton.statistics(words):
            self._phrases_in(words, end - size, end, places)
            if size < self.min_match:
                continue
            s, seen = state, set()
            while s > 0 and (n := min(size, self.automaton.length[s])) >= self.min_match:
                for k, e in self.automaton.at[s]:
                    if (k, e) not in seen:
                        seen.add((k, e))
                        matches.setdefault(k, []).append((end - n, e - n, n))
                s = self.automaton.link[s]
        found = Scan(len(words), sorted(set(places)))
        spans = []
        for k, runs in sorted(matches.items()):
            if k < self.first_of and sum(n for _, _, n in runs) >= self.min_cover * len(self.sequences[k]):
                spans.extend(self._chains(k, sorted(set(runs))))
        found.spans = sorted(longest_of_overlaps(spans))
        return found

    def _phrases_in(self, words, start: int, end: int, places) -> None:
        """A phrase is a sequence of the automaton, so each of its places lies
        inside one run that can't be extended."""
        for phrase, label in self.phrases:
            n = len(phrase)
            for i in range(start, end - n + 1):
                if words[i] == phrase[0] and words[i : i + n] == phrase:
                    places.append((i, label))

    def _chains(self, k: int, runs: list[tuple[int, int, int]]):
        """(first word, end, label, cover, words) of template k's spans, from
        runs in the order of the file: the chain of the most words, of equal ones
        the first, then those of what is left of it and right of it."""
        size = len(self.sequences[k])
        for chain, words in best_chains(runs, size, self.min_cover * size):
            if all(any(t <= i < t + n for _, t, n in chain) for i in self.numbers[k]):
                yield chain[0][0], max(f + n for f, _, n in chain), self.labels[k], words / size, words


#: Words of a chain that can't be.
GONE = -(1 << 60)


class Chains:
    """Of runs (place in the file, place in the template, words), in the order of
    the file, the chains of the most template words. A chain's runs follow each
    other in file and template; where two overlap, the later one counts from the end
    of the other; no gap in the file is above size."""

    def __init__(self, runs: list[tuple[int, int, int]], size: int):
        self.runs, self.size = runs, size
        self.best, self.back = [0] * len(runs), [-1] * len(runs)
        for i in range(len(runs)):
            self._extend(i, 0)

    def _extend(self, i: int, least: int) -> bool:
        """Find run i's best chain of runs from number `least` on; whether it is
        another than before."""
        f, t, n = self.runs[i]
        most, at = n, -1
        for j in range(i - 1, least - 1, -1):
            g, u, m = self.runs[j]
            if f - g > 2 * self.size:
                break
            gain = n - max(0, g + m - f, u + m - t)
            if gain > 0 and t > u and f - g - m <= self.size and self.best[j] + gain > most:
                most, at = self.best[j] + gain, j
        changed = (most, at) != (self.best[i], self.back[i])
        self.best[i], self.back[i] = most, at
        return changed

    def chain(self, i: int) -> list[tuple[int, int, int]]:
        out = []
        while i >= 0:
            out.append(self.runs[i])
            i = self.back[i]
        return out[::-1]


def best_chains(runs: list[tuple[int, int, int]], size: int, least: float):
    """(chain, words) of at least so many words that don't overlap in the file.
    Taking one changes only chains that led into it from the right, so what is
    found anew ends where a window of runs is as before."""
    found = Chains(runs, size)
    queue = [(-found.best[i], i) for i in range(len(runs)) if found.best[i] >= least]
    heapq.heapify(queue)
    starts, cuts = [r[0] for r in runs], []  # cuts: first runs right of what is taken
    while queue:
        words, i = heapq.heappop(queue)
        if found.best[i] != -words:
            continue
        chain = found.chain(i)
        yield chain, -words
        first, end = chain[0][0], max(f + n for f, _, n in chain)
        right = bisect_left(starts, end)
        for j in range(bisect_left(starts, first - size), right):
            if starts[j] + runs[j][2] > first:  # it overlaps the chain, and is in no other one
                found.best[j] = GONE
        insort(cuts, right)
        same = right
        for j in range(right, len(runs)):
            if starts[j] - starts[same] > 2 * size:
                break
            if found.best[j] != GONE and found._extend(j, cuts[bisect_right(cuts, j) - 1]):
                same = j
                if found.best[j] >= least:
                    heapq.heappush(queue, (-found.best[j], j))


def best_chain(runs: list[tuple[int, int, int]], size: int) -> tuple[list[tuple[int, int, int]], int]:
    """The chain of the most words, of equal ones the first, and its words."""
    found = Chains(runs, size)
    i = max(range(len(runs)), key=lambda i: (found.best[i], -i))
    return found.chain(i), found.best[i]


#: Words of a cell of the file in which spans are looked for.
CELL = 64


def longest_of_overlaps(spans):
    """Spans without those of which half or more lies in a span of more words.
    Only spans with a cell in common can overlap."""
    kept: list[tuple] = []
    held: dict[int, list[tuple]] = {}
    for s in sorted(spans, key=lambda s: (-s[4], -s[3])):
        cells = range(s[0] // CELL, (s[1] - 1) // CELL + 1)
        if all(2 * (min(s[1], x[1]) - max(s[0], x[0])) < s[1] - s[0] for c in cells for x in held.get(c, ())):
            kept.append(s)
            for c in cells:
                held.setdefault(c, []).append(s)
    return [s[:4] for s in kept]


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, spans (array of first word, end, label,
    cover) and places (array of first word, label) of the plain phrases."""
    scanner = scanner or Scanner()

    def of_text(text: str) -> tuple:
        s = scanner.scan(text)
        return s.n_words, [dict(zip(("first", "end", "label", "cover"), x)) for x in s.spans], [dict(zip(("first", "label"), x)) for x in s.places]

    return map_texts(keyed(docs, id_col, text_col), of_text, ["n_words", "spans", "places"], ["long", "array<struct<first:long,end:long,label:string,cover:double>>", "array<struct<first:long,label:string>>"])
