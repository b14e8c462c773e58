"""Licence scans: matching statistics of whole texts against a generalised suffix automaton of licence tokens, chained into covered template spans.

The automaton holds every run of words of every template. A text's words pass through it, all texts of a turn in step, which gives for
each word the longest run ending there that some template holds, and the automaton's state. Phrases that end at a word are read off the state and its
suffix links. Long runs that can't be longer are placed in the templates that hold them and chained: later in the text and later in the template, with few
words between. A chain that covers enough of its template is a span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import text_buffers, turns
from foliospark.llm.shingles import ALPHANUMERIC, word_codes, words

# Phrases that count wherever they stand, and their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Passages by which licences are known, and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
            "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
            "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
            "shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
               "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
               "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
            "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
            "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code "
            "must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
            "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
            "permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("public-domain", "this work is in the public domain"),
)

#: Bytes of text of a turn, where texts aren't longer themselves.
TURN = 4 << 20


def tokens(text: str) -> list[str]:
    """Words of a template, as texts have them."""
    data = text.encode()
    starts, ends, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALPHANUMERIC)
    return [data[a:b].decode().translate({i: i + 32 for i in range(65, 91)}) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Automaton:
    """The states are sets of runs of words that end at the same places of the same templates; state 0 is the empty run.

    Words are numbered from 1 in order of their codes; 0 stands for all words that no template has. ``step[s, w]`` is the state after word w, and
    ``kept[s, w]`` how many of the words before it stay in the match (-1: all of them).
    """

    def __init__(self, texts: list[list[str]], phrases: list[int]):
        """``phrases``: numbers of the texts whose whole runs are to be found wherever they stand."""
        self.lengths = np.array([len(t) for t in texts], np.int64)
        vocabulary = sorted({w for t in texts for w in t})
        raw = "".join(vocabulary).encode()
        ends = np.cumsum([len(w.encode()) for w in vocabulary], dtype=np.int64)
        codes = word_codes(np.frombuffer(raw, np.uint8), np.append(0, ends[:-1]), ends) if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        number = {vocabulary[i]: n + 1 for n, i in enumerate(order.tolist())}

        self.longest, self.link, edges, ends_here = [0], [-1], [{}], [set()]  # of each state

        def state(longest: int, link: int, out: dict[int, int]) -> int:
            self.longest.append(longest)
            self.link.append(link)
            edges.append(out)
            ends_here.append(set())
            return len(edges) - 1

        def split(p: int, q: int, word: int) -> int:
            """A state for the runs of q that are one longer than p's; the edges that led from p and its suffixes to q go there."""
            part = state(self.longest[p] + 1, self.link[q], dict(edges[q]))
            self.link[q] = part
            while p >= 0 and edges[p].get(word) == q:
                edges[p][word] = part
                p = self.link[p]
            return part

        def extend(last: int, word: int) -> int:
            q = edges[last].get(word)
            if q is not None:  # another template holds the run already
                return q if self.longest[q] == self.longest[last] + 1 else split(last, q, word)
            new, p = state(self.longest[last] + 1, 0, {}), last
            while p >= 0 and word not in edges[p]:
                edges[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = edges[p][word]
                self.link[new] = q if self.longest[q] == self.longest[p] + 1 else split(p, q, word)
            return new

        for t, text in enumerate(texts):
            last = 0
            for at, w in enumerate(text):
                last = extend(last, number[w])
                ends_here[last].add((t, at + 1))
        shortest_first = sorted(range(len(edges)), key=self.longest.__getitem__)
        for s in reversed(shortest_first[1:]):  # a run ends wherever longer runs that end with it do
            ends_here[self.link[s]] |= ends_here[s]
        ends_here[0] = set()
        #: (template, end) of all places of the runs of a state.
        self.places = [sorted(p) for p in ends_here]

        self.step = np.zeros((len(edges), len(vocabulary) + 1), np.int32)
        self.kept = np.zeros((len(edges), len(vocabulary) + 1), np.int32)
        for s in shortest_first:
            if s:
                up = self.link[s]
                self.step[s] = self.step[up]
                self.kept[s] = np.where(self.kept[up] < 0, self.longest[up], self.kept[up])
            for w, q in edges[s].items():
                self.step[s, w], self.kept[s, w] = q, -1
        #: Numbers of the phrases that end where the runs of a state do, with the length of match that holds them.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in edges]
        own: dict[int, list[tuple[int, int]]] = {}
        for p in phrases:
            s = 0
            for w in texts[p]:
                s = int(self.step[s, number[w]])
            own.setdefault(s, []).append((p, len(texts[p])))
        for s in shortest_first[1:]:
            self.phrases[s] = own.get(s, []) + self.phrases[self.link[s]]
        self.may_end = np.array([bool(p) for p in self.phrases])

    def statistics(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that end a match of two words or more: their numbers, the lengths of match and the states.

        Runs of known words that no row's end cuts pass in step: a step for each word of the longest.
        """
        codes = word_codes(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = np.where(self.codes[at] == codes, at + 1, 0) if len(self.codes) else np.zeros(len(codes), np.int64)
        run = np.flatnonzero(known)
        first = np.ones(len(run), bool)
        first[1:] = np.diff(run) > 1
        cut = np.zeros(len(known) + 1, bool)
        cut[before] = True
        first |= cut[run]
        begin = run[first]
        size = np.diff(np.append(np.flatnonzero(first), len(run)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, length = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        states, lengths = np.zeros(len(known), np.int32), np.zeros(len(known), np.int32)
        for i in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -i, side="left"))  # longer ones stand first
            at, s = begin[:live] + i, state[:live]
            w = known[at]
            kept = self.kept[s, w]
            length[:live] = np.where(kept < 0, length[:live], kept) + 1
            state[:live] = self.step[s, w]
            states[at], lengths[at] = state[:live], length[:live]
        found = np.flatnonzero(lengths > 1)
        return found, lengths[found], states[found]


@dataclass(frozen=True)
class Rules:
    """Words of a match that may be chained; words of text and of template that may lie between two; share of its template that a span covers."""

    least_match: int = 3
    gap: int = 12
    least_share: float = 0.75


@lru_cache(maxsize=2)
def _compiled(phrases: tuple, templates: tuple) -> tuple[Automaton, list[str]]:
    texts = [tokens(t) for _, t in phrases + templates]
    if not all(texts):
        raise ValueError("phrases and templates need a word at least")
    if any(len(t) < 2 for t in texts[:len(phrases)]):
        raise ValueError("phrases need two words at least")
    return Automaton(texts, list(range(len(phrases)))), [n for n, _ in phrases + templates]


def chains(matches: list[tuple[int, int, int]], places: Automaton, rules: Rules) -> list[tuple[int, int, int, int]]:
    """(template, first word, end word, covered words of the template) of the best chains that don't overlap in the text, template by template.

    ``matches``: (end in the text, length, state) in order. A match's last and longest chain is taken; of chains that overlap, that which covers more.
    """
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for end, length, state in matches:
        for t, at in places.places[state]:
            by_template.setdefault(t, []).append((end, at, length))
    out = []
    for t, rows in by_template.items():
        covered, start, back = [0] * len(rows), [0] * len(rows), 0
        longest = max(length for _, _, length in rows)
        for i, (end, at, length) in enumerate(rows):
            covered[i], start[i] = length, end - length
            while rows[back][0] < end - longest - rules.gap:
                back += 1
            for j in range(back, i):
                e, a, _ = rows[j]
                fresh = min(length, end - e, at - a)  # what both sides leave of the match after the one before
                if fresh > 0 and max(end - e, at - a) - fresh <= rules.gap and covered[j] + fresh > covered[i]:
                    covered[i], start[i] = covered[j] + fresh, start[j]
        taken: list[tuple[int, int]] = []
        for i in sorted(range(len(rows)), key=lambda i: (-covered[i], start[i])):
            if covered[i] < rules.least_share * places.lengths[t]:
                break
            if all(rows[i][0] <= a or start[i] >= b for a, b in taken):
                taken.append((start[i], rows[i][0]))
                out.append((t, start[i], rows[i][0], covered[i]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan_turn(raw: np.ndarray, offsets: np.ndarray, automaton: Automaton, rules: Rules) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[tuple[int, int, int, int]]]]:
    """Of each row: the number of words, places of phrases (phrase, first word), and spans."""
    starts, ends, before = words(raw, offsets, ALPHANUMERIC)
    at, length, state = automaton.statistics(raw, starts, ends, before)
    row = np.searchsorted(before, at, side="right") - 1
    n = len(offsets) - 1
    phrases: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    ending = np.flatnonzero(automaton.may_end[state])
    for i, r, m, s in zip(at[ending].tolist(), row[ending].tolist(), length[ending].tolist(), state[ending].tolist(), strict=True):
        for p, size in automaton.phrases[s]:
            if size <= m:
                phrases[r].append((p, i + 1 - size - int(before[r])))
    goes_on = np.zeros(len(at), bool)
    goes_on[:-1] = (np.diff(at) == 1) & (np.diff(length) == 1)
    long = np.flatnonzero((length >= rules.least_match) & ~goes_on)
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    cuts = np.searchsorted(row[long], np.arange(n + 1))
    for r in np.unique(row[long]).tolist():
        mine = long[cuts[r]:cuts[r + 1]]
        spans[r] = chains(list(zip((at[mine] + 1 - before[r]).tolist(), length[mine].tolist(), state[mine].tolist(), strict=True)), automaton, rules)
    return np.diff(before), phrases, spans


_SPAN = "struct<label:string,first_word:long,end_word:long,covered:long,share:double>"


def scan(documents: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, rules: Rules | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` (label and first word of each phrase) and ``spans`` (label, words, covered words and share of the template) of each row.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z as a-z, counted from 0; they are compared as 64-bit hashes. Null and
    empty texts have no words. Every row is answered once, repeated and null ids too; other columns aren't read.
    Templates are short lists held in each task; texts are read whole, a turn of ``TURN`` bytes or one text at a time.
    """
    rules = rules or Rules()
    _compiled(phrases, templates)  # so that faulty templates are an error here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, labels = _compiled(phrases, templates)
        share = lambda t, covered: covered / int(automaton.lengths[t])
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            n_words, places, spans = [np.zeros(0, np.int64)], [], []
            for first, end in turns(offsets, TURN):
                low = offsets[first]
                n, found, chained = scan_turn(raw[low:offsets[end]], offsets[first:end + 1] - low, automaton, rules)
                n_words.append(n)
                places += [[{"label": labels[p], "first_word": at} for p, at in x] for x in found]
                spans += [[{"label": labels[t], "first_word": a, "end_word": b, "covered": c, "share": share(t, c)} for t, a, b, c in x] for x in chained]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n_words), pa.int64()),
                 pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))),
                 pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])))],
                names=["doc_id", "n_words", "places", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, places array<struct<label:string,first_word:long>>, spans array<{_SPAN}>")


def digest(scanned: DataFrame) -> DataFrame:
    """One row of plain columns for each of ``scan``: counts and ends of the phrases' places, labels of phrases and of all, and the score.

    The score is the largest share of a phrase or template that the text covers, among those found (a phrase in full: 1); 0 without any.
    """
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, starts = F.col("places.label"), F.col("places.first_word")
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.col("spans.label"))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"))
