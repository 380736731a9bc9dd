"""Licence scan by a generalised suffix automaton of template words.

The automaton holds every run of words of every template.  A text streams
through it and yields matching statistics: at each word, the longest run ending
there that some template contains.  Base phrases are templates too and are read
off the states on the way.  Where longest matches have three words or more, the
templates that share a run of three words with that stretch of text get their own
matching statistics there, each by its own automaton.  A template's matches are
then chained, in order in both text and template and over small gaps; a chain
that covers enough of a template is a span of that template's licence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.license_texts import NOTICES, TEXTS
from spanlens.llm.textbytes import alnum_words, map_texts, utf8

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Whole licence texts and short notices.
TEMPLATES = TEXTS + NOTICES

LEAST_MATCH = 3
MOST_GAP = 8
LEAST_COVER = 0.8


class SuffixAutomaton:
    """All substrings of several sequences; a state is a set of them with the same ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        ends: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for k, sequence in enumerate(sequences):
            at = 0
            for i, symbol in enumerate(sequence):
                at = self.next[at][symbol]
                ends[at].add((k, i + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        ends[0] = set()
        #: where in the sequences the strings of a state end: (sequence, end)
        self.ends = [sorted(e) for e in ends]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A state for the strings of ``target`` that follow ``state``, made if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # the sequence so far is known from another
            return self._split(last, symbol, self.next[last][symbol])
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, symbol, self.next[state][symbol])
        return new

    def matches(self, sequence: list[int]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Longest runs of ``LEAST_MATCH`` or more that also stand here: where they lie, and where they end here."""
        state = size = 0
        for i, symbol in enumerate(sequence):
            if symbol not in self.next[state]:
                if size >= LEAST_MATCH:
                    yield i - size, i, self.ends[state]
                while state and symbol not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                size += 1
        if size >= LEAST_MATCH:
            yield len(sequence) - size, len(sequence), self.ends[state]

    def find(self, sequence: list[int]) -> int:
        state = 0
        for symbol in sequence:
            state = self.next[state][symbol]
        return state


def _merged(matches: list[tuple[int, int]]) -> list[list[int]]:
    """Intervals in order of their ends as disjoint stretches."""
    out: list[list[int]] = []
    for lo, hi in matches:
        while out and lo < out[-1][1]:
            lo = min(lo, out.pop()[0])
        out.append([lo, hi])
    return out


class LicenseScanner:
    def __init__(self, base=BASE, templates=TEMPLATES):
        lines = [alnum_words(text.encode()) for text in [phrase for phrase, _ in base] + [text for _, text in templates]]
        self.labels = [label for _, label in base] + [label for label, _ in templates]
        self.n_base = len(base)
        self.codes: dict[bytes, int] = {}
        coded = [[self.codes.setdefault(w, len(self.codes) + 1) for w in line] for line in lines]
        self.sizes = [len(line) for line in lines]
        self.automaton = SuffixAutomaton(coded)
        self.shortest = min(self.sizes)
        self.own = {k: SuffixAutomaton([coded[k]]) for k in range(self.n_base, len(lines))}
        self.grams: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for k in self.own:
            for i in range(len(coded[k]) - LEAST_MATCH + 1):
                self.grams[tuple(coded[k][i : i + LEAST_MATCH])].add(k)
        # phrases that end wherever a state's longest string ends: (length, phrase)
        here = defaultdict(list)
        for k in range(self.n_base):
            here[self.automaton.find(coded[k])].append((len(coded[k]), k))
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.automaton.next)
        for state in sorted(range(1, len(self.phrases)), key=lambda s: self.automaton.length[s]):
            self.phrases[state] = (*here.get(state, ()), *self.phrases[self.automaton.link[state]])

    def _runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Runs of template words that are as long as the shortest template at least."""
        codes = np.fromiter(map(self.codes.get, words, repeat(0)), np.int32, len(words))
        inside = np.concatenate([[False], codes != 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo >= self.shortest:
                yield lo, codes[lo:hi].tolist()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """``(words, base hits (start, phrase), spans (template, start, stop, cover))``."""
        words = alnum_words(text)
        follow, link, length, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        hits: list[tuple[int, int]] = []
        stretches: list[tuple[int, list[int]]] = []  # where matches of some length lie: start, codes
        for begin, codes in self._runs(words):
            state = size = 0
            matches: list[tuple[int, int]] = []
            for i, symbol in enumerate(codes):
                if symbol not in follow[state]:
                    if size >= LEAST_MATCH:
                        matches.append((i - size, i))
                    while state and symbol not in follow[state]:
                        state = link[state]
                        size = length[state]
                if symbol in follow[state]:
                    state = follow[state][symbol]
                    size += 1
                for n, k in phrases[state]:
                    if n <= size:
                        hits.append((begin + i + 1 - n, k))
            if size >= LEAST_MATCH:
                matches.append((len(codes) - size, len(codes)))
            for lo, hi in _merged(matches):
                stretches.append((begin + lo, codes[lo:hi]))
        return len(words), hits, self._chain(stretches) if stretches else []

    def _chain(self, stretches: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, float]]:
        """Spans of templates whose chained matches cover enough of them."""
        by_template: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for begin, codes in stretches:
            grams = zip(*[codes[i:] for i in range(LEAST_MATCH)])
            for k in sorted(set().union(*[self.grams.get(g, ()) for g in grams])):
                by_template[k] += [(begin + lo, begin + hi, end - (hi - lo), end) for lo, hi, ends in self.own[k].matches(codes) for _, end in ends]
        spans = []
        for k, found in by_template.items():
            found.sort()
            best: list[tuple[int, int]] = []  # (covered words, start of the chain)
            for j, (ts, te, ps, pe) in enumerate(found):
                top = (te - ts, ts)
                for i in range(j - 1, -1, -1):
                    before = found[i]
                    if ts - before[0] > MOST_GAP + self.sizes[k]:
                        break
                    if ts - before[1] > MOST_GAP or before[0] >= ts or before[2] >= ps:
                        continue
                    more = min(te - max(ts, before[1]), pe - max(ps, before[3]))
                    if more > 0 and best[i][0] + more > top[0]:
                        top = (best[i][0] + more, best[i][1])
                best.append(top)
            taken_to = -1
            ranked = [(start, f[1], covered / self.sizes[k]) for f, (covered, start) in zip(found, best) if covered >= LEAST_COVER * self.sizes[k]]
            for start, stop, cover in sorted(ranked, key=lambda r: (r[0], -r[2], r[1])):
                if start >= taken_to:
                    spans.append((k, start, stop, min(1.0, cover)))
                    taken_to = stop
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, base, spans, score)``, a row for each row of ``docs``.

    ``base`` lists ``(start, label)`` of every place of a base phrase, ``spans`` the
    ``(label, start, stop, cover)`` of covered templates, both in order of place;
    words count from 0.  ``score`` is the largest cover, 1 where a base phrase
    stands, else 0.  Null and empty texts have no words; repeated rows are
    scanned each; other columns are not read.
    """
    schema = "doc_id long, n_words long, base array<struct<start: long, label: string>>, spans array<struct<label: string, start: long, stop: long, cover: double>>, score double"
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(base, templates)
        for batch in batches:
            rows = [scanner.scan(t) for t in utf8(batch.column(1))]
            label = scanner.labels
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([[{"start": s, "label": label[k]} for s, k in sorted(h)] for _, h, _ in rows], base_type),
                    pa.array([[{"label": label[k], "start": a, "stop": b, "cover": c} for k, a, b, c in s] for _, _, s in rows], span_type),
                    pa.array([1.0 if h else max((c for *_, c in s), default=0.0) for _, h, s in rows], pa.float64()),
                ],
                names=["doc_id", "n_words", "base", "spans", "score"],
            )

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)
