"""Operator 1: licence scans by a generalised suffix automaton over words."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.common import blocks
from factlake.llm.license_texts import PHRASES, TEMPLATES

#: In UTF-8 the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ are these bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(data: bytes) -> list[bytes]:
    return _WORD.findall(data.lower())


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; ``ends`` has the places of each state's strings."""

    sequences: list[list[int]]
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for sequence in self.sequences:
            state = 0
            for word in sequence:
                state = self._extend(state, word)
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.step]
        for number, sequence in enumerate(self.sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self.step[state][word]
                self.ends[state].add((number, place))
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state of parent's string plus ``word`` alone, cloned off a longer one if need be."""
        old = self.step[parent][word]
        if self.length[old] == self.length[parent] + 1:
            return old
        clone = self._state(self.length[parent] + 1, dict(self.step[old]), self.link[old])
        self.link[old] = clone
        while parent >= 0 and self.step[parent].get(word) == old:
            self.step[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def walk(self, stream: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: for each word the state and length of the longest match that ends there."""
        state = length = 0
        for word in stream:
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.step[state]:
                state, length = self.step[state][word], length + 1
            yield state, length


class Scanner:
    """Phrases and templates compiled once; ``scan`` works on one text.

    Maximal matches of at least ``min_match`` words are chained to spans of a template if they follow
    each other in text and template with at most ``max_gap`` words between; a span counts from a covered
    share of ``min_cover`` of its template.
    """

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], min_match: int, max_gap: int, min_cover: float):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        named = [(label, words(text.encode())) for text, label in phrases.items()]
        named += [(label, words(text.encode())) for label, text in templates]
        self.labels = [label for label, _ in named]
        self.phrases = len(phrases)
        self.ids = {w: i for i, w in enumerate(sorted({w for _, s in named for w in s}))}
        sequences = [[self.ids[w] for w in s] for _, s in named]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        n = len(self.ids)
        self.pairs = np.zeros((n + 1, n + 1), bool)  # the last row and column stand for unknown words
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True
        self.single = {s[0] for s in sequences[: self.phrases] if len(s) == 1}
        #: for each state the phrases that its strings end with
        self.ending: list[list[int]] = []
        for state, length in enumerate(self.automaton.length):
            self.ending.append([p for p in range(self.phrases) if (p, self.sizes[p] - 1) in self.automaton.ends[state] and self.sizes[p] <= length])
        for state in sorted(range(1, len(self.ending)), key=self.automaton.length.__getitem__):
            parent = self.automaton.link[state]
            self.ending[state] = sorted({*self.ending[parent], *self.ending[state]})

    def scan(self, data: bytes | None) -> tuple:
        """``(n_words, n_base, first, last, base_labels, labels, score, spans)`` of one text."""
        get, unknown = self.ids.get, len(self.ids)
        found = [np.array([get(w, unknown) for w in words(block)], np.int32) for block in blocks(data or b"")]
        ids = np.concatenate(found)
        places: list[tuple[int, int]] = []  # of phrases: first word, phrase
        matches: list[tuple[int, int, int]] = []  # maximal: first word, length, state
        joined = self.pairs[ids[:-1], ids[1:]]
        if joined.any():
            edges = np.flatnonzero(np.diff(joined.astype(np.int8), prepend=0, append=0))
            for begin, end in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist()):
                self._run(ids[begin:end].tolist(), begin, places, matches)
        for word in self.single:
            phrase = next(p for p in range(self.phrases) if self.sizes[p] == 1 and word in self.automaton.step[0])
            places += [(int(i), phrase) for i in np.flatnonzero(ids == word)]
        base = {self.labels[p] for _, p in places}
        spans = self._chain(matches)
        labels = base | {self.labels[t] for *_, t in spans}
        score = 1.0 if base else max((s[2] for s in spans), default=0.0)
        shown = [f"{self.labels[t]}:{a}:{b}:{c:.4f}" for a, b, c, t in spans]
        starts = [i for i, _ in places]
        return (
            len(ids), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), float(score), ",".join(shown),
        )

    def _run(self, run: list[int], begin: int, places: list, matches: list) -> None:
        states = [*self.automaton.walk(run), (0, 0)]
        for i, (state, length) in enumerate(states[:-1]):
            for phrase in self.ending[state]:
                if 1 < self.sizes[phrase] <= length:
                    places.append((begin + i + 1 - self.sizes[phrase], phrase))
            if length >= self.min_match and states[i + 1][1] <= length:
                matches.append((begin + i + 1 - length, length, state))

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, float, int]]:
        """Covered template spans: first word, last word, covered share, template.

        A match that stands at several places of a template has a chain for each place.  It goes on from the open chain
        that leaves it the most covered words; words of the text or template that the chain has already do
        not count again.  Of chains of one template that overlap in the text the best covered one stays.
        """
        found: dict[int, list[tuple[int, int, int]]] = {}  # of a template: covered words, first word, last word
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # last word, place, covered words, first word
        for begin, length, state in matches:
            last, places = begin + length - 1, {}
            for t, place in self.automaton.ends[state]:
                if t >= self.phrases:
                    places.setdefault(t, []).append(place)
            for t, ends in places.items():
                live = [c for c in open_.get(t, ()) if begin - c[0] - 1 <= self.max_gap]
                new = []
                for place in ends:
                    best = (length, begin)
                    for end, before, covered, start in live:
                        fresh = min(place - before, last - end, length)
                        if fresh > 0:
                            best = max(best, (covered + fresh, start))
                    new.append((last, place, *best))
                    if best[0] >= self.min_cover * self.sizes[t]:
                        found.setdefault(t, []).append((best[0], best[1], last))
                open_[t] = live + new
        spans = []
        for t, chains in found.items():
            taken: list[tuple[int, int]] = []  # kept apart and sorted
            for covered, first, last in sorted(set(chains), key=lambda c: (-c[0], c[1], c[2])):
                i = bisect.bisect(taken, (first, last))
                if (not i or taken[i - 1][1] < first) and (i == len(taken) or last < taken[i][0]):
                    taken.insert(i, (first, last))
                    spans.append((first, last, covered / self.sizes[t], t))
        return sorted(spans, key=lambda s: (s[0], s[1], self.labels[s[3]], s[3]))


_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string()),
]


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    min_match: int = 4,
    max_gap: int = 8,
    min_cover: float = 0.5,
) -> DataFrame:
    """One row for each row of ``docs``: its id and what ``Scanner.scan`` finds in its whole text.

    ``spans`` has ``label:first:last:share`` of each template span, words from 0, in text order.
    ``score`` is 1 with any phrase, else the largest covered share of a template, else 0.  Null and
    empty texts have no words, score 0, empty labels and null places.  Repeated rows stay repeated;
    other columns are not read.  The automaton is built from the fixed wording and sent with the task;
    there is no shuffle, and a text is worked through in blocks.
    """
    scanner = Scanner(phrases, templates, min_match, max_gap, min_cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *(n for n, _ in _FIELDS)])

    kind = docs.schema[id_col].dataType.simpleString()
    sql = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double"}
    schema = ", ".join([f"doc_id {kind}", *(f"{n} {sql[t]}" for n, t in _FIELDS)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_license_scan``: phrases and templates in every document."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
