"""Licence scan by a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template and phrase.  A text's words stream
through it, which gives at each word the longest run ending there that some template holds
(matching statistics).  Where such a run cannot go on it is a match; matches of ``LEAST``
words or more are chained for each template: a match goes on the chain if it lies at most ``GAP``
words behind in the text and further on in the template, at the nearest such place.  A chain that
covers ``COVERED`` of a template is a span with the template's label.  A phrase stands wherever its
state is the current one or a suffix of it.

Words that no template holds end every run, and are found by one exact Arrow lookup for a
slice of texts, so only words of templates take steps in Python.

Defined cases: null or empty text has no words; repeated rows are scanned one by one; an empty
table gives an empty result; a null id is kept; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.license_templates import PHRASES, TEMPLATES
from rubrica.llm.shared import slices
from rubrica.llm.units import binary_array

LEAST = 5
GAP = 40
COVERED = 0.5

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_SPAN = "struct<label: string, template: int, first_word: long, last_word: long, covered: long, share: double>"
_FOUND = f"doc_id long, n_words long, phrases array<struct<label: string, at: long>>, spans array<{_SPAN}>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


class SuffixAutomaton:
    """All runs of words of several word lists; states know where in which list they end."""

    def __init__(self, lists: list[list[int]]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for number, words in enumerate(lists):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                ends.append((last, number, at))
        children: list[list[int]] = [[] for _ in self.go]
        for state, parent in enumerate(self.link):
            if parent >= 0:
                children[parent].append(state)
        own: list[list[tuple[int, int]]] = [[] for _ in self.go]
        for state, number, at in ends:
            own[state].append((number, at))
        #: Places (list, index of the last word) in such an order that a state's are places[first:stop].
        self.places: list[tuple[int, int]] = []
        self.first, self.stop = [0] * len(self.go), [0] * len(self.go)
        stack = [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                self.stop[state] = len(self.places)
                continue
            self.first[state] = len(self.places)
            self.places += own[state]
            stack.append((state, True))
            stack += [(c, False) for c in children[state]]

    def _new(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        return len(self.go) - 1

    def _split(self, state: int, target: int, word: int) -> int:
        """The state of state's run and ``word``; a copy of ``target`` if that also stands for longer runs."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.go[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.go[state].get(word) == target:
            self.go[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.go[last]:
            return self._split(last, self.go[last][word], word)
        new = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.go[state]:
            self.go[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, self.go[state][word], word)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest run that ends with ``word``."""
        while word not in self.go[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return self.go[state][word], length + 1

    def find(self, words: list[int]) -> int:
        state = 0
        for w in words:
            state = self.go[state][w]
        return state


class LicenseScanner:
    """Automaton of templates and phrases, with what is to be looked for."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least: int = LEAST, gap: int = GAP, covered: float = COVERED):
        self.templates, self.phrases = list(templates), list(phrases)
        self.least, self.gap, self.covered = least, gap, covered
        lists = [words_of(text) for _, text in [*self.templates, *self.phrases]]
        self.vocabulary = pa.array(sorted({w for words in lists for w in words}), pa.large_binary())
        number = {w: k for k, w in enumerate(self.vocabulary.to_pylist())}
        coded = [[number[w] for w in words] for words in lists]
        self.sizes = [len(words) for words in coded[: len(self.templates)]]
        self.automaton = SuffixAutomaton(coded)
        #: Phrases (words, number) that end wherever the state is reached with that many words.
        self.ending: list[list[tuple[int, int]]] = [[] for _ in self.automaton.go]
        own: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(coded[len(self.templates) :]):
            if words:
                own.setdefault(self.automaton.find(words), []).append((len(words), k))
        for state in range(1, len(self.automaton.go)):
            at = state
            while at > 0:
                self.ending[state] += own.get(at, [])
                at = self.automaton.link[at]
        self.shortest = min([least, *(n for found in own.values() for n, _ in found)])

    def statistics(self, at: list[int], words: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrases (number, first word) and matches (end, words, state) of one text's template words and their places."""
        go, link, lengths, ending, least = self.automaton.go, self.automaton.link, self.automaton.length, self.ending, self.least
        phrases, matches = [], []
        state = n = 0
        before = -2
        for i, w in zip(at, words):
            last, length = state, n
            if i != before + 1:
                state = n = 0
            while w not in go[state]:
                state = link[state]
                if state < 0:
                    state, n = 0, -1
                    break
                n = lengths[state]
            state = go[state].get(w, 0)
            n += 1
            if length >= least and n != length + 1:
                matches.append((before, length, last))
            if ending[state]:
                phrases += [(k, i - size + 1) for size, k in ending[state] if n >= size]
            before = i
        if n >= least:
            matches.append((before, n, state))
        return phrases, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, words covered) of the chains that cover enough of a template."""
        chains: dict[int, list[int]] = {}  # template -> first and last word in the text, last place in the template, words
        out = []

        def close(template: int) -> None:
            first, last, _, words = chains.pop(template)
            if words >= self.covered * self.sizes[template]:
                out.append((template, first, last, words))

        for end, n, state in matches:
            places: dict[int, list[int]] = {}
            for number, at in self.automaton.places[self.automaton.first[state] : self.automaton.stop[state]]:
                if number < len(self.sizes):
                    places.setdefault(number, []).append(at)
            for template, ends in sorted(places.items()):
                chain = chains.get(template)
                best = None
                if chain is not None and end - n + 1 - chain[1] <= self.gap:
                    # New words: behind both the chain's last word and its last place.
                    best = min((p for p in ends if p > chain[2]), default=None)
                if best is not None:
                    new = min(n, end - chain[1], best - chain[2])
                    chains[template] = [chain[0], end, best, chain[3] + new]
                    continue
                if chain is not None:
                    close(template)
                chains[template] = [end - n + 1, end, min(ends), n]
        for template in sorted(chains):
            close(template)
        return sorted(out, key=lambda s: (s[1], s[0], s[2]))

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[tuple[int, int, int, int]]]]:
        """Number of words, phrases and spans of each text."""
        rows = [(t or "").encode().translate(_PLAIN) for t in texts.to_pylist()]
        data = np.frombuffer(b" " + b" ".join(rows) + b" ", np.uint8)
        inside = data != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        bounds = np.r_[0, np.searchsorted(start, np.cumsum([len(r) + 1 for r in rows]) + 1)].astype(np.int64)
        words = binary_array(data[inside], np.r_[0, np.cumsum(end - start)])
        known = pc.index_in(words, value_set=self.vocabulary)
        number = known.fill_null(-1).to_numpy().astype(np.int64)
        hit = np.flatnonzero(number >= 0)
        owner = np.searchsorted(bounds, hit, side="right") - 1
        # Runs of template words that are too short for any phrase or match are left out.
        fresh = np.r_[True, (np.diff(hit) != 1) | (np.diff(owner) != 0)] if len(hit) else np.zeros(0, bool)
        run = np.cumsum(fresh) - 1
        long = np.bincount(run, minlength=1)[run] >= self.shortest if len(hit) else np.zeros(0, bool)
        hit, owner = hit[long], owner[long]
        phrases: list = [[] for _ in rows]
        spans: list = [[] for _ in rows]
        at = np.searchsorted(owner, np.arange(len(rows) + 1)).tolist()
        places = (hit - bounds[owner]).tolist()
        coded = number[hit].tolist()
        for d in np.unique(owner).tolist():
            found, matches = self.statistics(places[at[d] : at[d + 1]], coded[at[d] : at[d + 1]])
            phrases[d], spans[d] = found, self.spans(matches)
        return np.diff(bounds), phrases, spans


def find_licenses(docs: DataFrame, scanner: LicenseScanner | None = None) -> DataFrame:
    """doc_id, n_words, phrases (label, first word) and spans (label, template, words, share) of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scanner or LicenseScanner())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                n, phrases, spans = own.scan(part.column(1))
                said = [[{"label": own.phrases[k][0], "at": at} for k, at in found] for found in phrases]
                covered = [
                    [
                        {"label": own.templates[t][0], "template": t, "first_word": a, "last_word": b, "covered": c, "share": min(1.0, c / own.sizes[t])}
                        for t, a, b, c in found
                    ]
                    for found in spans
                ]
                phrase = pa.struct([("label", pa.string()), ("at", pa.int64())])
                span = pa.struct(
                    [("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(said, pa.list_(phrase)), pa.array(covered, pa.list_(span))],
                    names=["doc_id", "n_words", "phrases", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _FOUND)


def summary(found: DataFrame) -> DataFrame:
    """One row of figures for each document of ``find_licenses``.

    ``score``: 1 with a phrase, else the largest share of a template that a span covers, else 0.
    """
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.at").alias("first_word"),
        F.array_max("phrases.at").alias("last_word"),
        joined(F.col("phrases.label")).alias("base_labels"),
        joined(F.concat("phrases.label", "spans.label")).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )
