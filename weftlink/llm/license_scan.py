"""Licence scans by a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template and phrase; its size depends on the
templates alone. A document is streamed through it word by word: the state tells the longest run of
words ending here that some template has (matching statistics). Runs that can't be made longer and
have at least ``min_match`` words are chained, template by template and for each place that a run has
in the template, into spans whose words follow each other in text and template. Each run keeps the
chain that covers most up to it, which may be the run alone, so a stray match can't take words from what
follows; a span that covers enough of its template gives the template's label, and where such spans of one
template overlap the one that covers most stays. Phrases count at every place where their words stand consecutively: a place is reached when
the phrase's own state lies on the suffix chain of the current state.

Words: A-Z lower-cased, then runs of a-z, 0-9 and characters outside ASCII.

Defined cases: a null or empty text has no words, labels "" and score 0; repeated rows and null ids
keep their rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from weftlink.llm.common import texts
from weftlink.llm.license_templates import PHRASES, TEMPLATES

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class ScanParams:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES
    min_match: int = 3  #: words of a run that is worth chaining
    max_gap: int = 12  #: words between two chained runs, in text or template
    cover: float = 0.7  #: share of a template's words that a span has to cover


@dataclass
class _State:
    next: dict[int, int] = field(default_factory=dict)
    link: int = -1
    length: int = 0
    ends: dict[int, list[int]] = field(default_factory=dict)  #: template -> its positions where this state's runs end, if they are worth chaining
    phrases: tuple[int, ...] = ()


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences (Blumer et al.; online construction)."""

    def __init__(self, params: ScanParams):
        self.params = params
        self.vocabulary: dict[bytes, int] = {}
        self.states = [_State()]
        seqs = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
                for text in (*(t for _, t in params.templates), *(p for p, _ in params.phrases))]
        self.lengths = [len(s) for s in seqs]
        self.labels = [label for label, _ in params.templates]
        for seq in seqs:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        for k, seq in enumerate(seqs[:len(params.templates)]):
            v = 0
            for at, w in enumerate(seq):
                v = self.states[v].next[w]
                u = v
                while u > 0 and self.states[u].length >= params.min_match:
                    self.states[u].ends.setdefault(k, []).append(at)
                    u = self.states[u].link
        own: dict[int, list[int]] = {}
        for k, seq in enumerate(seqs[len(params.templates):]):
            v = 0
            for w in seq:
                v = self.states[v].next[w]
            own.setdefault(v, []).append(k)
        for v in sorted(range(len(self.states)), key=lambda v: self.states[v].length):
            s = self.states[v]
            s.phrases = tuple(own.get(v, ())) + (self.states[s.link].phrases if s.link > 0 else ())
        self.phrase_lengths = self.lengths[len(params.templates):]

    def _extend(self, last: int, w: int) -> int:
        st = self.states
        if w in st[last].next:
            q = st[last].next[w]
            return q if st[q].length == st[last].length + 1 else self._clone(last, w, q)
        cur = len(st)
        st.append(_State(length=st[last].length + 1))
        p = last
        while p >= 0 and w not in st[p].next:
            st[p].next[w] = cur
            p = st[p].link
        if p < 0:
            st[cur].link = 0
        else:
            q = st[p].next[w]
            st[cur].link = q if st[q].length == st[p].length + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        st = self.states
        clone = len(st)
        st.append(_State(next=dict(st[q].next), link=st[q].link, length=st[p].length + 1))
        st[q].link = clone
        while p >= 0 and st[p].next.get(w) == q:
            st[p].next[w] = clone
            p = st[p].link
        return clone

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Longest runs (last word's place, words, state), and places (first word, phrase)."""
        runs, places = [], []
        st, least = self.states, self.params.min_match
        v = length = 0
        for at, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                if length >= least:
                    runs.append((at - 1, length, v))
                v = length = 0
                continue
            if w not in st[v].next:
                if length >= least:
                    runs.append((at - 1, length, v))
                while v > 0 and w not in st[v].next:
                    v = st[v].link
                    length = st[v].length
            nxt = st[v].next.get(w)
            if nxt is None:
                v = length = 0
                continue
            v, length = nxt, length + 1
            for k in st[v].phrases:
                if length >= self.phrase_lengths[k]:
                    places.append((at - self.phrase_lengths[k] + 1, k))
        if length >= least:
            runs.append((len(words) - 1, length, v))
        return runs, places

    def spans(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains of runs: (template, first word, last word, share of the template covered)."""
        gap = self.params.max_gap
        live: dict[int, list[tuple[int, int, int, int]]] = {}  # template -> best chains: last word, template's next word, words covered, first word
        full: dict[int, list[tuple[int, int, int]]] = {}  # template -> chains that cover enough: words covered, first word, last word
        for end, length, v in runs:
            start = end - length + 1
            for k, positions in self.states[v].ends.items():
                # runs start ever later, so what ends too far before this one can't be joined again
                chains = [c for c in live.get(k, ()) if start - c[0] <= gap + 1]
                own = []
                for t_end in positions:
                    t_start = t_end - length + 1
                    covered, first = length, start
                    for last, t_next, before, head in chains:
                        cut = max(0, last + 1 - start, t_next - t_start)  # words that the chain already has, or that lie behind it in the template
                        if cut < length and start + cut - last <= gap + 1 and t_start + cut - t_next <= gap and (before + length - cut, head) > (covered, first):
                            covered, first = before + length - cut, head
                    own.append((end, t_end + 1, covered, first))
                    if covered >= self.params.cover * self.lengths[k]:
                        full.setdefault(k, []).append((covered, first, end))
                live[k] = chains + own
        found = []
        for k, spans in full.items():
            taken: list[tuple[int, int]] = []  # in order, not overlapping
            for covered, first, last in sorted(spans, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                at = bisect_left(taken, (first, last))
                if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
                    taken.insert(at, (first, last))
                    found.append((k, first, last, min(1.0, covered / self.lengths[k])))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


_AUTOMATA: dict[ScanParams, SuffixAutomaton] = {}


def automaton(params: ScanParams) -> SuffixAutomaton:
    if params not in _AUTOMATA:
        _AUTOMATA[params] = SuffixAutomaton(params)
    return _AUTOMATA[params]


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,first_word:long,last_word:long,cover:double>>")


def scan_text(text: str, a: SuffixAutomaton) -> tuple:
    words = words_of(text)
    runs, places = a.matches(words)
    spans = a.spans(runs)
    base = {a.params.phrases[k][1] for _, k in places}
    labels = base | {a.labels[k] for k, *_ in spans}
    starts = [at for at, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 if base else max((s[3] for s in spans), default=0.0),
            [{"label": a.labels[k], "first_word": f, "last_word": z, "cover": c} for k, f, z, c in spans])


def scan_licenses(docs: DataFrame, params: ScanParams = ScanParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, phrase places, labels, score and covered template spans. No shuffle."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(params)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for pdf in batches:
            out = pd.DataFrame([scan_text(t, a) for t in pdf["text"]], columns=names)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy() if pdf["doc_id"].isna().any() else pdf["doc_id"].to_numpy())
            yield out

    return texts(docs, id_col, text_col).mapInPandas(scan, SCHEMA)
