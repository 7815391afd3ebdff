"""Many terms in one pass of each text: an Aho-Corasick automaton as arrays, run over all texts of a batch at once.

The automaton is built once, on the driver: a table of next states by state and class of character (characters of no term are one class), and for each state
the terms that end there. It travels as arrays. A batch's texts form one string, which is cut into stretches of ``STRETCH`` characters; all stretches step
together, a character a step, each from as far before its start as the longest term reaches, so that a text of any length costs its length.

What ends is then tested at its bounds, by kind of term: words stand alone or with an s, phrases anywhere, others between word
boundaries or with an s; equal terms do not overlap. These are the rules of ``relevance.term_hits``, whose rows these are.

Edge cases: null texts are empty; texts are taken as they are, so callers lower them first; no terms give no hits; terms of several groups count in each.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

STRETCH, CHARS = 2048, 4_000_000
HITS = "array<struct<id:int,n:int>>"
WORD, PHRASE, OTHER = range(3)


@cache
def word_characters() -> np.ndarray:
    """Whether a code point is a letter, a number or an underscore."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" or c == 95 for c in range(0x110000)), dtype=bool, count=0x110000)


class Automaton:
    """Of ``terms``: id -> term."""

    def __init__(self, terms: dict[int, str]):
        self.ids = np.array(list(terms), dtype=np.int64)
        names = list(terms.values())
        self.lengths = np.array([len(t) for t in names], dtype=np.int64)
        self.kinds = np.array([WORD if t.isalpha() else PHRASE if " " in t else OTHER for t in names], dtype=np.int8)
        letters = sorted({c for t in names for c in t})
        self.classes = np.array([ord(c) for c in letters], dtype=np.int64)  # their places from 1 on; 0 is any other
        at = {c: i for i, c in enumerate(letters, 1)}
        follow: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, t in enumerate(names):
            s = 0
            for c in t:
                if at[c] not in follow[s]:
                    follow[s][at[c]] = len(follow)
                    follow.append({})
                    ends.append([])
                s = follow[s][at[c]]
            ends[s].append(k)
        table = np.zeros((len(follow), len(letters) + 1), dtype=np.int32)
        fail, queue = [0] * len(follow), deque()
        for c, to in follow[0].items():
            table[0, c] = to
            queue.append(to)
        while queue:  # in order of depth, so the states behind are done
            s = queue.popleft()
            table[s] = table[fail[s]]
            ends[s] = ends[s] + ends[fail[s]]
            for c, to in follow[s].items():
                fail[to] = int(table[fail[s], c])
                table[s, c] = to
                queue.append(to)
        self.table = table
        self.first = np.cumsum([0, *map(len, ends)])
        self.ends = np.array([k for e in ends for k in e], dtype=np.int64)

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last character, number of the term) of every occurrence, overlapping ones too."""
        if not len(codes) or not len(self.ids):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        kind = np.zeros(0x110000, dtype=np.int32)
        kind[self.classes] = np.arange(1, len(self.classes) + 1)
        symbols = kind[codes]
        back = int(self.lengths.max()) - 1
        starts = np.arange(0, len(codes), STRETCH)
        state, places, states = np.zeros(len(starts), dtype=np.int32), [], []
        some = np.diff(self.first) > 0
        for step in range(-back, STRETCH):
            at = starts + step
            inside = (at >= 0) & (at < len(codes))
            state = np.where(inside, self.table[state, symbols[np.where(inside, at, 0)]], 0)
            if step >= 0:
                hit = np.flatnonzero(some[state] & inside)
                if len(hit):
                    places.append(at[hit])
                    states.append(state[hit])
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place, state = np.concatenate(places), np.concatenate(states)
        n = self.first[state + 1] - self.first[state]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(place, n), self.ends[np.repeat(self.first[state], n) + nth]

    def counts(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(id, n) of the terms of each text, by id."""
        whole = "\n".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        end, term = self.matches(codes)
        padded = np.r_[False, word_characters()[codes], False, False] if len(codes) else np.zeros(3, dtype=bool)
        word = lambda at: padded[at + 1]
        length = self.lengths[term]
        begin, s_next = end - length + 1, np.r_[codes == ord("s"), False][np.minimum(end + 1, len(codes))] if len(end) else np.zeros(0, dtype=bool)
        after = word(end + 1) if len(end) else np.zeros(0, dtype=bool)
        with_s = s_next & ~padded[np.minimum(end + 3, len(padded) - 1)] if len(end) else s_next
        plain = ~word(begin - 1) & (~after | with_s)
        edge = (word(begin - 1) != word(begin)) & ((word(end) != after) | with_s)
        good = np.where(self.kinds[term] == WORD, plain, np.where(self.kinds[term] == PHRASE, True, edge))
        end, term, begin = end[good], term[good], begin[good]
        order = np.lexsort((begin, term))
        end, term, begin = end[order], term[order], begin[order]
        near = np.flatnonzero((term[1:] == term[:-1]) & (begin[1:] <= end[:-1]))
        if len(near):  # occurrences of one term that overlap: from the left, those that do not
            keep, last, now = np.ones(len(end), dtype=bool), -1, -1
            for i in range(int(near[0]), len(end)):
                if term[i] != now:
                    now, last = term[i], -1
                keep[i] = begin[i] > last
                last = end[i] if keep[i] else last
            end, term = end[keep], term[keep]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.searchsorted(bounds, end, side="right") - 1
        pair, n = np.unique(owner * len(self.ids) + term, return_counts=True)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for p, k in zip(pair.tolist(), n.tolist(), strict=True):
            out[p // len(self.ids)].append((int(self.ids[p % len(self.ids)]), k))
        return out


def with_hits(documents: DataFrame, low: str, terms: dict[int, str], out: str = "hits") -> DataFrame:
    """``documents`` with ``out``: (id, n) of the terms in the column ``low``."""
    ship(documents.sparkSession)
    automaton = Automaton(terms)
    names = documents.columns
    kind = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found, at = [t or "" for t in b.column(low).to_pylist()], [], 0
            while at < len(texts):  # some texts at a time
                to, chars = at + 1, len(texts[at])
                while to < len(texts) and chars + len(texts[to]) < CHARS:
                    chars += len(texts[to])
                    to += 1
                found += automaton.counts(texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[{"id": i, "n": n} for i, n in hits] for hits in found], kind)], names=[*names, out])

    return documents.mapInArrow(run, documents.withColumn(out, F.array().cast(HITS)).schema)
