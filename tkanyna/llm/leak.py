"""Held-out passages inside a corpus, by a generalised suffix automaton of the normalised test items.

The items are a fixed evaluation set: their count and words are checked against ITEM_WORDS before the automaton is
broadcast, and a larger set is searched in several automata, one pass each. Documents are streamed word by word; the
automaton keeps the longest match that ends at each word, and wherever it reaches `least` words the items that hold
those words are read off. Words are as a reader sees them, ignoring case; a null or empty document leaks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tkanyna.llm.words import words

LEAST = 12
ITEM_WORDS = 200_000  # in one broadcast automaton, which has at most twice as many states


class SuffixAutomaton:
    """All runs of words of the items; each state knows the items that hold the runs which end in it."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least = least
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        holders: list[set[int]] = [set()]
        for item, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, self.number.setdefault(w, len(self.number)), holders)
                holders[last].add(item)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= least:
                holders[self.link[state]] |= holders[state]
        # what holds the last `least` words of any match in a state is known at the shortest state that has so many
        self.items: list[tuple[int, ...]] = [tuple(sorted(h)) if n >= least else () for h, n in zip(holders, self.length)]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[self.link[state]] >= least:
                self.items[state] = self.items[self.link[state]]

    def _extend(self, last: int, w: int, holders: list[set[int]]) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q, holders)
        new = self._state(self.length[last] + 1, {}, 0, holders, set())
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q, holders)
        return new

    def _clone(self, p: int, w: int, q: int, holders: list[set[int]]) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], holders, set())
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _state(self, length: int, step: dict[int, int], link: int, holders: list[set[int]], held: set[int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        holders.append(held)
        return len(self.link) - 1

    def matches(self, ws: list[str]) -> list[tuple[int, int, int]]:
        """(state, end, length) wherever the longest match has `least` words or more; ends are in words."""
        step, link, size, number, least = self.next, self.link, self.length, self.number, self.least
        state = length = 0
        out = []
        for at, w in enumerate(ws):
            k = number.get(w)
            if k is None:
                state = length = 0
                continue
            while state and k not in step[state]:
                state = link[state]
                length = size[state]
            if k in step[state]:
                state = step[state][k]
                length += 1
            if length >= least:
                out.append((state, at + 1, length))
        return out

    def held(self, ws: list[str]) -> tuple[set[int], list[tuple[int, int]]]:
        """The items that share at least `least` consecutive words with ws, and the spans of ws they cover, merged."""
        found: set[int] = set()
        spans: list[tuple[int, int]] = []
        for state, end, length in self.matches(ws):
            found.update(self.items[state])
            start = end - length
            if spans and start <= spans[-1][1]:
                spans[-1] = (min(start, spans[-1][0]), end)
            else:
                spans.append((start, end))
        return found, spans


def _item_sets(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The normalised items, in sets of at most ITEM_WORDS words (or one item); one set is held at a time."""
    part, size = [], 0
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null and k is not null").toLocalIterator():
        ws = words(row.t)
        if part and size + len(ws) > ITEM_WORDS:
            yield part
            part, size = [], 0
        part.append((row.k, ws))
        size += len(ws)
    yield part


def leaks(documents: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, least: int = LEAST) -> DataFrame:
    """A row (doc, item, covered) for each document and item with `least` consecutive words in common.

    covered: the share of the document's words inside spans found in any item of one automaton. A document that is
    given twice has its rows once.
    """
    spark = documents.sparkSession
    found = None
    for part in _item_sets(items, item_key, item_text):
        automaton = spark.sparkContext.broadcast(SuffixAutomaton(part, least))

        def scan(batches: Iterator[pd.DataFrame], automaton=automaton) -> Iterator[pd.DataFrame]:
            a = automaton.value
            for batch in batches:
                out = []
                for doc, text in zip(batch["doc"].tolist(), batch["text"].tolist()):
                    ws = words(text)
                    hit, spans = a.held(ws)
                    if hit:
                        share = sum(e - s for s, e in spans) / len(ws)
                        out += [(doc, item, share) for item in hit]
                yield pd.DataFrame(out, columns=["doc", "item", "covered"])

        given = documents.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).filter("doc is not null and text is not null")
        rows = given.mapInPandas(scan, "doc bigint, item bigint, covered double")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def without_leaks(documents: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, least: int = LEAST, most: float = 0.5) -> DataFrame:
    """The documents with leaked spans cut out; a document covered beyond `most` is left without text.

    Words in the text are found again by position, so that spelling and punctuation elsewhere stay as they were.
    """
    from tkanyna.llm.words import WORD, usual_form

    spark = documents.sparkSession
    automata = [spark.sparkContext.broadcast(SuffixAutomaton(p, least)) for p in _item_sets(items, item_key, item_text)]

    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = []
            for text in series:
                if not text:
                    out.append(text)
                    continue
                shown = usual_form(text).replace("\u0301", "")
                lowered = shown.lower()
                found = list(WORD.finditer(lowered))
                ws, places = [m.group() for m in found], [m.span() for m in found]
                if len(lowered) != len(shown):  # a letter that is two in lower case
                    origin = [i for i, c in enumerate(shown) for _ in c.lower()]
                    places = [(origin[s], origin[e - 1] + 1) for s, e in places]
                gone: set[int] = set()
                for a in automata:
                    for s, e in a.value.held(ws)[1]:
                        gone.update(range(s, e))
                if not gone:
                    out.append(text)
                elif len(gone) > most * len(ws):
                    out.append("")
                else:
                    parts, at = [], 0
                    for k in sorted(gone):
                        parts.append(shown[at : places[k][0]] if k - 1 not in gone else "")
                        at = places[k][1]
                    out.append("".join([*parts, shown[at:]]))
            yield pd.Series(out, dtype=object)

    return documents.withColumn(doc_text, F.pandas_udf(cut, "string")(F.col(doc_text)))
