"""An Aho-Corasick automaton over passages of words, as arrays, which scans many texts in step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tkanyna.llm.words import code

LETTER = (1 << 31) - 1  # words are letters of 31 bits; equal letters of different words are sorted out by what follows


def letters(sets: list[list[str]], known: dict[str, int]) -> np.ndarray:
    """The letters of all words of the sets, in one array."""
    out = []
    for ws in sets:
        for w in ws:
            if (c := known.get(w)) is None:
                if len(known) > 500_000:
                    known.clear()
                c = known[w] = code(w) & LETTER
            out.append(c)
    return np.array(out, np.int64)


class PassageAutomaton:
    """Nodes are the beginnings of passages; node 0 is the empty one.

    step[i] is the parent and letter that lead to node i + 1, in order, so that a step is a search in one array; fail is
    the node of the longest proper ending of a node, passage the number of the passage that a node is (or -1), and
    shorter the nearest ending that is a passage (or 0).
    """

    def __init__(self, table: np.ndarray, size: np.ndarray):
        """table: the letters of a passage in each row; size: how many of them count. Equal passages get one number, `number`."""
        node = np.zeros(len(table), np.int64)
        levels, base = [], 0
        for at in range(int(size.max(initial=0))):
            more = size > at
            found, place = np.unique((node[more] << 31) | table[more, at].astype(np.int64), return_inverse=True)
            node[more] = base + 1 + place
            levels.append((base + 1, base + 1 + len(found)))
            self.step = found if at == 0 else np.concatenate([self.step, found])
            base += len(found)
        if not levels:
            self.step = np.zeros(0, np.int64)
        self.passage = np.full(base + 1, -1, np.int32)
        self.passage[node[size > 0]] = np.flatnonzero(size > 0)
        self.number = self.passage[node]  # of each row
        self.fail = np.zeros(base + 1, np.int32)
        self.shorter = np.zeros(base + 1, np.int32)
        for k, (lo, hi) in enumerate(levels):
            if k:
                made = self.step[lo - 1 : hi - 1]
                self.fail[lo:hi] = self.follow(self.fail[made >> 31].astype(np.int64), made & LETTER)
            end = self.fail[lo:hi]
            self.shorter[lo:hi] = np.where(self.passage[end] >= 0, end, self.shorter[end])

    def close(self) -> np.ndarray:
        """The numbers of the rows, made dense from 0; they aren't kept."""
        used, number = np.unique(self.number, return_inverse=True)
        named = np.flatnonzero(self.passage >= 0)
        self.passage[named] = np.searchsorted(used, self.passage[named])
        self.number = None
        return number

    def follow(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after one letter each, along fail links where a state has no such step."""
        out = np.zeros(len(state), np.int64)
        if not len(self.step):
            return out
        open_ = np.arange(len(state))
        while len(open_):
            want = (state << 31) | letter
            at = np.minimum(np.searchsorted(self.step, want), len(self.step) - 1)
            there = self.step[at] == want
            out[open_[there]] = at[there] + 1
            again = ~there & (state > 0)
            open_, state, letter = open_[again], self.fail[state[again]].astype(np.int64), letter[again]
        return out

    def intervals(self, flat: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(texts, end, passages) of the matched intervals, by the place where they end. flat: the letters of all texts."""
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        start, left = start[order], size[order]
        state = np.zeros(len(size), np.int64)
        for at in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-left, -at, "left"))
            state = self.follow(state[:live], flat[start[:live] + at])
            text, node = order[:live], state
            while len(node):
                hit = self.passage[node] >= 0
                if hit.any():
                    yield text[hit], at + 1, self.passage[node[hit]]
                more = self.shorter[node] > 0
                text, node = text[more], self.shorter[node[more]]
