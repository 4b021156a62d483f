"""Aligning a rendering with the sentence it renders, word by word, and telling how far it gets.

Words of the two sides are compared by their consonants (the rendering changes vowels, and some d to n), so that no
dictionary is needed; words that are rendered by others altogether simply don't match, and a few of them do no harm.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CELLS = 1_000_000  # of an alignment table; from there on its rows are filled as arrays
# Letters that a rendering may change or drop.
SOFT = "аеєиіїоуюяьйґгыэёъ'"
DROP = str.maketrans({c: None for c in SOFT} | {"д": "н"})


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """The consonants of a word, with d as n; for a word without any, the word itself."""
    return word.translate(DROP) or word


def alike(one: str, other: str) -> bool:
    if one == other:
        return True
    a, b = fold(one), fold(other)
    return a == b and abs(len(one) - len(other)) < 3


def begins(part: str, whole: str) -> bool:
    """Whether part is a rendered beginning of whole that lacks some of its end."""
    if len(part) >= len(whole):
        return False
    if whole.startswith(part):
        return True
    head = whole[: len(part)]
    return fold(part) == fold(head) and len(fold(head)) > 0 and any(c not in SOFT for c in head)


def reach(rendering: list[str], sentence: list[str]) -> tuple[int, int]:
    """(matches, end): the best alignment of the whole rendering with a beginning of the sentence.

    matches: words that agree, the last one perhaps in part; end: how many words of the sentence it covers. Of equal
    alignments the one that covers more counts.
    """
    n, m = len(rendering), len(sentence)
    if n * m > CELLS:
        return walk(rendering, sentence)
    # cost of a gap 2, of different words 1, of a match -2
    row = [2 * j for j in range(m + 1)]
    hits = [0] * (m + 1)
    for i, w in enumerate(rendering):
        last = i == n - 1
        fw = fold(w)
        diagonal, diagonal_hits = row[0], hits[0]
        row[0] += 2
        for j in range(1, m + 1):
            s = sentence[j - 1]
            same = w == s or fold(s) == fw or last and begins(w, s)
            best, best_hits = diagonal + (-2 if same else 1), diagonal_hits + same
            diagonal, diagonal_hits = row[j], hits[j]
            if diagonal + 2 < best:
                best, best_hits = diagonal + 2, diagonal_hits
            if row[j - 1] + 2 < best:
                best, best_hits = row[j - 1] + 2, hits[j - 1]
            row[j], hits[j] = best, best_hits
    end = min(range(m + 1), key=lambda j: (row[j], -j))
    return hits[end], end


def walk(rendering: list[str], sentence: list[str]) -> tuple[int, int]:
    """As reach, with the same result, for long texts: a row of its table at a time, in linear memory."""
    n, m = len(rendering), len(sentence)
    codes: dict[str, int] = {}
    theirs = np.array([codes.setdefault(fold(s), len(codes)) for s in sentence], np.int64)
    at = np.arange(m + 1)
    row, hits = 2 * at, np.zeros(m + 1, np.int64)
    for i, w in enumerate(rendering):
        same = theirs == codes.get(fold(w), -1)
        if i == n - 1:
            same |= np.fromiter((begins(w, s) for s in sentence), bool, m)
        best, best_hits = row + 2, hits.copy()
        diagonal = row[:-1] + np.where(same, -2, 1)
        use = diagonal <= best[1:]
        best[1:][use], best_hits[1:][use] = diagonal[use], (hits[:-1] + same)[use]
        # a gap of several words starts at the last place from which it is cheapest
        level = best - 2 * at
        least = np.minimum.accumulate(level)
        start = np.maximum.accumulate(np.where(level == least, at, 0))
        row, hits = least + 2 * at, best_hits[start]
    end = int(np.flatnonzero(row == row.min())[-1])
    return int(hits[end]), end
