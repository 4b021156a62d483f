"""Reading level of a text by regularised ordinal regression, calibrated to graded texts.

Features: lexical diversity, word rarity (counts of all words of all documents, kept in a table of fixed size), share
of connectives, a clause-depth proxy (commas and subordinating words a sentence), and lengths of words and sentences;
each as a mean of the text and, where sentences of one text differ, by its spread over them.
A proportional-odds model with an L2 penalty is fitted on at most SAMPLE ratings, those of the ids that hash lowest;
everything else covers all documents.

Null and blank texts get no level, texts without words level 1. A text rated more than once counts once for each
rating in the fit; without any rating there is nothing to calibrate by, and no text gets a level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tkanyna.llm.words import WORD, code, usual_form, words

SLOTS = 1 << 18
SAMPLE = 20_000
LEVELS = 5
PENALTY = 1e-4
SENTENCE = re.compile(r"[.!?…]+[\s»”\")]*|\n\n+")
HELD = 400_000  # words whose properties a worker keeps
#: Words that join clauses, in the standard language and the dialect.
CONNECTIVES = frozenset("і й та тай а але али проте зате однак єнак отже тому тож адже таже бо щоправда хоча хоть поки коли єк як якщо єкшо щойно лиш тільки відколи видколи що шо щоб шоб який яка яке які де куди звідки оскільки завдяки незважаючи попри внаслідок тимчасом водночас причому відповідно всупереч якби немов наче ніби".split())
SUBORDINATE = frozenset("бо поки коли єк як якщо єкшо щойно лиш відколи видколи що шо щоб шоб який яка яке які де куди оскільки хоча хоть незважаючи попри завдяки тимчасом внаслідок причому".split())
ENDINGS = ("ість", "ості", "істю", "ння", "ннє", "ання", "ення", "ції", "ція", "цію", "ічна", "ічну", "ічне", "ічний", "ологічн", "альн", "ивн", "ування", "ство", "ства")


def slots(ws: list[str], known: dict[str, int]) -> list[int]:
    out = []
    for w in ws:
        if (s := known.get(w)) is None:
            if len(known) > 500_000:
                known.clear()
            s = known[w] = code(w) & (SLOTS - 1)
        out.append(s)
    return out


class Lexicon:
    """Properties of words, each worked out once: length, rarity, and whether abstract, connective, subordinating."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, 5))

    def of(self, ws: list[str]) -> np.ndarray:
        if len(self.index) > HELD:
            self.index.clear()
        get = self.index.get
        rows = [i if (i := get(w)) is not None else self._add(w) for w in ws]
        return self.table[rows]

    def _add(self, w: str) -> int:
        i = self.index[w] = len(self.index)
        if i >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        rarity = -np.log((self.counts[code(w) & (SLOTS - 1)] + 1.0) / self.counts[-1])
        self.table[i] = len(w), rarity, len(w) > 8 and w.endswith(ENDINGS), w in CONNECTIVES, w in SUBORDINATE
        return i


def features(text: str, lexicon: Lexicon) -> list[float] | None:
    """The features of one text, or None for a text without words."""
    text = usual_form(text).replace("\u0301", "")
    sentences = [ws for part in SENTENCE.split(text) if (ws := WORD.findall(part.lower()))]
    if not sentences:
        return None
    flat = [w for ws in sentences for w in ws]
    n, k = len(flat), len(sentences)
    size = np.fromiter(map(len, sentences), np.int64, k)
    starts = np.cumsum(size) - size
    table = lexicon.of(flat)
    length, rarity = table[:, 0], table[:, 1]
    letters, rare, abstract, joined, below = np.add.reduceat(table, starts, axis=0).T
    common = np.add.reduceat((rarity < 6.5).astype(float), starts) / size
    at = [int(q * (k - 1) + 0.5) for q in (0.2, 0.5, 0.8)]
    share = lambda x: np.count_nonzero(x) / k
    mean, distinct = n / k, len(set(flat))
    return [
        np.log1p(n), np.log1p(k), np.log(mean), np.log(size.max()), size.std() / mean, share(size <= 4), share(size <= 7), share(size >= 11), share(size >= 16),
        length.mean(), np.count_nonzero(length > 9) / n, np.count_nonzero(length > 12) / n, *np.sort(letters / size)[at],
        rarity.mean(), np.count_nonzero(rarity > 9.5) / n, *np.sort(rare / size)[at], common.mean(), share(common > 0.5),
        distinct / n**0.7, distinct / n, joined.sum() / k, share(joined > 0), share(joined > 1), below.sum() / k, share(below > 0), text.count(",") / k,
        abstract.sum() / n, share(abstract > 0), share(abstract > 1), share(abstract > 3),
    ]


@dataclass
class OrdinalModel:
    """Proportional odds: the chance of a level up to k is the logistic of cuts[k] less the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def level(self, x: np.ndarray) -> np.ndarray:
        """The most likely level of each row."""
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - self.score(x)[:, None], -40, 40)))
        chance = np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1), axis=1)
        return chance.argmax(axis=1) + 1


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, and their squares, held within a range."""
    z = np.clip(z, -4, 4)
    return np.concatenate([z, z * z], axis=1)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 1000) -> OrdinalModel:
    """The model by Adam on the whole sample; the same rows in the same order give the same model."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = expand((x - mean) / scale)
    share = np.clip(np.cumsum(np.bincount(y, minlength=LEVELS + 1)[1:LEVELS]) / len(y), 1e-3, 1 - 1e-3)
    share = np.maximum.accumulate(share + np.arange(LEVELS - 1) * 1e-6)
    w = np.zeros(z.shape[1])
    base = np.log(share / (1 - share))
    params = np.concatenate([w, [base[0]], np.log(np.maximum(np.diff(base), 1e-3))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    d = z.shape[1]
    for t in range(1, steps + 1):
        w, cuts = params[:d], np.cumsum(np.concatenate([[params[d]], np.exp(params[d + 1 :])]))
        s = z @ w
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = edge[y] - s, edge[y - 1] - s
        ph, pl = (1 / (1 + np.exp(-np.clip(a, -40, 40))) for a in (hi, lo))
        gh, gl = np.where(np.isinf(hi), 0, ph * (1 - ph)), np.where(np.isinf(lo), 0, pl * (1 - pl))
        ph, pl = np.where(np.isinf(hi), 1.0, ph), np.where(np.isinf(lo), 0.0, pl)
        p = np.maximum(ph - pl, 1e-9)
        ds = (gh - gl) / p / len(y)
        gw = z.T @ ds + penalty * w
        gc = np.zeros(LEVELS - 1)
        np.add.at(gc, np.minimum(y - 1, LEVELS - 2), np.where(y < LEVELS, -gh / p, 0) / len(y))
        np.add.at(gc, np.maximum(y - 2, 0), np.where(y > 1, gl / p, 0) / len(y))
        tail = np.cumsum(gc[::-1])[::-1]
        grad = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(params[d + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.05 * (1 - 0.5 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(mean, scale, params[:d], np.cumsum(np.concatenate([[params[d]], np.exp(params[d + 1 :])])))


def corpus_counts(documents: DataFrame, text: str) -> Broadcast:
    """Occurrences of words in all texts, in SLOTS counters; the last entry is their sum."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, known = np.zeros(SLOTS, np.int64), {}
        for batch in batches:
            for value in batch["text"].tolist():
                np.add.at(total, slots(words(value), known), 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"slot": used, "n": total[used]})

    rows = documents.select(F.col(text).alias("text")).filter("text is not null").mapInPandas(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS + 1, np.int64)
    counts[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    counts[-1] = max(1, counts.sum())
    return documents.sparkSession.sparkContext.broadcast(counts)


def fitted(documents: DataFrame, labels: DataFrame, key: str, text: str, level: str, counts: Broadcast, sample: int = SAMPLE) -> OrdinalModel | None:
    """The model of at most `sample` ratings, those of the ids that hash lowest; None without a rated text."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(counts.value)
        for batch in batches:
            x = [features(t, lexicon) for t in batch["text"].tolist()]
            out = pd.DataFrame({"row": batch["row"], "level": batch["level"], "x": x})
            yield out[out["x"].notna()]

    rated = labels.select(F.col(key).alias("row"), F.col(level).cast("int").alias("level")).filter(f"row is not null and level between 1 and {LEVELS}")
    rated = rated.orderBy(F.xxhash64("row"), "row", "level").limit(sample)
    texts = documents.select(F.col(key).alias("row"), F.col(text).alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(rated), "row").mapInPandas(measure, "row bigint, level int, x array<double>")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:  # one group, of at most `sample` rows
        pdf = pdf.sort_values(["row", "level"], kind="stable")
        m = fit(np.stack(pdf["x"].to_numpy()), pdf["level"].to_numpy(np.int64))
        return pd.DataFrame({"mean": [m.mean], "scale": [m.scale], "weights": [m.weights], "cuts": [m.cuts]})

    made = rows.groupBy().applyInPandas(learn, "mean array<double>, scale array<double>, weights array<double>, cuts array<double>").collect()
    return OrdinalModel(*(np.array(v) for v in made[0])) if made else None


def reading_levels(documents: DataFrame, labels: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """A row (key, level) for every document whose text isn't null or blank; a text without words is level 1.

    A document that is given twice, with one text, has one row.
    """
    counts = corpus_counts(documents, text)
    model = fitted(documents, labels, key, text, level, counts)
    if model is None:
        return documents.sparkSession.createDataFrame([], f"{key} bigint, level int")

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(counts.value)
        for batch in batches:
            batch = batch[batch["text"].str.strip() != ""]
            x = [features(t, lexicon) for t in batch["text"].tolist()]
            found = [i for i, v in enumerate(x) if v is not None]
            levels = np.ones(len(x), np.int64)
            if found:
                levels[found] = model.level(np.array([x[i] for i in found]))
            yield pd.DataFrame({key: batch["row"].to_numpy(), "level": levels})

    given = documents.select(F.col(key).alias("row"), F.col(text).alias("text")).filter("text is not null and row is not null")
    return given.mapInPandas(grade, f"{key} bigint, level int").distinct()
