"""Corpus scores of predictions against references: BLEU, chrF++ and TER, as sums of per-pair statistics.

Each pair's n-grams are counted within its row, so that no n-gram is shuffled; the corpus score is one aggregation of a
few sums. One reference stands for each prediction. Null texts count as empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = 4
CHAR_ORDERS, WORD_ORDERS, BETA = 6, 2, 2
MOST_SHIFTED, MOST_DISTANT, MOST_TRIES = 10, 50, 1000


def standard_tokens(text: str) -> list[str]:
    """Tokens as machine translation scores usually cut them: punctuation apart, numbers whole."""
    for mark, char in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(mark, char)
    text = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", f" {text} ")
    text = re.sub(r"([^0-9])([.,])", r"\1 \2 ", text)
    text = re.sub(r"([.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def grams(items: list[str] | str, n: int) -> Counter:
    return Counter(items[i : i + n] if isinstance(items, str) else tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def bleu_counts(prediction: str, reference: str, tokenize: bool = True) -> list[int]:
    """Matches and totals of each order, then the lengths of prediction and reference."""
    hyp, ref = (standard_tokens(t) if tokenize else t.split() for t in (prediction, reference))
    out = []
    for n in range(1, ORDERS + 1):
        a, b = grams(hyp, n), grams(ref, n)
        out += [(a & b).total(), max(0, len(hyp) - n + 1)]
    return [*out, len(hyp), len(ref)]


def bleu_score(counts: list[int]) -> float:
    """BLEU of summed counts, orders without a match smoothed exponentially; 0 without any match."""
    *pairs, sys_len, ref_len = counts
    if not any(pairs[::2]) or not sys_len:
        return 0.0
    logs, halved = 0.0, 1.0
    for match, total in zip(pairs[::2], pairs[1::2]):
        if not total:
            return 0.0
        if not match:
            halved *= 2
        logs += math.log(100.0 * match / total if match else 100.0 / (halved * total))
    brevity = math.exp(1 - ref_len / sys_len) if sys_len < ref_len else 1.0
    return brevity * math.exp(logs / ORDERS)


def split_punctuation(text: str) -> list[str]:
    """Words with one punctuation mark at an edge apart."""
    marks, out = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), []
    for w in text.split():
        if len(w) > 1 and w[-1] in marks:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in marks:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf_counts(prediction: str, reference: str) -> list[int]:
    """Counts of prediction, reference and matches, for each order of characters and then of words."""
    out = []
    a, b = "".join(prediction.split()), "".join(reference.split())
    u, v = split_punctuation(prediction), split_punctuation(reference)
    for hyp, ref, orders in ((a, b, CHAR_ORDERS), (u, v, WORD_ORDERS)):
        for n in range(1, orders + 1):
            x, y = grams(hyp, n), grams(ref, n)
            out += [x.total(), y.total(), (x & y).total()]
    return out


def chrf_score(counts: list[int]) -> float:
    """chrF++ of summed counts: precision and recall averaged over the orders that both sides have."""
    precision = recall = 0.0
    orders = 0
    for hyp, ref, match in zip(counts[::3], counts[1::3], counts[2::3]):
        if hyp and ref:
            precision, recall, orders = precision + match / hyp, recall + match / ref, orders + 1
    if not orders or not precision + recall:
        return 0.0
    precision, recall, square = precision / orders, recall / orders, BETA * BETA
    return 100 * (1 + square) * precision * recall / (square * precision + recall) if precision + recall else 0.0


def _edits(hyp: list[str], ref: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """Edit distance, and the pairs of places that an optimal alignment matches or substitutes."""
    n, m = len(hyp), len(ref)
    table = [list(range(m + 1))]
    for i in range(1, n + 1):
        row, above = [i], table[-1]
        for j in range(1, m + 1):
            row.append(min(above[j - 1] + (hyp[i - 1] != ref[j - 1]), above[j] + 1, row[j - 1] + 1))
        table.append(row)
    pairs, i, j = [], n, m
    while i and j:
        if table[i][j] == table[i - 1][j - 1] + (hyp[i - 1] != ref[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif table[i][j] == table[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return table[n][m], pairs[::-1]


def ter_edits(hyp: list[str], ref: list[str]) -> int:
    """Insertions, deletions, substitutions and shifts of blocks, the best shift taken as long as one helps."""
    shifts, tries = 0, 0
    cost, pairs = _edits(hyp, ref)
    while cost and tries < MOST_TRIES:
        at = dict((j, i) for i, j in pairs)
        right = {i for i, j in pairs if hyp[i] == ref[j]}
        best: tuple[int, int, int, list[str]] | None = None
        for start in range(len(hyp)):
            for place in range(len(ref)):
                size = 0
                while size < MOST_SHIFTED and start + size < len(hyp) and place + size < len(ref) and hyp[start + size] == ref[place + size]:
                    size += 1
                if not size or abs(place - start) > MOST_DISTANT or all(start + k in right for k in range(size)) or at.get(place) == start:
                    continue
                block, rest = hyp[start : start + size], hyp[:start] + hyp[start + size :]
                goal = at.get(place - 1, -1) + 1 if place else 0
                goal = goal - size if goal > start else goal
                goal = max(0, min(goal, len(rest)))
                moved = rest[:goal] + block + rest[goal:]
                if moved == hyp:
                    continue
                tries += 1
                gain = cost - _edits(moved, ref)[0]
                if gain > 0 and (best is None or (gain, size, -start) > best[:3]):
                    best = (gain, size, -start, moved)
                if tries >= MOST_TRIES:
                    break
            if tries >= MOST_TRIES:
                break
        if best is None:
            break
        hyp, shifts = best[3], shifts + 1
        cost, pairs = _edits(hyp, ref)
    return cost + shifts


def ter_counts(prediction: str, reference: str) -> list[int]:
    """Edits, and the words of the reference, in lower case."""
    hyp, ref = prediction.lower().split(), reference.lower().split()
    return [ter_edits(hyp, ref) if ref else len(hyp), len(ref)]


def ter_score(counts: list[int]) -> float:
    edits, length = counts
    return 100.0 * edits / length if length else (100.0 if edits else 0.0)


KINDS = {"BLEU": (bleu_counts, 2 * ORDERS + 2, bleu_score), "chrF++": (chrf_counts, 3 * (CHAR_ORDERS + WORD_ORDERS), chrf_score), "TER": (ter_counts, 2, ter_score)}


def pair_counts(pairs: DataFrame, kind: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(stats): the counts of each pair, an array of one length."""
    count = KINDS[kind][0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"stats": [count(a, b) for a, b in zip(batch["a"].tolist(), batch["b"].tolist())]})

    given = pairs.select(F.coalesce(prediction, F.lit("")).alias("a"), F.coalesce(reference, F.lit("")).alias("b"))
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    if len(pairs.inputFiles()) < cores:  # counting costs far more than moving the texts of a few files
        given = given.repartition(cores)
    return given.mapInPandas(run, "stats array<bigint>")


def corpus_counts(pairs: DataFrame, kind: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """One row: the sum of each count, c0 and on; zeros without pairs."""
    size = KINDS[kind][1]
    return pair_counts(pairs, kind, prediction, reference).agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"c{i}") for i in range(size)])


def compute_metrics(pairs: DataFrame, prediction: str = "prediction", reference: str = "reference", kinds: tuple[str, ...] = ("BLEU", "chrF++", "TER")) -> dict[str, float]:
    """The scores of a corpus, with two decimals."""
    return {k: round(KINDS[k][2](list(corpus_counts(pairs, k, prediction, reference).first())), 2) for k in kinds}


def metric_row(spark: SparkSession, metrics: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([tuple(metrics.values())], ", ".join(f"`{k}` double" for k in metrics))


def paired(predictions: DataFrame, references: DataFrame, index: str = "idx") -> DataFrame:
    """Predictions with their references by index; ValueError if the two don't have the same rows."""
    both = predictions.join(references, index, "full")
    bad = both.filter(F.col("prediction").isNull() | F.col("reference").isNull()).limit(1).count()
    if bad:
        raise ValueError("predictions and references don't have the same rows")
    return both


def blank_tokens(c: Column | str) -> Column:
    """Tokens between white space, for n-gram counts in SQL."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")
