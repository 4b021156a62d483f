"""Values cut at a field limit: strict prefixes of a longer copy, by hashes of fixed-length prefixes.

Two uses of one self-join by prefix:

* `cut_renderings` joins a rendering with the sentence of its own record (the join is on the record, so it needs no
  shuffle). Words are hashed by their consonants; the hashes of the runs of 1 to PREFIX words from any place (a
  rendering may open with a lead-in) and a last word that is cut pick the candidates, and an alignment decides:
  the rendering must cover a beginning of the sentence, end open, and lack the rest.
* `prefix_copies` joins all values with each other: every value's hash of all its words but the last meets the hashes
  of the prefixes of all longer values, and its last word must begin the next word there. Prefix keys are distinct
  before the join, so a prefix that a third of the values share is one row, and the join is semi: nothing is paired.

Null and blank values are never cut. By its own sentence, a value that ends with . ! or ? is whole, as is one that covers its
sentence to the last word in any order. Repeated rows are judged alike; callers take distinct keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tkanyna.llm.align import alike, begins, fold, reach
from tkanyna.llm.words import ALIKE, TO_CYRILLIC, TO_LATIN, WORD, code, usual_form, words
from tkanyna.session import written

PREFIX = 3
ENDED = re.compile(r"(?<![.…])[.!?][\s»”\")\]]*$")
OPEN = frozenset("".join(ALIKE).lower())
LEFTOVER = re.compile(r"<SEP>|^\s*\d+[.)]\s+")


def prefix_hashes(ws: list[str]) -> set[int]:
    """Hashes of the runs of 1 to PREFIX consonant skeletons that start at any place."""
    folded = [fold(w) for w in ws]
    return {code(" ".join(folded[i : i + k])) for i in range(len(folded)) for k in range(1, min(PREFIX, len(folded) - i) + 1)}


def shares_prefix(a: list[str], b: list[str]) -> bool:
    """Whether a run of both is alike, or the last word of a, perhaps cut, begins a word of b."""
    return not prefix_hashes(a).isdisjoint(prefix_hashes(b)) or any(begins(a[-1], w) for w in b)


def telling(a: list[str], b: list[str]) -> bool:
    """Whether one word of a that agrees with b says enough: it opens b, or has over two consonants, or letters if cut."""
    known, opening = {fold(w) for w in b}, fold(b[0])
    if any((f := fold(w)) == opening or len(f) > 2 and f in known for w in a):
        return True
    return begins(a[-1], b[0]) or len(a[-1]) > 2 and any(begins(a[-1], w) for w in b)


def is_cut(rendering: str | None, sentence: str | None) -> bool:
    """Whether the rendering begins as one of the sentence but breaks off inside a word or a sentence."""
    if not rendering or not sentence:
        return False
    shown = LEFTOVER.sub(" ", rendering)
    a, b = words(shown), words(sentence)
    if not a or not b or len(a) >= len(b) - 1 and alike(a[-1], b[-1]):
        return False
    if not shares_prefix(a, b):
        return False
    matches, end = reach(a, b)
    if matches * 2 < len(a) or not matches or matches < len(a) == 2 and not telling(a, b):
        return False
    if end == len(b):
        return begins(a[-1], b[-1]) and not ENDED.search(usual_form(shown).rstrip())
    if ENDED.search(usual_form(shown).rstrip()):
        return False
    have = {fold(w) for w in a}
    rest = [fold(w) for w in b[end:] if len(w) > 2]
    return not rest or sum(w in have for w in rest) * 2 <= len(rest)


def cut_renderings(df: DataFrame, key: str, rendering: str, sentence: str) -> DataFrame:
    """The distinct keys of the rows whose rendering is cut."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [is_cut(a, b) for a, b in zip(batch["a"].tolist(), batch["b"].tolist())]
            yield batch.loc[keep, ["row"]]

    given = df.select(F.col(key).alias("row"), F.col(rendering).alias("a"), F.col(sentence).alias("b")).filter("row is not null and a is not null and b is not null")
    return given.mapInPandas(judge, "row bigint").distinct()


def _key(start: int, word: str) -> int:
    return (start * 1_000_003 + code(word)) & 0xFFFFFFFFFFFFFFF


def readings(text: str, last: str) -> set[str]:
    """The last word of a text; of look-alikes only, in either alphabet, as what is cut off may have decided it."""
    if not set(last) <= OPEN:
        return {last}
    shown = WORD.findall(usual_form(text).replace("\u0301", ""))[-1]
    if not set(shown) <= ALIKE:
        return {last}
    return {last, shown.translate(TO_CYRILLIC).lower(), shown.translate(TO_LATIN).lower()}


def prefix_copies(df: DataFrame, key: str | list[str], text: str, least: int = 4) -> DataFrame:
    """Keys of the values of at least `least` words that are strict prefixes of another value, whose last word may be cut.

    Fixed-length prefixes are all words but the last and the first letter of that. Of the values that share one, the
    last word must begin the word that stands there in the longer value, and not end it too. A word that others follow
    has a blank at its end.
    """
    names = [key] if isinstance(key, str) else key

    def lasts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, value in enumerate(batch["text"].tolist()):
                ws = words(value)
                if not ws or len(ws) < least:
                    continue
                h = 0
                for w in ws[:-1]:
                    h = _key(h, w)
                out += [(i, _key(h, w[0]), w) for w in readings(value, ws[-1])]
            found = pd.DataFrame(out, columns=["at", "prefix", "word"])
            yield pd.concat([batch[names].take(found["at"].astype("int64")).reset_index(drop=True), found[["prefix", "word"]]], axis=1)

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = set()
            for value in batch["text"].tolist():
                ws, h = words(value), 0
                for k, w in enumerate(ws, 1):
                    if k >= least:
                        out.add((_key(h, w[0]), w if k == len(ws) else w + " "))
                    h = _key(h, w)
            yield pd.DataFrame(list(out), columns=["prefix", "word"])

    given = df.select(*names, F.col(text).alias("text")).filter(" and ".join(f"{n} is not null" for n in [*names, "text"]))
    kinds = ", ".join(f"{n} {kind}" for n, kind in given.select(names).dtypes)
    ends = written(given.mapInPandas(lasts, f"{kinds}, prefix bigint, word string"))
    longer = given.select("text").mapInPandas(steps, "prefix bigint, word string").repartition("prefix").distinct().withColumnRenamed("word", "there")
    short = ends.select("prefix", "word").distinct().alias("short")
    begun = short.join(longer.alias("longer"), F.expr("short.prefix = longer.prefix and startswith(longer.there, short.word) and longer.there <> short.word"), "left_semi")
    return ends.join(begun, ["prefix", "word"], "left_semi").select(names).distinct()


def truncation_rates(df: DataFrame, key: str, source: str, cut: DataFrame) -> DataFrame:
    """Per source: rows, cut rows and their rate; a null source is a source of its own. cut: keys, as row."""
    rows = df.select(F.col(key).alias("row"), F.col(source).alias("source")).dropDuplicates(["row"])
    marked = rows.join(cut.withColumn("cut", F.lit(1)), "row", "left")
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count("cut").alias("cut_rows")).withColumn("rate", F.round(F.col("cut_rows") / F.col("rows"), 6))
