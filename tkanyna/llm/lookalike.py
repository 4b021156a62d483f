"""Every value in the usual form: look-alike letters, odd spaces, invisible characters and split letters put right.

The vocabulary is every word of the tables that is written plainly, with its count. Words that leave their letters open
(look-alikes only, mixed alphabets, or a letter of no known alphabet) are looked up in tries of it by a weighted edit
automaton: a look-alike or an invisible character costs nothing, a letter of no known alphabet or of the alphabet that
the word has less of costs 1, anything else is beyond every budget. A word of FREE letters or more may cost BUDGET, so
that a letter no table lists is read from the others. Of the spellings of least cost the most frequent is canonical; a
word that reaches none is spelled by table.

Tries are sharded by the length of the words and three letters at their start, or at their end where the letter to be
read stands at the start, so that a trie holds a small share of the vocabulary and a word needs one shard only. Words
stay in groups sorted by shard, and a task holds one trie at a time.

Canonical spellings that the table gives as well are left out. What remains, as distinct words, is broadcast if a count
shows that it is at most MOST; beyond, it is joined to (keys, word) rows without the texts. Values are rewritten where
they stand.

Null stays null, an empty text stays empty, and a value in the usual form comes out unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tkanyna.llm.words import ALIKE, PLAIN, ROMANLIKE, TO_CYRILLIC, TOKEN, alphabet, invisible, script_of, shaped, usual_form
from tkanyna.session import written

#: What a step of the automaton costs; a word of at least FREE letters may cost BUDGET, any other nothing.
COSTS = {"same": 0, "lookalike": 0, "invisible": 0, "stranger": 1}
BUDGET = 1
FREE = 5
EDGE = 3  # letters that name a shard
SALTS = 16
HELD = 400_000  # distinct words counted before a partition passes them on
MOST = 200_000  # spellings that are broadcast


def shape(token: str) -> str:
    """The token with one letter for all that look alike."""
    return shaped(token).translate(TO_CYRILLIC)


def strangers(token: str) -> frozenset[int]:
    """Places of the letters that may stand for others: those of no known alphabet, or of the one the word has less of."""
    own = [script_of(c) for c in token]
    unknown = {i for i, (c, s) in enumerate(zip(token, own)) if c.isalpha() and not s}
    latin = {i for i, (c, s) in enumerate(zip(token, own)) if s == "L" and c not in ALIKE}
    cyrillic = {i for i, (c, s) in enumerate(zip(token, own)) if s == "C" and c not in ALIKE}
    if latin and cyrillic and len(latin) != len(cyrillic):
        unknown |= min(latin, cyrillic, key=len)
    return frozenset(unknown)


def edge(form: str) -> int:
    """How many letters at either end of a shape name its shard; the two ends don't meet."""
    return min(EDGE, len(form) // 2)


def shard_of(form: str, end: bool) -> str:
    """The shard of a shape, by its length and its first letters, or its last."""
    k = edge(form)
    return f"{len(form)} {'<' + form[len(form) - k :] if end else '>' + form[:k]}"


class Trie:
    """Spellings by letter, with their counts."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + count

    def spelling(self, token: str) -> str | None:
        """The spelling of least cost within the budget; then the most frequent, then the first in order."""
        odd = strangers(token)
        budget = BUDGET if sum(map(str.isalpha, token)) >= FREE else 0
        best: tuple[int, int, str] | None = None
        todo = [(self.root, "", 0, 0)]
        while todo:
            node, prefix, at, cost = todo.pop()
            if at == len(token):
                if "" in node and (best is None or (cost, -node[""], prefix) < best):
                    best = (cost, -node[""], prefix)
                continue
            c = token[at]
            if invisible(c):
                todo.append((node, prefix, at + 1, cost + COSTS["invisible"]))
                continue
            like = c.translate(TO_CYRILLIC)
            for letter, child in node.items():
                if not letter:
                    continue
                if letter == c:
                    step = COSTS["same"]
                elif letter.translate(TO_CYRILLIC) == like:
                    step = COSTS["lookalike"]
                elif at in odd and letter.isalpha() and letter.isupper() == c.isupper():
                    step = COSTS["stranger"]
                else:
                    continue
                if cost + step <= budget:
                    todo.append((child, prefix + letter, at + 1, cost + step))
        return best[2] if best else None


def is_plain(token: str) -> bool:
    """Whether a word may teach its spelling: one alphabet, and letters that occur in no other."""
    kinds = {(script_of(c), c in ALIKE) for c in token if c.isalpha()}
    return ({k for k, _ in kinds} == {"C"}) or (("L", False) in kinds and {k for k, _ in kinds} == {"L"})


@lru_cache(maxsize=100_000)
def one_alphabet(token: str) -> bool:
    """Whether all letters of a word are Cyrillic, or Latin with one that no other alphabet has."""
    scripts = {script_of(c) for c in token if c.isalpha()}
    return scripts <= {"C"} or scripts == {"L"} and any(c.isalpha() and c not in ALIKE for c in token)


def open_tokens(text: str) -> list[str]:
    """The words of a value that the automaton is to spell: their letters leave the alphabet open, mix alphabets, or belong to none."""
    out = []
    text = shaped(text)
    for m in TOKEN.finditer(text):
        token = m.group()
        if one_alphabet(token):
            continue
        fixed, unsure = alphabet(token, "°" if (start := m.start()) and text[start - 1] == "°" else "")
        if unsure or fixed != token:
            out.append(token)
    return out


def is_odd(value: Column) -> Column:
    """Whether a value isn't made of plain characters only."""
    return value.isNotNull() & (~value.rlike(f"^(?:{PLAIN.pattern})$") | value.rlike(ROMANLIKE.pattern.replace("[^\\W\\d_]", "\\p{L}")))


def _spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Canonical spellings, from rows sorted by shard whose vocabulary (n > 0) stands before what is asked (n = 0)."""
    shard, trie = None, Trie()
    for batch in batches:
        out = []
        for at, word, n in zip(batch["shard"].tolist(), batch["word"].tolist(), batch["n"].tolist()):
            if at != shard:
                shard, trie = at, Trie()
            if n:
                trie.add(word, n)
            elif (found := trie.spelling(word)) and found != alphabet(word)[0]:
                out.append((word, found))
        yield pd.DataFrame(out, columns=["token", "canonical"])


def spellings(values: DataFrame) -> DataFrame:
    """(token, canonical) of each open word whose canonical spelling isn't the one that the table gives."""

    def vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(seen: Counter) -> pd.DataFrame:
            kept = [(w, n) for w, n in seen.items() if is_plain(w)]
            return pd.DataFrame(kept, columns=["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for value in batch["value"].tolist():
                seen.update(TOKEN.findall(value))
            if len(seen) > HELD:
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(shard_of(form, end), w, n) for w, n in zip(batch["word"].tolist(), batch["n"].tolist()) for form in [shape(w)] for end in (False, True)]
            yield pd.DataFrame(out, columns=["shard", "word", "n"])

    def lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {t for value in batch["value"].tolist() for t in open_tokens(value)}
            yield pd.DataFrame([(shard_of(shape(t), any(i < edge(t) for i in strangers(t))), t) for t in found], columns=["shard", "word"])

    given = values.select("value").filter("value is not null")
    asked = written(given.filter(is_odd(F.col("value"))).mapInPandas(lookups, "shard string, word string").distinct())
    known = given.mapInPandas(vocabulary, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    known = known.mapInPandas(places, "shard string, word string, n bigint").join(asked.select("shard").distinct(), "shard", "left_semi")
    both = known.unionByName(asked.withColumn("n", F.lit(0).cast("bigint")))
    return both.repartition("shard").sortWithinPartitions("shard", F.col("n") == 0).mapInPandas(_spell, "token string, canonical string")


def _broadcast(found: DataFrame) -> Broadcast | None:
    """The spellings as a dictionary for every worker, if they are at most MOST."""
    rows = found.limit(MOST + 1).toPandas()
    return found.sparkSession.sparkContext.broadcast(dict(zip(rows["token"], rows["canonical"]))) if len(rows) <= MOST else None


def with_usual(values: DataFrame, keys: list[str], odd_only: bool = False) -> DataFrame:
    """keys, value, usual of every value, or of the odd ones only; usual is null for a null value.

    values: keys (unique together) and value.
    """
    found = written(spellings(values))
    own = _broadcast(found)
    given = values.select(*keys, "value")
    if odd_only:
        given = given.filter(is_odd(F.col("value")))
    if own is not None:

        def usual(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = own.value
            for series in texts:
                yield pd.Series([usual_form(v, table) for v in series], index=series.index, dtype=object)

        rewrite = F.pandas_udf(usual, "string")
        return given.withColumn("usual", rewrite("value") if odd_only else F.when(is_odd(F.col("value")), rewrite(F.when(is_odd(F.col("value")), F.col("value")))).otherwise(F.col("value")))

    def per_value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(token=[sorted(set(open_tokens(v))) for v in batch["value"]])
            yield batch[[*keys, "token"]].explode("token").dropna(subset=["token"])

    def rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [dict(s) if s is not None else None for s in batch["spelling"].tolist()]
            yield batch[[*keys, "value"]].assign(usual=[usual_form(v, s) for v, s in zip(batch["value"].tolist(), own)])

    kinds = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys)
    asked = values.select(*keys, "value").filter(is_odd(F.col("value"))).mapInPandas(per_value, f"{kinds}, token string").withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    spelled = asked.join(salted, ["token", "salt"]).groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("token", "canonical"))).alias("spelling"))
    return given.join(spelled, keys, "left").mapInPandas(rewritten, f"{kinds}, value string, usual string")


def usual_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """The values that aren't in the usual form, with it: keys, value, usual. values: keys (unique together) and value."""
    return with_usual(values, keys, odd_only=True).filter("value != usual")


def stacked(tables: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """Values of several tables, given as (name, table, key, fields): tbl, row_id, field, value."""
    out = None
    for name, df, key, fields in tables:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
        part = df.select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("row_id"), pairs.alias("x")).select("tbl", "row_id", "x.field", "x.value")
        out = part if out is None else out.unionByName(part)
    return out
