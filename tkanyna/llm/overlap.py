"""Records of evaluation splits that also stand, exactly or nearly, in the training split.

Evaluation records are split into shards of at most SHARD; the passages of a shard, runs of words of its records, form
an Aho-Corasick automaton, which is broadcast and scans all training texts where they stand, a shard after another.

* `cross_split_hits` finds the records whose two fields are both near-same to those of a training record. Near-same asks
  for the same words in any order, so records are normalised to their distinct words in a fixed order. Near-same records
  of n and m words differ in D words at most (`differing`), and each of these breaks one of D + 1 runs that a record is
  cut into, so that one run at least stands whole in the other text: the passages are the runs of every D that a record
  may need. Matched passages give pairs of records whose sizes ask for that very D; bitmaps drop most pairs, and the
  exact check on the words of both fields follows in place.
* `coverage` scans the texts as they run, by passages of RUN words, and merges the matched intervals of all training
  texts into the covered share of each evaluation record, whole or piecewise.

Beyond PASSES shards the records meet by keys instead (`nearsame.keyed`, with BK-trees of evaluation records that the
training records search), with the same result. Evaluation records with equal words are one; training copies are
scanned each.

Null or short fields overlap with nothing. A split that is null or unknown counts as evaluation: only `train` trains.
Rows given twice count once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tkanyna.llm.nearsame import MIN_WORDS, TENTHS, bitmaps, class_key, coded, differing, keyed, pieces, ranges, shares_enough, tree_candidates, word_counts, word_set
from tkanyna.llm.passages import LETTER, PassageAutomaton, letters
from tkanyna.llm.words import words
from tkanyna.session import written

SHARD = 40_000  # evaluation records, or passages of running text, in one automaton
PASSES = 12  # scans of all training texts
CUTS = 40  # distinct words; a longer record is cut for the largest number of differing words only
SPAN = 1_000_000  # matches that are compared at once
RUN = 5


def runs(n: int, cuts: int) -> list[int]:
    """Into how many runs a record of n words is to be cut, for every size of a near-same one; 0: beyond cuts, for all at once."""
    if n > cuts:
        return [0]
    return sorted({differing(n + m) + 1 for m in range(max(MIN_WORDS, -(-TENTHS * n // 10)), 10 * n // TENTHS + 1)})


def cut(n: int, k: int) -> list[tuple[int, int]]:
    """The ends of k runs of about equal length."""
    k = k or (10 - TENTHS) * n // TENTHS + 1
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


@lru_cache(maxsize=4096)
def kinds_of(m: int, cuts: int) -> tuple[int, ...]:
    """Into how many runs the records are cut that a text of m words may be near-same to."""
    if TENTHS * m > 10 * cuts:
        return (0,)
    return tuple({differing(n + m) + 1 if n <= cuts else 0 for n in range(max(MIN_WORDS, -(-TENTHS * m // 10)), 10 * m // TENTHS + 1)})


class Shard:
    """Evaluation records (ids, words of both fields), the automaton over their passages, and who has each of them."""

    def __init__(self, ids: np.ndarray, one: list[str], other: list[str]):
        self.cuts = CUTS
        self.ids, self.one, self.other = ids, one, other
        sets = [t.split(" ") for t in other]
        codes = coded(sets, {})
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        start = np.cumsum(self.n) - self.n
        self.bits = bitmaps(codes, start) if len(sets) else np.zeros((0, 2), np.uint64)
        flat = (codes & np.uint64(LETTER)).astype(np.int64)
        begin, size, held, kind = [], [], [], []
        for n in np.unique(self.n).tolist():
            own = np.flatnonzero(self.n == n)
            for k in runs(n, CUTS):
                for a, b in cut(n, k):
                    begin.append(start[own] + a)
                    size.append(np.full(len(own), b - a))
                    held.append(own)
                    kind.append(np.full(len(own), k))
        begin, size, held, kind = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begin, size, held, kind))
        table = np.zeros((len(begin), int(size.max(initial=1))), np.int32)
        for at in range(table.shape[1]):
            more = size > at
            table[more, at] = flat[begin[more] + at]
        self.automaton = PassageAutomaton(table, size)
        number = self.automaton.close()
        # the records of a passage stand together by kind: those of kind k from first[passage, k] to the next
        kinds = np.unique(kind)
        self.kinds = kinds.tolist()
        cell = number.astype(np.int64) * len(kinds) + np.searchsorted(kinds, kind)
        self.held = held[np.argsort(cell, kind="stable")].astype(np.int32)
        self.first = np.r_[0, np.cumsum(np.bincount(cell, minlength=(int(number.max(initial=-1)) + 1) * len(kinds)))].astype(np.int32)

    def pairs(self, flat: np.ndarray, m: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """(record, text) that share a passage, and whose sizes and bitmaps allow that they are near-same."""
        lengths, of = np.unique(m, return_inverse=True)
        groups = [[self.kinds.index(k) for k in kinds_of(x, self.cuts) if k in self.kinds] for x in lengths.tolist()]
        width = np.fromiter(map(len, groups), np.int64, len(groups))
        table, begin = np.array([k for g in groups for k in g], np.int64), np.cumsum(width) - width
        kinds = np.array(self.kinds, np.int64)
        found = [np.zeros((0, 2), np.int64)]
        for text, _, passage in self.automaton.intervals(flat, m):
            wide = width[of[text]]
            slot = table[ranges(begin[of[text]], wide)]
            text, cell = np.repeat(text, wide), np.repeat(passage.astype(np.int64), wide) * len(kinds) + slot
            low = self.first[cell].astype(np.int64)
            count = self.first[cell + 1] - low
            some = np.flatnonzero(count)
            text, slot, low, count = text[some], slot[some], low[some], count[some]
            for part in pieces(count, SPAN):
                a = self.held[ranges(low[part], count[part])]
                b, kind = np.repeat(text[part], count[part]), kinds[np.repeat(slot[part], count[part])]
                both = self.n[a] + m[b]
                keep = np.flatnonzero((kind == 0) | (kind == differing(both) + 1))
                a, b, both = a[keep], b[keep], both[keep]
                keep = np.bitwise_count(self.bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) * (10 + TENTHS) <= (10 - TENTHS) * both
                found.append(np.stack([a[keep], b[keep]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def hits(self, one: list[str], other: list[str], known: dict[str, int]) -> list[tuple[int, int]]:
        """(record id, text) of the near-same ones, by an exact check of both fields."""
        sets = [t.split(" ") for t in other]
        codes = coded(sets, known)
        m = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = (codes & np.uint64(LETTER)).astype(np.int64)
        out = []
        for a, b in self.pairs(flat, m, bitmaps(codes, np.cumsum(m) - m)).tolist():
            if enough(self.other[a], other[b]) and enough(self.one[a], one[b]):
                out.append((int(self.ids[a]), b))
        return out


_built: dict[bytes, Shard] = {}


class Packed:
    """A shard as it is broadcast: its records only; a worker builds the automaton, and keeps the latest."""

    def __init__(self, ids: list[int], one: list[str], other: list[str]):
        self.ids, self.texts = np.array(ids, np.int64), zlib.compress("\n".join([*one, *other]).encode(), 3)
        self.name = uuid.uuid4().bytes

    def shard(self) -> Shard:
        if self.name not in _built:
            texts = zlib.decompress(self.texts).decode().split("\n")
            _built.clear()
            _built[self.name] = Shard(self.ids, texts[: len(self.ids)], texts[len(self.ids) :])
        return _built[self.name]


@lru_cache(maxsize=20_000)
def _set(joined: str) -> frozenset[str]:
    return frozenset(joined.split(" "))


def enough(a: str, b: str) -> bool:
    """Whether two sets of words, each joined by blanks, are near-same."""
    if a == b:
        return True
    x, y = _set(a), _set(b)
    common = len(x & y)
    return common * 10 >= TENTHS * (len(x) + len(y) - common)


def _word_rows(df: DataFrame, key: str, fields: tuple[str, str], split: str, train: str) -> DataFrame:
    """(row, train, cls, one, other) of the rows whose two fields have enough words: those, distinct and in order."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            one = [word_set(t) for t in batch["one"].tolist()]
            other = [word_set(t) if w else [] for t, w in zip(batch["other"].tolist(), one)]
            cls = [class_key(a, b) if b else None for a, b in zip(one, other)]
            frame = pd.DataFrame({"row": batch["row"], "train": batch["train"], "cls": cls, "one": [" ".join(w) for w in one], "other": [" ".join(w) for w in other]})
            yield frame[frame["cls"].notna()]

    given = df.select(F.col(key).alias("row"), F.coalesce(F.col(split) == train, F.lit(False)).alias("train"), F.col(fields[0]).alias("one"), F.col(fields[1]).alias("other"))
    return written(given.filter("row is not null and one is not null and other is not null").mapInPandas(sets, "row bigint, train boolean, cls binary, one string, other string"))


def _sharded(rows: DataFrame, shards: int) -> Iterator[pd.DataFrame]:
    """The rows of each shard, at most twice SHARD of them, fetched one shard at a time."""
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    for shard in range(shards):
        part = placed.filter(F.col("shard") == shard).drop("shard").limit(2 * SHARD + 1).toArrow().to_pandas()
        if len(part) > 2 * SHARD:
            raise RuntimeError(f"a shard has more than {2 * SHARD} records")
        yield part


def cross_split_hits(df: DataFrame, key: str, fields: tuple[str, str], split: str, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """Members (row, id) of the evaluation rows with enough words, and hits (id, train_row) of near-same training rows.

    The id is the least key of the evaluation rows with the same words.
    """
    spark = df.sparkSession
    rows = _word_rows(df, key, fields, split, train)
    tests = rows.filter(~F.col("train"))
    classes = written(tests.groupBy("cls").agg(F.min("row").alias("id"), F.first("one").alias("one"), F.first("other").alias("other")))
    members = tests.select("row", "cls").distinct().join(classes.select("cls", "id"), "cls").select("row", "id")
    shards = -(-classes.count() // SHARD)
    if shards > PASSES:
        return members, _hits_by_keys(rows.filter("train"), classes)
    found = None
    for part in _sharded(classes.select("id", "one", "other"), shards):
        shard = spark.sparkContext.broadcast(Packed(part["id"].tolist(), part["one"].tolist(), part["other"].tolist()))

        def scan(batches: Iterator[pd.DataFrame], shard=shard) -> Iterator[pd.DataFrame]:
            known: dict[str, int] = {}
            for batch in batches:
                if len(batch):
                    own = batch["row"].tolist()
                    hits = shard.value.shard().hits(batch["one"].tolist(), batch["other"].tolist(), known)
                    yield pd.DataFrame([(a, own[b]) for a, b in hits], columns=["id", "train_row"])

        hits = rows.filter("train").select("row", "one", "other").mapInPandas(scan, "id bigint, train_row bigint")
        found = hits if found is None else found.unionByName(hits)
    return members, spark.createDataFrame([], "id bigint, train_row bigint") if found is None else found.distinct()


def _hits_by_keys(trains: DataFrame, classes: DataFrame) -> DataFrame:
    """The hits, by keys that evaluation and training records share."""
    copies = trains.groupBy("cls").agg(F.min("row").alias("train_id"), F.first("one").alias("one"), F.first("other").alias("other"))
    # an evaluation record is a class of its own beside the training one with the same words
    both = written(classes.select(F.col("id"), "one", "other", F.lit(True).alias("tests"), F.lit(False).alias("trains")).unionByName(copies.select(F.col("train_id").alias("id"), "one", "other", F.lit(False).alias("tests"), F.lit(True).alias("trains"))))
    counts = word_counts(trains.sparkSession, both, "other")
    pairs = tree_candidates(keyed(both, counts, "other", both.count(), ["tests", "trains"]), ordered=True)
    one = both.filter("tests").select(F.col("id").alias("a"), F.col("one").alias("one_a"), F.col("other").alias("other_a"))
    other = both.filter("trains").select(F.col("id").alias("b"), F.col("one").alias("one_b"), F.col("other").alias("other_b"))
    near = pairs.join(one, "a").join(other, "b").filter(shares_enough("other_a", "other_b") & shares_enough("one_a", "one_b")).select(F.col("a").alias("id"), "b")
    rows = trains.select("row", "cls").distinct().join(copies.select("cls", F.col("train_id").alias("b")), "cls")
    return near.join(rows, "b").select("id", F.col("row").alias("train_row"))


def cross_split_pairs(df: DataFrame, key: str, fields: tuple[str, str], split: str, train: str = "train") -> DataFrame:
    """Every pair (test_row, train_row) of an evaluation and a training row whose two fields are both near-same."""
    members, hits = cross_split_hits(df, key, fields, split, train)
    return hits.join(members.withColumnRenamed("row", "test_row"), "id").select("test_row", "train_row").distinct()


def overlap_report(df: DataFrame, key: str, fields: tuple[str, str], split: str, origin: str) -> DataFrame:
    """Per evaluation split and origin: its rows, those that overlap with training, and the training rows concerned."""
    members, hits = cross_split_hits(df, key, fields, split)
    rows = members.join(hits.groupBy("id").agg(F.count(F.lit(1)).alias("train_rows")), "id").select(F.col("row").alias(key), "train_rows")
    tests = df.filter(~F.coalesce(F.col(split) == "train", F.lit(False))).select(key, split, origin)
    return tests.join(rows, key, "left").groupBy(split, origin).agg(F.count(F.lit(1)).alias("rows"), F.count("train_rows").alias("overlapping"), F.coalesce(F.sum("train_rows"), F.lit(0)).alias("train_matches"))


WORDS = [f"w{i}" for i in range(RUN)]


def _running(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with the passages of RUN words of `text`: id (a hash of it), at, and its letters."""
    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in columns)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            sets = [words(t) for t in batch["text"].tolist()]
            flat, n = letters(sets, known), np.fromiter(map(len, sets), np.int64, len(sets))
            many = np.maximum(n - RUN + 1, 0)
            place = ranges(np.cumsum(n) - n, many)
            out = pd.DataFrame({w: flat[place + i] for i, w in enumerate(WORDS)})
            row = np.repeat(np.arange(len(n)), many)
            out["at"] = ranges(np.zeros(len(n), np.int64), many).astype(np.int32)
            out["n"] = n[row].astype(np.int32)
            for c in columns:
                out[c] = batch[c].to_numpy()[row]
            yield out

    made = df.mapInPandas(spread, ", ".join(f"{w} bigint" for w in WORDS) + f", at int, n int{kinds}")
    return made.withColumn("id", F.xxhash64(*WORDS))


def coverage(df: DataFrame, key: str, fields: tuple[str, str], split: str, train: str = "train") -> DataFrame:
    """(key, field, words, covered) of each field of an evaluation row that shares RUN words in a row with training texts.

    covered: the share of its words that lie in the matched intervals of all training texts, merged. Passages are those
    of the same field. A text of fewer than RUN words has no row.
    """
    spark = df.sparkSession
    tests = ~F.coalesce(F.col(split) == train, F.lit(False))
    stacked = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("row"), tests.alias("tests"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"))
    given = stacked.select("row", "tests", "x.field", "x.text").filter("text is not null")
    passages = written(_running(given.filter("tests"), ["row", "field"]))
    distinct = written(passages.select("id", *WORDS).distinct())
    trains = given.filter("not tests")
    shards, hit = -(-distinct.count() // (4 * SHARD)), None
    if shards > PASSES:
        hit = _running(trains, ["field"]).select("field", "id").distinct()
    else:
        for part in _sharded_passages(distinct, shards):
            automaton = PassageAutomaton(part[WORDS].to_numpy(np.int32), np.full(len(part), RUN))
            number = automaton.close()
            shard = spark.sparkContext.broadcast((part["id"].to_numpy()[np.argsort(number)], automaton))

            def scan(batches: Iterator[pd.DataFrame], shard=shard) -> Iterator[pd.DataFrame]:
                ids, automaton = shard.value
                known: dict[str, int] = {}
                seen: dict[str, np.ndarray] = {}
                for batch in batches:
                    field = batch["field"].to_numpy()
                    for name in np.unique(field):
                        sets = [words(t) for t in batch["text"][field == name].tolist()]
                        matched = seen.setdefault(name, np.zeros(len(ids), bool))
                        for _, _, passage in automaton.intervals(letters(sets, known), np.fromiter(map(len, sets), np.int64, len(sets))):
                            matched[passage] = True
                for name, matched in seen.items():
                    yield pd.DataFrame({"field": name, "id": ids[matched]})

            found = trains.select("field", "text").mapInPandas(scan, "field string, id bigint")
            hit = found if hit is None else hit.unionByName(found)
    if hit is None:
        hit = spark.createDataFrame([], "field string, id bigint")
    covered = passages.join(hit.distinct(), ["field", "id"], "left_semi").groupBy("row", "field").agg(F.max("n").alias("words"), F.collect_set("at").alias("places"))
    merged = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (RUN - 1))))))
    return covered.select(F.col("row").alias(key), "field", F.col("words").cast("bigint").alias("words"), F.round(merged / F.col("words"), 6).alias("covered"))


def _sharded_passages(distinct: DataFrame, shards: int) -> Iterator[pd.DataFrame]:
    placed = distinct.dropDuplicates(["id"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    for shard in range(shards):
        yield placed.filter(F.col("shard") == shard).drop("shard").toArrow().to_pandas()
