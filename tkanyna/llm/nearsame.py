"""Near-same texts without comparing all pairs: exact prefix keys, integer Hamming distances, exact check.

Two texts are near-same if both have at least 8 distinct words and share at least 70 % of all their distinct words.
Rows with one word set form a class; only classes are compared. Words are ordered by rarity, taken from counts in a
table of fixed size (any common order keeps the result exact). Near-same sets then share their first common word among
the first n - ceil(0.7 n) + 1 words, and each further one among one more. A key is a run of words of that prefix, made
longer, up to DEEP words, until the counts let expect few classes to have it; whether a run is long enough depends on
its words only, so two near-same sets always have a key in common.

A class goes to the shard of each of its keys. A shard is a BK-tree over 128-bit bitmaps of word sets (children keyed by
the integer Hamming distance to their parent): two sets that differ in k words have bitmaps that differ in at most k
bits, so a search follows only edges within the radius that the sizes allow. The trees of all shards of a batch are built
and searched together, a level at a time, and candidates leave in pieces; the exact check follows.

Keys are counted before they are moved. One that more than BLOCK classes have is split into blocks that meet in cells, a
block in a tree of its own and the other searching it; no row is dropped. Null, blank and short texts are near-same to
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tkanyna.llm.components import components
from tkanyna.llm.words import code, words
from tkanyna.session import written

MIN_WORDS = 8
TENTHS = 7  # of all distinct words, that many tenths occur in both
SLOTS = 1 << 18  # counts of words, whatever the size of the corpus
RARE = 4000  # classes that may be expected to have a key, or a SHARE of all, if that is more
SHARE = 20_000
DEEP = 4  # words of a key
BLOCK = 10_000  # classes of one key that one tree holds
HOT = 100_000  # hot keys that are broadcast
VISITS = 400_000  # steps of searches that are taken at once
LONG = 120  # distinct words; a longer text has keys of single words only, so that pairs of its words don't multiply


def word_set(text: str | None) -> list[str]:
    """The distinct words in order, or nothing for a text with fewer than MIN_WORDS."""
    found = sorted(set(words(text)))
    return found if len(found) >= MIN_WORDS else []


def class_key(*sets: list[str]) -> bytes:
    return xxhash.xxh3_128_digest("\n\n".join("\n".join(s) for s in sets))


def word_counts(spark: SparkSession, sets: DataFrame, column: str) -> Broadcast:
    """In how many rows a word occurs, in SLOTS counters; partitions count before anything is sent."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        slot: dict[str, int] = {}
        for batch in batches:
            found = []
            for ws in batch[column].tolist():
                for w in ws.split(" "):
                    if (s := slot.get(w)) is None:
                        if len(slot) > 500_000:
                            slot.clear()
                        s = slot[w] = code(w) & (SLOTS - 1)
                    found.append(s)
            total += np.bincount(np.asarray(found, np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"slot": used, "n": total[used]})

    rows = sets.select(column).mapInPandas(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(counts)


def prefix_length(n: int) -> int:
    return n - -(-TENTHS * n // 10) + 1


def rare_enough(total: int) -> float:
    return max(RARE, total / SHARE)


def keys_of(codes: np.ndarray, counts: np.ndarray, total: int, enough: float) -> list[tuple[int, ...]]:
    """Places of the words of each key of a class, rarest first. total: how many classes there are; enough: how many may have a key."""
    n = len(codes)
    often = counts[codes & np.uint64(SLOTS - 1)]
    order = np.lexsort((codes, often)).tolist()
    p = prefix_length(n)
    share = (often[order[: min(n, p + DEEP)]] / max(1, total)).tolist()
    keys: list[tuple[int, ...]] = []
    if n <= LONG:
        todo = [((), float(total), 0)]
        while todo:
            run, most, start = todo.pop()
            for i in range(start, min(n, p + len(run))):
                longer, fewer = (*run, order[i]), most * share[i]
                if fewer <= enough or len(longer) == DEEP:
                    keys.append(longer)
                else:
                    todo.append((longer, fewer, i + 1))
    if 10 * n > TENTHS * LONG:  # may be near-same to a set of more than LONG words, which has single words only
        keys += [(i,) for i in order[:p] if (i,) not in keys]
    return keys


def bitmap(codes: np.ndarray) -> tuple[int, int]:
    low = high = 0
    for c in codes.tolist():
        bit = (c >> 40) & 127
        if bit < 64:
            low |= 1 << bit
        else:
            high |= 1 << (bit - 64)
    return low, high


def coded(sets: list[list[str]], known: dict[str, int]) -> np.ndarray:
    """The codes of all words of the sets, in one array."""
    out = []
    for ws in sets:
        for w in ws:
            if (c := known.get(w)) is None:
                if len(known) > 500_000:
                    known.clear()
                c = known[w] = code(w)
            out.append(c)
    return np.array(out, np.uint64)


def bitmaps(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits of each set of words, two numbers a set; the sets begin at starts."""
    bit = (codes >> np.uint64(40)) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    low, high = np.where(bit < 64, one, np.uint64(0)), np.where(bit < 64, np.uint64(0), one)
    return np.stack([np.bitwise_or.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)], axis=1)


def keyed(classes: DataFrame, counts: Broadcast, column: str, total: int, sides: list[str] = []) -> DataFrame:  # noqa: B006
    """A row for each key of each class: key, id, its bitmap (low, high), its size n, and its side.

    sides: two boolean columns; a class has rows with side 1 and 2 where they hold. Without them, side is 0. Classes are
    written once with all their keys, so that keys can be counted before they are moved.
    """
    enough = rare_enough(total)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = counts.value, {}
        for batch in batches:
            if not len(batch):
                continue
            sets = [v.split(" ") for v in batch[column].tolist()]
            flat = coded(sets, known)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            starts = np.cumsum(n) - n
            bits = bitmaps(flat, starts).view(np.int64)
            keys = []
            for ws, s, k in zip(sets, starts.tolist(), n.tolist()):
                found = [code(" ".join([ws[j] for j in key])) for key in keys_of(flat[s : s + k], table, total, enough)]
                keys.append(np.array(found, np.uint64).view(np.int64))
            out = batch[["id", *sides]].assign(low=bits[:, 0], high=bits[:, 1], n=n.astype(np.int32))
            out["keys"] = keys
            yield out

    kinds = "".join(f", {c} boolean" for c in sides)
    made = written(classes.select("id", column, *sides).mapInPandas(make, f"id bigint{kinds}, low bigint, high bigint, n int, keys array<bigint>"))
    rows = made.select(F.explode("keys").alias("key"), "id", "low", "high", "n", *sides)
    if not sides:
        return rows.withColumn("side", F.lit(0))
    return rows.withColumn("side", F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(i)) for i, c in enumerate(sides, 1)]), lambda x: x.isNotNull()))).drop(*sides)


def cells(keys: DataFrame) -> DataFrame:
    """The rows of keys, those of hot keys in the cells of their blocks; a cell of two blocks has sides 1 and 2."""
    hot = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > BLOCK))
    if hot.count() <= HOT:  # so that the rows of keys are moved once only
        hot = F.broadcast(hot)
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    both = keys.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    within = F.transform(every, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.when(F.col("own") == j, 0).when(F.col("own") < j, 1).otherwise(2).alias("side")))
    across = F.transform(every, lambda j: F.struct(F.when(F.col("side") == 1, F.col("own")).otherwise(j).alias("i"), F.when(F.col("side") == 1, j).otherwise(F.col("own")).alias("j"), F.col("side").alias("side")))
    cold = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("side").alias("side")))
    cell = F.explode(F.when(F.col("many").isNull(), cold).when(F.col("side") == 0, within).otherwise(across))
    spread = both.select("key", "id", "low", "high", "n", cell.alias("cell"))
    return spread.select(F.when(F.col("cell.i") < 0, F.col("key")).otherwise(F.xxhash64("key", "cell.i", "cell.j")).alias("key"), "id", "low", "high", "n", F.col("cell.side").alias("side"))


def differing(total: np.ndarray | int) -> np.ndarray | int:
    """In how many words near-same sets of so many words together differ at most."""
    return total - 2 * -(-TENTHS * total // (10 + TENTHS))


class Forest:
    """BK-trees over bitmaps, one for each size of sets in a group, built and searched together.

    A node is a bitmap, and `first[k, d]` to `first[k, d + 1]` are its children at distance d; nodes are numbered so
    that the children of a node stand together, ordered by distance. Rows with equal bitmaps share a node.
    """

    def __init__(self, group: np.ndarray, bits: np.ndarray, n: np.ndarray):
        order = np.lexsort((bits[:, 1], bits[:, 0], n, group))
        g, b, m = group[order], bits[order], n[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (m[1:] != m[:-1]) | (b[1:] != b[:-1]).any(axis=1)]
        own = np.flatnonzero(new)
        self.turn = np.empty(len(order), np.int64)  # of the bitmap of each row
        self.turn[order] = np.cumsum(new) - 1
        begin, end = own, np.r_[own[1:], len(g)]
        g, b, m = g[own], b[own], m[own]
        tree = np.r_[True, (g[1:] != g[:-1]) | (m[1:] != m[:-1])]
        self.groups, self.sizes = g[tree], m[tree]  # of the trees, in order; the root of tree i is node i
        # a level at a time: the head of each part is a node, and the rest of it parts by the distance to its head
        part = np.cumsum(tree) - 1
        active, heads, edges, parents = np.arange(len(g)), [], [], []
        edge = np.zeros(part[-1] + 1, np.int64)
        parent = np.full(part[-1] + 1, -1, np.int64)
        done = 0
        while len(active):
            head = np.r_[True, part[1:] != part[:-1]]
            at = np.cumsum(head) - 1
            heads.append(active[head])
            edges.append(edge)
            parents.append(parent)
            rest, up = active[~head], at[~head]
            d = np.bitwise_count(b[rest] ^ b[active[head]][up]).sum(axis=1, dtype=np.int64)
            turn = np.lexsort((d, up))
            active, up, d = rest[turn], up[turn], d[turn]
            if len(active):
                fresh = np.r_[True, (up[1:] != up[:-1]) | (d[1:] != d[:-1])]
                part = np.cumsum(fresh) - 1
                edge, parent = d[fresh], up[fresh] + done
            done += int(head.sum())
        node = np.concatenate(heads)
        self.low, self.high, self.size = (np.ascontiguousarray(x) for x in (b[node, 0], b[node, 1], m[node]))
        self.place = node  # of the bitmap of each node; a node stands before all below it
        self.member, self.begin, self.end = order, begin[node], end[node]
        parent, edge = np.concatenate(parents), np.concatenate(edges)
        self.width = int(edge.max(initial=0)) + 2
        kids = parent >= 0
        many = np.bincount(parent[kids] * self.width + edge[kids] + 1, minlength=len(node) * self.width).reshape(len(node), self.width)
        start = np.cumsum(many.sum(axis=1)) - many.sum(axis=1) + int((~kids).sum())
        self.first = (start[:, None] + np.cumsum(many, axis=1)).astype(np.int32).ravel()

    def search(self, group: np.ndarray, bits: np.ndarray, n: np.ndarray, before: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) within the radius that their sizes allow, in pieces; a query looks into the trees of its group.

        before: the turns of the queries' own bitmaps, for queries that are rows of the forest; of two rows only one
        then finds the other, but for equal bitmaps.
        """
        # of the trees of its group, those whose sizes are near enough
        least, most = -(-TENTHS * n // 10), 10 * n // TENTHS if before is None else n
        name, of = np.unique(np.concatenate([self.groups, group]), return_inverse=True)
        trees = of[: len(self.groups)] * (1 << 32) + self.sizes
        own = of[len(self.groups) :] * (1 << 32)
        lo, hi = np.searchsorted(trees, own + least, "left"), np.searchsorted(trees, own + most, "right")
        reach = differing(np.arange(2 * max(int(n.max(initial=0)), int(self.size.max(initial=0))) + 1))
        low, high = np.ascontiguousarray(bits[:, 0]), np.ascontiguousarray(bits[:, 1])
        todo = []
        for piece in pieces(hi - lo, VISITS):
            many = (hi - lo)[piece]
            todo.append((np.repeat(np.arange(len(n))[piece], many), ranges(lo[piece], many)))
        while todo:
            q, node = todo.pop()
            d = np.bitwise_count(low[q] ^ self.low[node]).astype(np.int32)
            d += np.bitwise_count(high[q] ^ self.high[node])
            r = reach[n[q] + self.size[node]].astype(np.int32)
            hit = np.flatnonzero(d <= r)
            if len(hit):
                found, many = node[hit], (self.end - self.begin)[node[hit]]
                for piece in pieces(many, VISITS):
                    yield np.repeat(q[hit][piece], many[piece]), self.member[ranges(self.begin[found[piece]], many[piece])]
            row = node * self.width
            lo, hi = self.first[row + np.clip(d - r, 0, self.width - 1)], self.first[row + np.minimum(d + r + 1, self.width - 1)]
            many = hi - lo
            some = np.flatnonzero(many)
            q, lo, many = q[some], lo[some], many[some]
            for piece in pieces(many, VISITS):
                asks, below = np.repeat(q[piece], many[piece]), ranges(lo[piece], many[piece])
                if before is not None:
                    keep = (self.size[below] < n[asks]) | (self.place[below] <= before[asks])
                    asks, below = asks[keep], below[keep]
                if len(asks):
                    todo.append((asks, below))


def pieces(many: np.ndarray, most: int) -> list[slice]:
    """Slices of about `most` in sum each."""
    total = np.cumsum(many)
    cuts = np.flatnonzero(np.diff(total // most)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(many)]) if b > a]


def ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)


def _search(rows: pd.DataFrame, ordered: bool) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of rows of one key: a < b, or if ordered, a of side 1. Sides 1 and 2 only meet each other."""
    group, ids, n, side = (rows[c].to_numpy() for c in ("key", "id", "n", "side"))
    n = n.astype(np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, len(group)])
    alone = np.repeat(size == 1, size)
    if alone.all():
        return
    group, ids, n, side = (x[~alone] for x in (group, ids, n, side))
    bits = np.stack([rows["low"].to_numpy()[~alone], rows["high"].to_numpy()[~alone]], axis=1).view(np.uint64)
    # rows of side 0 search themselves, rows of side 2 those of side 1
    for held, asks in ((side == 0, None), (side == 1, np.flatnonzero(side == 2))):
        held = np.flatnonzero(held)
        if not len(held) or asks is not None and not len(asks):
            continue
        forest = Forest(group[held], bits[held], n[held])
        mine = held if asks is None else asks
        for q, row in forest.search(group[mine], bits[mine], n[mine], forest.turn if asks is None else None):
            a, b = held[row], mine[q]
            keep = ids[a] != ids[b]
            if keep.any():
                found = np.stack([ids[a[keep]], ids[b[keep]]], axis=1)
                found = np.unique(found if ordered else np.sort(found, axis=1), axis=0)
                yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def tree_candidates(keys: DataFrame, ordered: bool = False) -> DataFrame:
    """Distinct candidate pairs of classes that share a key and lie within the radius."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            rows = pd.concat([*kept, batch], ignore_index=True) if kept else batch
            last = rows["key"].to_numpy() == rows["key"].iloc[-1]
            kept = [rows[last]]
            if not last.all():
                yield from _search(rows[~last], ordered)
        if kept:
            yield from _search(kept[0], ordered)

    return cells(keys).repartition("key").sortWithinPartitions("key").mapInPandas(search, "a bigint, b bigint").distinct()


def shares_enough(one: str, other: str) -> Column:
    """Whether two sets of words, each joined by blanks, are near-same."""
    a, b = F.split(one, " "), F.split(other, " ")
    common = F.size(F.array_intersect(a, b))
    return common * 10 >= TENTHS * (F.size(a) + F.size(b) - common)


def near_same_classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Members (row, id) of every text with enough words, and the near-same pairs (a < b) of the ids of different classes.

    The id of a class is the least key of its rows.
    """

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ws = [word_set(t) for t in batch["text"].tolist()]
            frame = pd.DataFrame({"row": batch["row"], "cls": [class_key(w) if w else None for w in ws], "words": [" ".join(w) for w in ws]})
            yield frame[frame["cls"].notna()]

    given = df.select(F.col(key).alias("row"), F.col(text).alias("text")).filter("row is not null and text is not null")
    rows = written(given.mapInPandas(sets, "row bigint, cls binary, words string"))
    classes = written(rows.groupBy("cls").agg(F.min("row").alias("id"), F.first("words").alias("words")))
    counts = word_counts(df.sparkSession, classes, "words")
    pairs = tree_candidates(keyed(classes, counts, "words", classes.count()))
    one = classes.select(F.col("id").alias("a"), F.col("words").alias("words_a"))
    other = classes.select(F.col("id").alias("b"), F.col("words").alias("words_b"))
    members = written(rows.select("row", "cls").distinct().join(classes.select("cls", "id"), "cls").select("row", "id"))
    return members, pairs.join(one, "a").join(other, "b").filter(shares_enough("words_a", "words_b")).select("a", "b")


def near_same_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every pair (row_a < row_b) of rows with near-same texts, copies included; rows given twice count once."""
    members, pairs = near_same_classes(df, key, text)
    a = members.select(F.col("row").alias("row_a"), F.col("id").alias("a"))
    b = members.select(F.col("row").alias("row_b"), F.col("id").alias("b"))
    copies = a.join(b, F.col("a") == F.col("b")).filter("row_a < row_b").select("row_a", "row_b")
    edited = pairs.join(a, "a").join(b, "b").select(F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b"))
    return copies.unionByName(edited).distinct()


def near_same_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each row of df: key, group_id (the least key of all it is linked with, over any number of links), links.

    links counts the rows that are near-same to it, copies included; a row near-same to nothing is its own group.
    """
    members, pairs = near_same_classes(df, key, text)
    pairs = written(pairs)
    copies = members.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(copies.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    classes = copies.join(components(pairs).withColumnRenamed("node", "id"), "id", "left").join(linked.withColumnRenamed("a", "id"), "id", "left")
    classes = classes.select("id", F.coalesce("root", "id").alias("group_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    rows = members.join(classes, "id").select("row", "group_id", "links")
    every = df.select(F.col(key).alias("row"))
    return every.join(rows, "row", "left").select(F.col("row").alias(key), F.coalesce("group_id", "row").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
