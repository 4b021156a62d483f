"""Assembling corpora: unions, exact deduplication, renames, resumption, batches, shuffles and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tkanyna.functions.text import not_blank
from tkanyna.session import written


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assemble(parts: list[DataFrame], text: str = "text") -> DataFrame:
    """The distinct texts of all parts that aren't blank, unstripped. Order is by a hash of the text where it matters."""
    return union_all(*[p.select(text) for p in parts]).filter(not_blank(text)).distinct()


def swapped(df: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target) with the two columns given in those roles."""
    return df.select(F.col(source).alias("source"), F.col(target).alias("target"))


def merge_pairs(*parts: DataFrame) -> DataFrame:
    """One parallel corpus of several: (source, target), repeats kept."""
    return union_all(*[p.select("source", "target") for p in parts])


def batches(df: DataFrame, size: int, index: str = "sent_idx", text: str = "text", start: int = 0) -> DataFrame:
    """(batch_id, inputs): size consecutive rows each, the last perhaps fewer; inputs are structs (sent_idx, text) in order."""
    batch = F.floor((F.col(index) - start) / size).cast("bigint")
    rows = F.sort_array(F.collect_list(F.struct(F.col(index).alias("sent_idx"), F.col(text).alias("text"))))
    return df.filter(F.col(index) >= start).groupBy(batch.alias("batch_id")).agg(rows.alias("inputs"))


def pending(inputs: DataFrame, done: DataFrame, key: str = "sent_idx") -> DataFrame:
    """The inputs that have no row in done, whatever became of those that have."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def shuffle_key(key: Column | str, seed: int = 42) -> Column:
    """A hash by which rows are put in a random order that any engine can repeat."""
    return F.md5(F.concat(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(f"-{seed}")))


def train_test_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """With split `test` for ceil(share * n) rows, those first in the shuffled order, and `train` for the others.

    The threshold is found by counting hashes in ranges, not by ranking all rows in one task; ties of the hash, which
    only repeated keys have, are broken by key.
    """
    hashed = df.withColumn("_h", shuffle_key(key, seed))
    total = hashed.count()
    if total == 0:
        return df.withColumn("split", F.lit("train"))
    wanted = -int(-share * total // 1)
    edge, left = _kth(hashed, wanted)
    if edge is None:
        return hashed.drop("_h").withColumn("split", F.lit("train"))
    below, at = F.col("_h") < edge, F.col("_h") == edge
    tied = hashed.filter(at)
    rank = F.row_number().over(Window.partitionBy("_h").orderBy(key))
    first = tied.withColumn("_r", rank).withColumn("split", F.when(F.col("_r") <= left, "test").otherwise("train")).drop("_r")
    rest = hashed.filter(~at).withColumn("split", F.when(below, "test").otherwise("train"))
    return rest.unionByName(first).drop("_h")


def _kth(hashed: DataFrame, k: int) -> tuple[str | None, int]:
    """The k-th hash in order, and how many rows of that hash are among the first k; found digit by digit."""
    prefix = ""
    if k <= 0:
        return None, 0
    while True:
        width = min(len(prefix) + 3, 32)
        counts = hashed.filter(F.col("_h").startswith(prefix)).groupBy(F.substring("_h", 1, width).alias("p")).count().orderBy("p").collect()
        for row in counts:
            if k <= row["count"]:
                prefix = row["p"]
                few = row["count"]
                break
            k -= row["count"]
        if width == 32:
            return prefix, k
        if few == 1:
            return hashed.filter(F.col("_h").startswith(prefix)).first()["_h"], 1


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """In the shuffled order."""
    return df.orderBy(shuffle_key(key, seed), key)


def training_steps(rows: int, batch: int, accumulate: int, epochs: int) -> tuple[int, int]:
    """Optimizer steps, and those of the warm-up: a tenth of them, at most 1000."""
    steps = rows // (batch * accumulate) * epochs
    return steps, min(1000, int(0.1 * steps))


def running_total(df: DataFrame, order: str, value: str, name: str = "total") -> DataFrame:
    """With the sum of value up to each row in the order of a unique key: sums within ranges, offset by the ranges before."""
    kept = written(df.orderBy(order).withColumn("_p", F.spark_partition_id()))
    sums = sorted((r["_p"], r["s"] or 0) for r in kept.groupBy("_p").agg(F.sum(value).alias("s")).collect())
    offsets, total = [], 0
    for part, size in sums:
        offsets.append((part, total))
        total += size
    before = df.sparkSession.createDataFrame(offsets, "_p int, _before bigint")
    own = F.sum(value).over(Window.partitionBy("_p").orderBy(order))
    return kept.withColumn("_own", own).join(F.broadcast(before), "_p").select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def padded(df: DataFrame, ids: str, batch: str, multiple: int = 8, pad: int = 0) -> DataFrame:
    """Ids filled with pad to the longest of their batch, rounded up to a multiple."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_longest"))
    width = (F.ceil(F.col("_longest") / multiple) * multiple).cast("int")
    joined = df.join(longest, batch)
    return joined.withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad), width - F.size(ids)))).drop("_longest")
