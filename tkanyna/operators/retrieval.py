"""Dictionary entries that a batch of sentences calls for: sparse cosine over word counts, top k of each batch.

Counts are integers and a score is one division, so it doesn't depend on the order of additions. The join is on words,
and words that a batch and an entry don't share cost nothing; the dictionary side is broadcast only if its counted
rows stay within MOST_BROADCAST, and joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tkanyna.functions.text import words

MOST_BROADCAST = 200_000  # words of dictionary entries


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): how often each word occurs in each text; texts of one key count together."""
    return df.select(key, F.explode(words(text)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts over the highest count of the text, as tf."""
    counts = term_counts(df, key, text)
    top = counts.groupBy(key).agg(F.max("n").alias("top"))
    return counts.join(top, key).select(key, "token", "n", (F.col("n") / F.col("top")).alias("tf"))


def norms(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(F.sum(F.col("n") * F.col("n")).alias("norm"))


def relevant_entries(sentences: DataFrame, entries: DataFrame, batch: str = "batch_id", text: str = "text", top_k: int = 50, threshold: float = 0.05) -> DataFrame:
    """(batch, entry_idx, ukrainian, hutsul, sim, rank): entries with cosine >= threshold, best first, at most top_k a batch.

    entries: entry_idx, ukrainian, hutsul. Equal scores are ranked by entry_idx. With a threshold of 0 or less every
    entry is compared with every batch, entries without a common word scoring 0.
    """
    ours = term_counts(sentences.select(batch, text).repartition(batch), batch, text)  # one shuffle serves counts, norms, scores and ranks
    theirs = term_counts(entries, "entry_idx", "ukrainian")
    few = theirs.count() <= MOST_BROADCAST
    side = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    right = theirs.withColumnRenamed("n", "m").join(norms(theirs, "entry_idx").withColumnRenamed("norm", "entry_norm"), "entry_idx")
    dots = ours.join(side(right), "token").groupBy(batch, "entry_idx").agg(F.sum(F.col("n") * F.col("m")).alias("dot"), F.first("entry_norm").alias("entry_norm"))
    scored = dots.join(norms(ours, batch), batch).withColumn("sim", F.col("dot") / F.sqrt((F.col("norm") * F.col("entry_norm")).cast("double")))
    if threshold <= 0:
        every = sentences.select(batch).distinct().crossJoin(F.broadcast(entries.select("entry_idx")))
        scored = every.join(scored.select(batch, "entry_idx", "sim"), [batch, "entry_idx"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(F.col("sim").desc(), F.col("entry_idx")))
    best = scored.filter(F.col("sim") >= threshold).withColumn("rank", rank).filter(F.col("rank") <= top_k)
    return best.select(batch, "entry_idx", "sim", F.col("rank").cast("bigint").alias("rank")).join(side(entries), "entry_idx").select(batch, "entry_idx", "ukrainian", "hutsul", "sim", "rank")


def batch_dictionaries(found: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, entries): the entries of each batch in rank order, as structs (ukrainian, hutsul)."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "ukrainian", "hutsul")))
    return found.groupBy(batch).agg(F.transform(ordered, lambda x: F.struct(x["ukrainian"].alias("ukrainian"), x["hutsul"].alias("hutsul"))).alias("entries"))
