"""The queries over the test tables, each over whole tables with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tkanyna.llm import answers, leak, level, lookalike, mixing, nearsame, overlap, truncation
from tkanyna.llm.sql import oracle_sql  # noqa: F401


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = nearsame.near_same_pairs(_read(spark, folder, "standard_ukrainian"), "sent_id", "text")
    return pairs.select(F.col("row_a").alias("sent_id_a"), F.col("row_b").alias("sent_id_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return nearsame.near_same_groups(_read(spark, folder, "standard_ukrainian"), "sent_id", "text")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = truncation.cut_renderings(_read(spark, folder, "parallel_pairs"), "pair_id", "source", "target")
    corpus = truncation.cut_renderings(_read(spark, folder, "jsonl_corpus"), "record_id", "generated_dialect", "source_standard")
    return pairs.select(F.lit("parallel_pairs").alias("tbl"), F.col("row").alias("row_id")).unionByName(corpus.select(F.lit("jsonl_corpus").alias("tbl"), F.col("row").alias("row_id")))


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    pairs, corpus = _read(spark, folder, "parallel_pairs"), _read(spark, folder, "jsonl_corpus").withColumn("model", F.col("provenance.model"))
    a = truncation.truncation_rates(pairs, "pair_id", "origin", truncation.cut_renderings(pairs, "pair_id", "source", "target"))
    b = truncation.truncation_rates(corpus, "record_id", "model", truncation.cut_renderings(corpus, "record_id", "generated_dialect", "source_standard"))
    return a.withColumn("tbl", F.lit("parallel_pairs")).unionByName(b.withColumn("tbl", F.lit("jsonl_corpus")))


def p2_prefix_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Values of either field that are strict prefixes, perhaps inside a word, of another value of either."""
    values = lookalike.stacked([("parallel_pairs", _read(spark, folder, "parallel_pairs"), "pair_id", ["source"]), ("jsonl_corpus", _read(spark, folder, "jsonl_corpus"), "record_id", ["generated_dialect"])])
    return truncation.prefix_copies(values, ["tbl", "row_id"], "value", least=1)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(_read(spark, folder, "parallel_pairs"), "pair_id", ("source", "target"), "split")
    return pairs.select(F.least("test_row", "train_row").alias("pair_id_a"), F.greatest("test_row", "train_row").alias("pair_id_b"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_read(spark, folder, "parallel_pairs"), "pair_id", ("source", "target"), "split", "origin")


def p3_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.coverage(_read(spark, folder, "parallel_pairs"), "pair_id", ("source", "target"), "split")


def _values(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.stacked([("standard_ukrainian", _read(spark, folder, "standard_ukrainian"), "sent_id", ["text"]), ("parallel_pairs", _read(spark, folder, "parallel_pairs"), "pair_id", ["source", "target"])])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.usual_values(_values(spark, folder), ["tbl", "row_id", "field"]).select("tbl", "row_id", "field")


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value, in the usual form."""
    every = lookalike.with_usual(_values(spark, folder), ["tbl", "row_id", "field"])
    return every.select("tbl", "row_id", "field", F.col("usual").alias("value"), F.coalesce(F.col("usual") != F.col("value"), F.lit(False)).alias("changed"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return answers.defects(_read(spark, folder, "jsonl_corpus"), "record_id", "source_standard", "generated_dialect")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leak.leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per test item: the documents it leaked into."""
    items = _read(spark, folder, "eval_items")
    found = leak.leaks(_read(spark, folder, "documents"), items, "doc_id", "text", "item_id", "text")
    many = found.groupBy("item").agg(F.count(F.lit(1)).alias("documents"), F.round(F.max("covered"), 4).alias("most_covered"))
    return items.join(many, items["item_id"] == many["item"], "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), "most_covered")


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with leaked spans removed."""
    return leak.without_leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text").select("doc_id", "text")


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"), "doc_id", "text", "source")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = _read(spark, folder, "documents"), _read(spark, folder, "level_labels")
    return level.reading_levels(documents, labels, "doc_id", "text", "level").join(labels.select("doc_id").distinct(), "doc_id", "left_anti")


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by source, language and level."""
    documents = _read(spark, folder, "documents")
    levels = level.reading_levels(documents, _read(spark, folder, "level_labels"), "doc_id", "text", "level")
    return documents.select("doc_id", "source", "lang").join(levels, "doc_id").groupBy("source", "lang", "level").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_groups, p2_found, p2_rates, p2_prefix_copies, p3_found, p3_report, p3_coverage, p4_found, p4_values, p5_found, p7_found, p7_items, p7_cleaned, p8_mixture, p8_report, p9_found, p9_profile]
    return {f.__name__: f for f in found}
