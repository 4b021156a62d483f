"""Reading and writing the files of a corpus: CSV, text, JSONL, Parquet. Column order and text are kept exactly."""

from __future__ import annotations

import json
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tkanyna.functions.text import in_length, strip
from tkanyna.session import written

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
RECORD = "source_standard string, generated_dialect string, dialect string, method string, provenance struct<model: string, rules_file: string, timestamp: string>"


def numbered(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """With the place of each row in reading order, counted within partitions and offset by the sizes of those before.

    The rows are written once with their partitions, so that the places hold whatever is done with them later.
    """
    kept = written(df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = sorted(tuple(r) for r in kept.groupBy("_p").agg(F.min("_m"), F.count(F.lit(1))).collect())
    offsets, total = [], start
    for part, first, size in sizes:
        offsets.append((part, total - first))
        total += size
    before = df.sparkSession.createDataFrame(offsets, "_p int, _before bigint")
    return kept.join(F.broadcast(before), "_p").select((F.col("_m") + F.col("_before")).alias(name), *df.columns)


def one_line_records(spark: SparkSession, path: str) -> bool:
    """Whether every line of CSV files holds an even number of quotes, so that no record goes over a line's end.

    Such files can be split among tasks at any line; others are read a file a task.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns as strings; an absent column and an empty field give an empty string."""
    df = spark.read.options(**CSV | {"multiLine": not one_line_records(spark, path)}).option("inferSchema", False).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def read_sentences(spark: SparkSession, path: str, text_column: str = "text", least: int = 15, most: int = 1000, limit: int | None = None) -> DataFrame:
    """(sent_idx, text): stripped sentences of least to most characters, of a CSV file or a text with one a line.

    The suffix .csv makes it CSV; a CSV file without the column has no sentences. limit: of 0 or None, all.
    """
    if PurePath(path).suffix == ".csv":
        rows = read_csv(spark, path, [text_column]).select(strip(text_column).alias("text"))
    else:
        rows = spark.read.text(path).select(strip("value").alias("text"))
    kept = numbered(rows.filter(in_length("text", least, most)), "sent_idx")
    return kept.filter(F.col("sent_idx") < limit) if limit else kept


def read_dictionary(spark: SparkSession, path: str | None) -> DataFrame:
    """(entry_idx, ukrainian, hutsul) of the entries with both sides, in order; nothing without a file."""
    if not path or not _exists(spark, path):
        return spark.createDataFrame([], "entry_idx bigint, ukrainian string, hutsul string")
    rows = read_csv(spark, path, ["Ukrainian", "Hutsul"]).select(strip("Ukrainian").alias("ukrainian"), strip("Hutsul").alias("hutsul"))
    return numbered(rows.filter("ukrainian != '' and hutsul != ''"), "entry_idx")


def read_rules(spark: SparkSession, path: str) -> str:
    """The text of a rules file; FileNotFoundError without one."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no rules file at {path}")
    return spark.read.text(path, wholetext=True).first()[0]


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_num, line) of a JSONL file, physical lines counted from 1, blank ones left out."""
    return numbered(spark.read.text(path), "line_num", 1).filter(F.length(strip("value")) > 0).withColumnRenamed("value", "line")


def read_splits(spark: SparkSession, paths: list[str], format: str = "parquet") -> DataFrame:
    """The union of the splits of a dataset, by column name."""
    out = None
    for path in paths:
        part = spark.read.format(format).options(**(CSV if format == "csv" else {})).load(path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(idx, source) to evaluate on: the column `source` of a CSV file (ValueError without it), or the lines of a text."""
    if PurePath(path).suffix == ".csv":
        if "source" not in spark.read.options(**CSV).csv(path).columns:
            raise ValueError("the input has no column 'source'")
        return numbered(read_csv(spark, path, ["source"]), "idx")
    return numbered(read_lines(spark, path).select(F.col("text").alias("source")), "idx")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The stripped lines that aren't blank."""
    return spark.read.text(path).select(strip("value").alias("text")).filter("text != ''")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def json_lines_path(csv_path: str) -> str:
    """Where the records of a CSV file stand."""
    return str(PurePath(csv_path).with_suffix(".jsonl"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", order: str | Column | None = None, files: int | None = None) -> None:
    """A CSV folder with a header a file; with order, the files in name order are in that order."""
    out = df.orderBy(order) if order is not None else df
    if order is not None:
        out = out.select([c for c in df.columns if c != order])
    if files:
        out = out.coalesce(files)
    empty = ""
    if len(out.columns) == 1:  # else a row without text would be a blank line, which readers pass over
        out, empty = out.select(F.coalesce(F.col(f"`{out.columns[0]}`").cast("string"), F.lit("")).alias(out.columns[0])), '""'
    out.write.mode(mode).options(header=True, quote='"', escape='"', emptyValue=empty, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Records as JSON lines in UTF-8, each with all its keys; a null field is null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_lines(df: DataFrame, path: str, column: str, order: str, mode: str = "overwrite") -> None:
    """A text folder, one value a line in the order given; line breaks within a value become spaces."""
    df.orderBy(order).select(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s*\R\s*", " ").alias("value")).write.mode(mode).text(path)


def write_metrics(metrics: dict, path: str, config: dict | None = None) -> None:
    """A metric file on any file system that Spark knows: flat, or as {metrics, config} where a config is given."""
    text = json.dumps({"metrics": metrics, "config": config} if config is not None else metrics, indent=2, ensure_ascii=False)
    spark = SparkSession.getActiveSession()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
