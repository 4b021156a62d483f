"""Cleaning a file of records: parse, reject by first reason, clean, and report."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tkanyna.functions.responses import PARSE_ERROR, reject_reason
from tkanyna.functions.text import clean, percent, strip


def parse_records(lines: DataFrame, source_field: str = "source_standard", target_field: str = "generated_dialect") -> DataFrame:
    """(line_num, parsed, source, translation) of JSON lines, the two fields stripped; strict about the JSON standard.

    A field that is missing or null gives an empty text, any other value its JSON text. parsed is false for a line that
    is no JSON object; such a line has null fields.
    """

    def constant(name: str) -> None:
        raise ValueError(name)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def text(value: object) -> str:
            return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

        for batch in batches:
            out = []
            for number, line in zip(batch["line_num"].tolist(), batch["line"].tolist()):
                try:
                    value = json.loads(line, parse_constant=constant)
                except (ValueError, RecursionError):
                    value = None
                if isinstance(value, dict):
                    out.append((number, True, text(value.get(source_field)), text(value.get(target_field))))
                else:
                    out.append((number, False, None, None))
            yield pd.DataFrame(out, columns=["line_num", "parsed", "source", "translation"])

    rows = lines.select("line_num", "line").filter("line is not null").mapInPandas(parse, "line_num bigint, parsed boolean, source string, translation string")
    return rows.select("line_num", "parsed", strip("source").alias("source"), strip("translation").alias("translation"))


def judged(records: DataFrame) -> DataFrame:
    """With the reason for rejection, null for a valid record."""
    return records.withColumn("reason", F.when(~F.col("parsed"), PARSE_ERROR).otherwise(reject_reason("source", "translation")))


def clean_pairs(judged_records: DataFrame) -> DataFrame:
    """(line_num, source, target) of the valid records: the cleaned translation, and what it renders."""
    return judged_records.filter("reason is null").select("line_num", clean("translation").alias("source"), F.col("source").alias("target"))


def histogram(judged_records: DataFrame) -> DataFrame:
    """(reason, n, first_line): how many records each reason rejects; order by n descending, then first_line."""
    # a filter on the reason itself would be pushed below its making, and work it out twice
    return judged_records.groupBy("reason").agg(F.count("reason").alias("n"), F.min("line_num").alias("first_line")).filter("n > 0")


def summary(judged_records: DataFrame) -> DataFrame:
    """One row: total, valid, filtered, and the valid share in percent; 0.0 of no records."""
    counts = judged_records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("filtered"))
    return counts.withColumn("valid_percent", percent("valid", "total")).withColumn("filtered_percent", percent("filtered", "total"))
