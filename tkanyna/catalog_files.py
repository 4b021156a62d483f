"""Queries that write tables of the test folder as files and read them again by the sources, and the SQL of what comes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tkanyna.functions import text
from tkanyna.operators import cleaning
from tkanyna.session import scratch
from tkanyna.sources import files


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_sentences(spark, folder):
    """Sentences of a CSV file."""
    path = scratch(spark, "sentences.csv")
    files.write_csv(_read(spark, folder, "standard_ukrainian").select("sent_id", "text"), path, order="sent_id")
    return files.read_sentences(spark, path)


def text_sentences(spark, folder):
    """Sentences of a text file."""
    path = scratch(spark, "sentences.txt")
    files.write_lines(_read(spark, folder, "standard_ukrainian"), path, "text", "sent_id")
    return files.read_sentences(spark, path)


def csv_dictionary(spark, folder):
    path = scratch(spark, "dictionary.csv")
    files.write_csv(_read(spark, folder, "dictionary"), path, order="entry_id")
    return files.read_dictionary(spark, path)


def json_records(spark, folder):
    """The two texts of records that were written as JSON lines."""
    path = scratch(spark, "records.jsonl")
    files.write_json_lines(_read(spark, folder, "jsonl_corpus").select("source_standard", "generated_dialect", "dialect", "method", "provenance"), path)
    return cleaning.parse_records(files.read_json_lines(spark, path)).select("parsed", "source", "translation")


def json_keys(spark, folder):
    """How many JSON lines have which keys."""
    path = scratch(spark, "records.jsonl")
    files.write_json_lines(_read(spark, folder, "jsonl_corpus").select("source_standard", "generated_dialect", "dialect", "method", "provenance"), path)
    lines = files.read_json_lines(spark, path)
    return lines.groupBy(F.array_join(F.json_object_keys("line"), " ").alias("keys")).agg(F.count(F.lit(1)).alias("n"))


def csv_inputs(spark, folder):
    """Inputs of an evaluation, of a CSV file."""
    path = scratch(spark, "inputs.csv")
    files.write_csv(_read(spark, folder, "parallel_pairs").select("pair_id", "source", "target"), path, order="pair_id")
    return files.read_inputs(spark, path)


def csv_pairs(spark, folder):
    """Pairs of a CSV file of references."""
    path = scratch(spark, "pairs.csv")
    files.write_csv(_read(spark, folder, "parallel_pairs").select("source", "target"), path)
    return files.read_csv(spark, path, ["target", "source", "absent"])


def text_lines(spark, folder):
    """Predictions of a text file, one a line."""
    path = scratch(spark, "predictions.txt")
    files.write_lines(_read(spark, folder, "parallel_pairs"), path, "source", "pair_id")
    return files.read_lines(spark, path)


def splits(spark, folder):
    """The union of a dataset's splits."""
    pairs, paths = _read(spark, folder, "parallel_pairs").select("pair_id", "source", "target", F.coalesce("split", F.lit("none")).alias("split")), []
    for name in ("train", "validation", "test", "none"):
        paths.append(scratch(spark, name))
        pairs.filter(F.col("split") == name).write.parquet(paths[-1])
    return files.read_splits(spark, paths)


def json_cleaning(spark, folder):
    """The summary of delivered JSON lines, cleaned."""
    lines = _read(spark, folder, "raw_lines").filter("file_name like '%.jsonl'").filter(text.not_blank("line")).select(F.col("line_id").alias("line_num"), "line")
    return cleaning.summary(cleaning.judged(cleaning.parse_records(lines)))


QUERIES = [csv_sentences, text_sentences, csv_dictionary, json_records, json_keys, csv_inputs, csv_pairs, text_lines, splits, json_cleaning]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql(us: Callable[[str], str], reason: Callable[[str, str], str]) -> dict[str, str]:
    """us: the SQL that strips a text; reason: that of the first reason for rejection."""
    one_line = r"regexp_replace({0}, '[ \t\n\x0B\f\r]*(?:\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}])[ \t\n\x0B\f\r]*', ' ', 'g')"
    numbered = "SELECT row_number() OVER (ORDER BY sent_id) - 1 AS sent_idx, text FROM ({}) WHERE length(text) BETWEEN 15 AND 1000"
    # strict JSON: neither a comma before a closing bracket nor the names of numbers that aren't
    bare = r"""regexp_replace(line, '"(?:\\.|[^"\\])*"', '""', 'g')"""
    parsed = rf"""(json_valid(line) AND coalesce(json_type(CASE WHEN json_valid(line) THEN line END), '') = 'OBJECT' AND NOT regexp_matches({bare}, ',\s*[}}\]]|NaN|Inf|nan|inf'))"""
    member = "coalesce(CASE WHEN json_type(j, '$.{0}') = 'NULL' THEN NULL ELSE json_extract_string(j, '$.{0}') END, '')"
    records = f"""lines AS (SELECT line_id, line, {parsed} AS parsed FROM raw_lines WHERE ends_with(file_name, '.jsonl') AND length({us('line')}) > 0),
        r AS (SELECT line_id, parsed, {us(member.format('source_standard'))} AS s, {us(member.format('generated_dialect'))} AS t FROM (SELECT *, CASE WHEN parsed THEN line END AS j FROM lines)),
        judged AS (SELECT line_id, CASE WHEN NOT parsed THEN 'json_parse_error' ELSE {reason('s', 't')} END AS reason FROM r)"""
    return {
        "csv_sentences": numbered.format(f"SELECT sent_id, {us('text')} AS text FROM standard_ukrainian"),
        "text_sentences": numbered.format(f"SELECT sent_id, {us(one_line.format('text'))} AS text FROM standard_ukrainian"),
        "csv_dictionary": f"SELECT row_number() OVER (ORDER BY entry_id) - 1 AS entry_idx, {us('Ukrainian')} AS ukrainian, {us('Hutsul')} AS hutsul FROM dictionary WHERE {us('Ukrainian')} != '' AND {us('Hutsul')} != ''",
        "json_records": f"""SELECT true AS parsed, {us("coalesce(source_standard, '')")} AS source, {us("coalesce(generated_dialect, '')")} AS translation FROM jsonl_corpus""",
        "json_keys": "SELECT 'source_standard generated_dialect dialect method provenance' AS keys, count(*) AS n FROM jsonl_corpus",
        "csv_inputs": "SELECT row_number() OVER (ORDER BY pair_id) - 1 AS idx, coalesce(source, '') AS source FROM parallel_pairs",
        "csv_pairs": "SELECT coalesce(target, '') AS target, coalesce(source, '') AS source, '' AS absent FROM parallel_pairs",
        "text_lines": f"SELECT * FROM (SELECT {us(one_line.format('source'))} AS text FROM parallel_pairs) WHERE text != ''",
        "splits": "SELECT pair_id, source, target, coalesce(split, 'none') AS split FROM parallel_pairs",
        "json_cleaning": f"WITH {records} SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS valid, count(reason) AS filtered, printf('%.1f', 100.0 * count(*) FILTER (reason IS NULL) / count(*)) AS valid_percent, printf('%.1f', 100.0 * count(reason) / count(*)) AS filtered_percent FROM judged",
        "json_lines_stats": f"WITH {records} SELECT reason, count(*) AS n, min(line_id) AS first_line FROM judged WHERE reason IS NOT NULL GROUP BY 1",
    }


def rejects_sql() -> dict[str, str]:
    """SQL of the lines that fail to parse, by the grammar of a record and the properties of its values."""
    bare = r"""regexp_replace(line, '"(?:\\.|[^"\\])*"', '""', 'g')"""
    parsed = rf"""(json_valid(line) AND coalesce(json_type(CASE WHEN json_valid(line) THEN line END), '') = 'OBJECT' AND NOT regexp_matches({bare}, ',\s*[}}\]]|NaN|Inf|nan|inf'))"""
    keys = "list_sort(json_keys(line)) = ['dialect', 'generated_dialect', 'method', 'provenance', 'source_standard']"
    texts = " AND ".join(f"json_type(line, '$.{k}') = 'VARCHAR'" for k in ("source_standard", "generated_dialect", "dialect", "method"))
    field = r"""(?:"[^"]*(?:""[^"]*)*"|[^",\r\n]*)"""
    time = r"T(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?"
    day = "split_part({0}, 'T', 1)"
    real = rf"""coalesce(regexp_full_match({{0}}, '(?:\d{{{{4}}}}-\d\d-\d\d|\d{{{{8}}}}|\d{{{{4}}}}-\d{{{{3}}}}|\d{{{{4}}}}-?W\d\d-?[1-7]){time}') AND coalesce(try_strptime({day}, '%Y-%m-%d'), try_strptime({day}, '%Y%m%d'), try_strptime({day}, '%G-W%V-%u'), try_strptime({day}, '%Y-%j')) IS NOT NULL, false)"""
    stamp = "CASE WHEN json_type(line, '$.provenance.timestamp') = 'VARCHAR' THEN json_extract_string(line, '$.provenance.timestamp') END"
    commas = """regexp_replace(line, '"[^"]*"', '', 'g')"""
    last = rf"""replace(trim(regexp_extract(line, '(?:^|,)({field})$', 1), '"'), '""', '"')"""
    given = r"SELECT line_id, file_name, lower(coalesce(file_name, '')) LIKE '%.csv' AS csv, CASE WHEN lower(coalesce(file_name, '')) LIKE '%.csv' THEN regexp_replace(regexp_replace(line, '\n$', ''), '\r$', '') ELSE line END AS line FROM raw_lines WHERE regexp_matches(line, '\S') AND NOT (lower(coalesce(file_name, '')) LIKE '%.csv' AND coalesce(line_no, 0) = 1)"
    outcome = f"""CASE WHEN csv THEN CASE WHEN NOT regexp_full_match(line, '{field}(?:,{field})*') THEN 'broken_quoting' WHEN length({commas}) - length(replace({commas}, ',', '')) != 6 THEN 'column_count' WHEN NOT {real.format(last)} THEN 'invalid_value' END
        WHEN NOT {parsed} THEN 'broken_quoting' WHEN NOT {keys} THEN 'column_count' WHEN NOT ({texts} AND json_type(line, '$.provenance') = 'OBJECT' AND {real.format(stamp)}) THEN 'invalid_value' END"""
    lines = f"o AS (SELECT line_id, file_name, {outcome} AS reason FROM ({given}))"
    return {
        "p6_found": f"WITH {lines} SELECT line_id, reason FROM o WHERE reason IS NOT NULL",
        "p6_report": f"WITH {lines} SELECT file_name, coalesce(reason, 'loaded') AS outcome, count(*) AS lines FROM o GROUP BY ALL",
    }
