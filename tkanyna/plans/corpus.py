"""The pipelines: corpus generation with resumption, cleaning, training tables and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tkanyna.functions.responses import is_valid, parse_response
from tkanyna.functions.text import chat_messages, chat_text, dialect_name, preview, render_dictionary, system_prompt, token_estimate, user_prompt
from tkanyna.operators import assemble, cleaning, generate, metrics, retrieval
from tkanyna.sources import files

METHOD = "llm_generated"  # fixed value: how generated records are marked


def build_prompts(inputs: DataFrame, dictionary: DataFrame, template: str, top_k: int = 50, threshold: float = 0.05) -> DataFrame:
    """(batch_id, inputs, n, system_prompt, user_prompt, tokens) of batches (batch_id, inputs)."""
    sentences = inputs.select("batch_id", F.explode("inputs.text").alias("text"))
    found = retrieval.batch_dictionaries(retrieval.relevant_entries(sentences, dictionary, top_k=top_k, threshold=threshold))
    made = inputs.join(found, "batch_id", "left").select("batch_id", "inputs", F.size("inputs").alias("n"), system_prompt(template, render_dictionary("entries")).alias("system_prompt"), user_prompt("inputs.text").alias("user_prompt"))
    return made.withColumn("tokens", token_estimate("system_prompt", "user_prompt"))


def align(responses: DataFrame, inputs: DataFrame, extract_json: bool = False) -> DataFrame:
    """(batch_id, sent_idx, standard, dialect, client, status) of every input: ok, rejected, empty or failed."""
    parsed = inputs.join(responses, "batch_id").withColumn("said", parse_response("response", F.size("inputs"), extract_json))
    rows = parsed.select("batch_id", "client", F.col("response").isNull().alias("lost"), F.posexplode(F.arrays_zip("inputs", "said")).alias("pos", "x"))
    out = rows.select("batch_id", F.col("x.inputs.sent_idx").alias("sent_idx"), F.col("x.inputs.text").alias("standard"), F.col("x.said").alias("dialect"), "client", "lost")
    status = F.when(F.col("lost"), "failed").when(F.col("dialect") == "", "empty").when(is_valid("dialect"), "ok").otherwise("rejected")
    return out.withColumn("status", status).drop("lost")


def provenance(rows: DataFrame, rules_file: str, timestamp: str) -> DataFrame:
    """Records of the rows whose status is ok."""
    source = F.struct(F.col("client").alias("model"), F.lit(rules_file).alias("rules_file"), F.lit(timestamp).alias("timestamp"))
    kept = rows.filter("status = 'ok'")
    return kept.select(F.col("standard").alias("source_standard"), F.col("dialect").alias("generated_dialect"), dialect_name(F.lit(rules_file)).alias("dialect"), F.lit(METHOD).alias("method"), source.alias("provenance"))


def batch_progress(rows: DataFrame) -> DataFrame:
    """(batch_id, ok, total): valid pairs of each batch, and of all batches so far."""
    return assemble.running_total(rows.groupBy("batch_id").agg(F.count_if(F.col("status") == "ok").alias("ok")), "batch_id", "ok")


def generate_corpus(
    spark: SparkSession, sentences: DataFrame, rules_file: str, store: str, make: Callable[[], generate.Client], dictionary: DataFrame | None = None,
    batch_size: int = 10, resume: bool = True, save_json: bool = True, top_k: int = 50, threshold: float = 0.05, timestamp: str | None = None, extract_json: bool = False,
) -> DataFrame:
    """Generates what is pending of (sent_idx, text) and appends it to store; gives all attempts, rejected ones included.

    store: a folder. `responses` keeps each reply as it came, written once before it is parsed; `attempts` every input
    with its status; `pairs` and `records` the valid ones as CSV and JSON lines. Resuming looks at attempts by sent_idx,
    so a rejected input shifts nothing; without resume, the store is overwritten. A batch whose call failed is tried
    again on the next run.
    """
    template = files.read_rules(spark, rules_file)
    dictionary = dictionary if dictionary is not None else files.read_dictionary(spark, None)
    mode, attempts = "append", f"{store}/attempts"
    todo = sentences
    if resume and files._exists(spark, attempts):
        todo = assemble.pending(sentences, spark.read.parquet(attempts).filter("status != 'failed'"))
    elif not resume:
        mode = "overwrite"
    stamp = timestamp or datetime.now(UTC).isoformat()
    batched = assemble.batches(todo, batch_size)
    prompts = build_prompts(batched, dictionary, template, top_k, threshold)
    replies = generate.respond(prompts, make).withColumn("run", F.lit(stamp))
    replies.write.mode(mode).parquet(f"{store}/responses")
    kept = spark.read.parquet(f"{store}/responses").filter(F.col("run") == stamp).drop("run")
    aligned = align(kept, batched, extract_json)
    aligned.withColumn("run", F.lit(stamp)).write.mode(mode).parquet(attempts)
    mine = spark.read.parquet(attempts).filter(F.col("run") == stamp)
    ok = mine.filter("status = 'ok'").select("sent_idx", F.col("dialect").alias("source"), F.col("standard").alias("target"))
    files.write_csv(ok, f"{store}/pairs", mode, order="sent_idx")
    if save_json:
        files.write_json_lines(provenance(mine, rules_file, stamp), f"{store}/records", mode)
    return spark.read.parquet(attempts)


def convert(spark: SparkSession, path: str, out: str, source_field: str = "source_standard", target_field: str = "generated_dialect") -> tuple[DataFrame, DataFrame]:
    """Cleans a JSONL file into a CSV folder in input order; gives summary and histogram."""
    judged = cleaning.judged(cleaning.parse_records(files.read_json_lines(spark, path), source_field, target_field)).persist()
    try:
        files.write_csv(cleaning.clean_pairs(judged), out, order="line_num")
        summary, reasons = cleaning.summary(judged).collect(), cleaning.histogram(judged).collect()
    finally:
        judged.unpersist()
    return (
        spark.createDataFrame(summary, "total bigint, valid bigint, filtered bigint, valid_percent string, filtered_percent string"),
        spark.createDataFrame(reasons, "reason string, n bigint, first_line bigint").orderBy(F.desc("n"), "first_line"),
    )


def rejected(spark: SparkSession, path: str, source_field: str = "source_standard", target_field: str = "generated_dialect") -> DataFrame:
    """(line_num, reason, translation) of the rejected records of a JSONL file, the translation as a preview."""
    judged = cleaning.judged(cleaning.parse_records(files.read_json_lines(spark, path), source_field, target_field))
    return judged.filter("reason is not null").select("line_num", "reason", preview("translation").alias("translation")).orderBy("line_num")


def stats(spark: SparkSession, path: str, source_field: str = "source_standard", target_field: str = "generated_dialect") -> tuple[DataFrame, DataFrame]:
    """Summary and histogram of a JSONL file."""
    judged = cleaning.judged(cleaning.parse_records(files.read_json_lines(spark, path), source_field, target_field))
    return cleaning.summary(judged), cleaning.histogram(judged).orderBy(F.desc("n"), "first_line")


def chat_table(pairs: DataFrame, with_system: bool = True, opening: str = "<|{role}|>\n", closing: str = "\n") -> DataFrame:
    """(messages, text) of (source, target) pairs; nothing else of the input is kept."""
    messages = chat_messages("source", "target", with_system)
    return pairs.select(messages.alias("messages")).withColumn("text", chat_text("messages", opening, closing))


def evaluate(inputs: DataFrame, references: DataFrame, make: Callable, size: int = 8) -> tuple[DataFrame, dict[str, float]]:
    """Predictions for (idx, source), and their scores against (idx, reference)."""
    said = generate.predict(inputs, make, size).persist()
    try:
        return said, metrics.compute_metrics(metrics.paired(said, references))
    finally:
        said.unpersist()


def evaluation(inputs: DataFrame, references: DataFrame, make: Callable, out: str, size: int = 8, config: dict | None = None) -> dict[str, float]:
    """Predictions for (idx, source), written beside their references as text, and their scores as JSON; gives the scores.

    Predictions are written once, and all else is read from there.
    """
    generate.predict(inputs, make, size).write.mode("overwrite").parquet(f"{out}/attempts")
    said = inputs.sparkSession.read.parquet(f"{out}/attempts")
    both = metrics.paired(said, references)
    files.write_lines(both, f"{out}/predictions.txt", "prediction", "idx")
    files.write_lines(both, f"{out}/references.txt", "reference", "idx")
    scores = metrics.compute_metrics(both)
    files.write_metrics(scores, f"{out}/metrics.json", config)
    return scores
