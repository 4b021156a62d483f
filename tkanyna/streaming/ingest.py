"""Incremental ingest: new files of sentences or records, cleaned and appended batch by batch, exactly once a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tkanyna.functions.responses import reject_reason
from tkanyna.functions.text import clean, in_length, strip
from tkanyna.sources.files import RECORD


def sentence_stream(spark: SparkSession, folder: str, least: int = 15, most: int = 1000, files_a_batch: int = 100) -> DataFrame:
    """(text) of the lines of new text files that have least to most characters."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    return lines.select(strip("value").alias("text")).filter(in_length("text", least, most))


def record_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """(source, target, reason, model) of the records of new JSONL files; reason is null for a valid one."""
    rows = spark.readStream.schema(f"{RECORD}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", files_a_batch).json(folder)
    s, t = strip(F.coalesce("source_standard", F.lit(""))), strip(F.coalesce("generated_dialect", F.lit("")))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "json_parse_error").otherwise(reject_reason(s, t))
    return rows.select(clean(t).alias("source"), s.alias("target"), reason.alias("reason"), F.col("provenance.model").alias("model"))


def append_valid(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends valid pairs to `pairs`, and counts of each outcome to `outcomes`, under out; each batch once.

    A batch that is run again after a crash overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("reason is null").select("source", "target").write.mode("overwrite").parquet(f"{out}/pairs/batch={number}")
        batch.groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).count().write.mode("overwrite").parquet(f"{out}/outcomes/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "30 days") -> DataFrame:
    """(window_start, key, n) of a stream with late rows, by tumbling windows closed after `late`."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
