"""The core queries over the test tables, each over whole tables, and the SQL that must give the same rows.

Sentences are `standard_ukrainian`, the dictionary is `dictionary`, pairs are `parallel_pairs`, records `jsonl_corpus`
and delivered lines `raw_lines`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tkanyna import catalog_files
from tkanyna.functions import responses, text, tokens
from tkanyna.operators import assemble, cleaning, generate, metrics, rejects, retrieval
from tkanyna.plans import corpus
from tkanyna.session import scratch
from tkanyna.sources import files
from tkanyna.streaming import ingest

TEMPLATE = "Перекладай говіркою.\n\n{dictionary}\n"
RULES = "prompts/hutsul_rules_system.txt"
STAMP = "2025-01-01T00:00:00+00:00"

# How the SQL writes white space, stripping and cleaning; DuckDB's classes are ASCII, so they are spelled out.
WS = r"\t\n\x0B\f\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def us(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_clean(c: str) -> str:
    bare = f"CASE WHEN starts_with({c}, '\"') AND (ends_with({c}, '\",') OR ends_with({c}, '\"')) THEN rtrim(trim({c}, '\"'), ',') ELSE {c} END"
    return us(f"regexp_replace({bare}, '^\\p{{Nd}}+[.):][{WS}]*', '')")


def sql_artifact(c: str) -> str:
    found = [rf"^[{WS}]*\{{[{WS}]*\"translations\"", rf"^[{WS}]*\[", rf"^[{WS}]*\"[^\"]*\",?[{WS}]*$", rf"translations[{WS}]*:"]
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in found).replace('\\"', '"') + ")"


def sql_reason(s: str, t: str) -> str:
    return rf"""CASE WHEN {s} = '' OR {t} = '' THEN 'empty source or translation' WHEN {sql_artifact(t)} THEN 'JSON artifact in translation'
    WHEN {s} = {t} THEN 'translation identical to source' WHEN length({t}) < 2 THEN 'translation too short'
    WHEN starts_with({t}, '"') AND ends_with({t}, '",') THEN 'translation looks like JSON string element'
    WHEN regexp_matches({t}, '<SEP>.*<SEP>') THEN 'error pattern: <SEP>.*<SEP>' WHEN regexp_matches({t}, '^\p{{Nd}}+\.[{WS}]+') THEN 'error pattern: ^\d+\.\s+'
    WHEN starts_with({t}, 'Переклад:') THEN 'error pattern: ^Переклад:' WHEN starts_with({t}, 'Відповідь:') THEN 'error pattern: ^Відповідь:' END"""


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "standard_ukrainian").select("sent_id", text.strip("text").alias("text"))
    return rows.filter(text.in_length("text"))


SENTENCES = f"sentences AS (SELECT * FROM (SELECT sent_id, {us('text')} AS text FROM standard_ukrainian) WHERE length(text) BETWEEN 15 AND 1000)"


def _indexed(spark: SparkSession, folder: str) -> DataFrame:
    return files.numbered(_sentences(spark, folder).orderBy("sent_id"), "sent_idx")


INDEXED = f"{SENTENCES}, indexed AS (SELECT *, row_number() OVER (ORDER BY sent_id) - 1 AS sent_idx FROM sentences), batched AS (SELECT *, sent_idx // 10 AS batch_id FROM indexed)"


def _dictionary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "dictionary").select(F.col("entry_id").alias("entry_idx"), text.strip(F.coalesce("Ukrainian", F.lit(""))).alias("ukrainian"), text.strip(F.coalesce("Hutsul", F.lit(""))).alias("hutsul"))
    return rows.filter("ukrainian != '' and hutsul != ''")


DICTIONARY = f"entries AS (SELECT entry_id AS entry_idx, {us('Ukrainian')} AS ukrainian, {us('Hutsul')} AS hutsul FROM dictionary WHERE {us('Ukrainian')} != '' AND {us('Hutsul')} != '')"


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "jsonl_corpus").select(
        F.col("record_id").alias("line_num"), F.lit(True).alias("parsed"), text.strip(F.coalesce("source_standard", F.lit(""))).alias("source"), text.strip(F.coalesce("generated_dialect", F.lit(""))).alias("translation")
    )
    return cleaning.judged(rows)


JUDGED = f"""records AS (SELECT record_id AS line_num, {us("coalesce(source_standard, '')")} AS source, {us("coalesce(generated_dialect, '')")} AS translation FROM jsonl_corpus),
judged AS (SELECT *, {sql_reason("source", "translation")} AS reason FROM records)"""


def sentence_ingest(spark, folder):
    return _sentences(spark, folder)


def sentence_limit(spark, folder):
    return _sentences(spark, folder).orderBy("sent_id").limit(1000)


def corpus_dedup(spark, folder):
    return assemble.assemble([_read(spark, folder, "standard_ukrainian"), _read(spark, folder, "parallel_pairs").select(F.col("target").alias("text"))])


def merge_corpora(spark, folder):
    records = _read(spark, folder, "jsonl_corpus").select(F.col("generated_dialect").alias("source"), F.col("source_standard").alias("target"))
    return assemble.merge_pairs(_read(spark, folder, "parallel_pairs"), records)


def swap_roles(spark, folder):
    return assemble.swapped(_read(spark, folder, "parallel_pairs"), "target", "source")


def tokenize_counts(spark, folder):
    return retrieval.term_counts(_sentences(spark, folder), "sent_id", "text")


def tf_normalized(spark, folder):
    return retrieval.term_frequencies(_sentences(spark, folder), "sent_id", "text").withColumn("tf", F.round("tf", 9))


def dict_match_topk(spark, folder):
    found = retrieval.relevant_entries(_sentences(spark, folder), _dictionary(spark, folder), "sent_id", top_k=5)
    return found.withColumn("sim", F.round("sim", 9))


def _batched(spark, folder):
    return _indexed(spark, folder).withColumn("batch_id", F.floor(F.col("sent_idx") / 10).cast("bigint"))


def dict_match_batch(spark, folder):
    return retrieval.relevant_entries(_batched(spark, folder), _dictionary(spark, folder)).withColumn("sim", F.round("sim", 9))


def batch_assign(spark, folder):
    return _batched(spark, folder).select("sent_id", "sent_idx", "batch_id")


def _prompts(spark, folder):
    return corpus.build_prompts(assemble.batches(_indexed(spark, folder), 10), _dictionary(spark, folder), TEMPLATE)


def prompts(spark, folder):
    return _prompts(spark, folder).select("batch_id", F.col("n").cast("bigint").alias("n"), "system_prompt", "user_prompt", "tokens")


def clean_text(spark, folder):
    return _read(spark, folder, "jsonl_corpus").select("record_id", text.clean("generated_dialect").alias("cleaned")).distinct()


def validity_generator(spark, folder):
    return _read(spark, folder, "jsonl_corpus").select("record_id", responses.is_valid(text.clean("generated_dialect")).alias("valid")).distinct()


def reject_reason(spark, folder):
    return _judged(spark, folder).select("line_num", "reason").distinct()


def reject_histogram(spark, folder):
    return cleaning.histogram(_judged(spark, folder))


def corpus_stats(spark, folder):
    return cleaning.summary(_judged(spark, folder))


def clean_pairs(spark, folder):
    return cleaning.clean_pairs(_judged(spark, folder))


def json_lines_stats(spark, folder):
    lines = _read(spark, folder, "raw_lines").filter("file_name like '%.jsonl'").filter(text.not_blank("line")).select(F.col("line_id").alias("line_num"), "line")
    return cleaning.histogram(cleaning.judged(cleaning.parse_records(lines)))


def _replies(spark, folder):
    rows = _read(spark, folder, "jsonl_corpus").select("record_id", F.coalesce("generated_dialect", F.lit("")).alias("t")).distinct()
    return rows.withColumn("batch_id", F.floor(F.col("record_id") / 3).cast("bigint")).groupBy("batch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("record_id", "t"))), lambda x: x["t"]).alias("said"))


REPLIES = "replies AS (SELECT record_id // 3 AS batch_id, list(t ORDER BY record_id) AS said FROM (SELECT DISTINCT record_id, coalesce(generated_dialect, '') AS t FROM jsonl_corpus) GROUP BY 1)"


def _exploded(df, parsed):
    return df.select("batch_id", F.posexplode(parsed).alias("pos", "translation")).withColumn("pos", F.col("pos").cast("bigint"))


def parse_json_response(spark, folder):
    replies = _replies(spark, folder).withColumn("response", F.to_json(F.struct(F.col("said").alias("translations"))))
    return _exploded(replies, responses.parse_response("response", 3))


def parse_text_response(spark, folder):
    lines = F.transform("said", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    return _exploded(_replies(spark, folder).withColumn("response", F.array_join(lines, "\n")), responses.parse_response("response", 3))


def provenance_records(spark, folder):
    rows = _read(spark, folder, "jsonl_corpus").select(F.col("source_standard").alias("standard"), F.col("generated_dialect").alias("dialect"), F.col("provenance.model").alias("client"), F.when(responses.is_valid("generated_dialect"), "ok").otherwise("rejected").alias("status"))
    made = corpus.provenance(rows, RULES, STAMP)
    return made.select("source_standard", "generated_dialect", "dialect", "method", "provenance.model", "provenance.rules_file", "provenance.timestamp")


def resume_pending(spark, folder):
    return assemble.pending(_sentences(spark, folder), _read(spark, folder, "jsonl_corpus"), "sent_id")


def train_val_split(spark, folder):
    return assemble.train_test_split(_read(spark, folder, "parallel_pairs").select("pair_id"), "pair_id")


def chat_format(spark, folder):
    pairs = _read(spark, folder, "parallel_pairs")
    return corpus.chat_table(pairs.filter("source is not null and target is not null")).select("text")


def chat_prompt(spark, folder):
    return _read(spark, folder, "parallel_pairs").select("pair_id", text.chat_user("source", False).alias("prompt"), text.instruct_text(F.lit(text.SYSTEM), text.chat_user("source", False)).alias("instruct"))


def dialect_names(spark, folder):
    return _read(spark, folder, "jsonl_corpus").select("record_id", text.dialect_name("provenance.rules_file").alias("name")).distinct()


def _pairs(spark, folder):
    return _read(spark, folder, "parallel_pairs").select(F.col("source").alias("prediction"), F.col("target").alias("reference"))


def paired_predictions(spark, folder):
    pairs = _read(spark, folder, "parallel_pairs").filter("source is not null and target is not null")
    return metrics.paired(pairs.select(F.col("pair_id").alias("idx"), F.col("source").alias("prediction")), pairs.select(F.col("pair_id").alias("idx"), F.col("target").alias("reference")))


def bleu_ngram_stats(spark, folder):
    """Clipped matches and totals over blank-split tokens."""
    plain = _pairs(spark, folder).select(*[F.array_join(metrics.blank_tokens(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{N}']+", " ")), " ").alias(c) for c in ("prediction", "reference")])
    return metrics.corpus_counts(plain, "BLEU").select([F.col(f"c{i}").cast("bigint").alias(f"c{i}") for i in range(10)])


def bleu_corpus(spark, folder):
    return metrics.metric_row(spark, metrics.compute_metrics(_pairs(spark, folder), kinds=("BLEU",)))


def chrf_stats(spark, folder):
    counts = metrics.corpus_counts(_pairs(spark, folder), "chrF++")
    return counts.select([F.col(f"c{i}").cast("bigint").alias(f"c{i}") for i in range(18)])


def chrf_corpus(spark, folder):
    return metrics.metric_row(spark, metrics.compute_metrics(_pairs(spark, folder), kinds=("chrF++",)))


def ter_corpus(spark, folder):
    return metrics.metric_row(spark, metrics.compute_metrics(_pairs(spark, folder), kinds=("TER",)))


def generate_stub(spark, folder):
    batched = assemble.batches(_indexed(spark, folder), 10)
    made = corpus.build_prompts(batched, _dictionary(spark, folder), TEMPLATE)
    return corpus.align(generate.respond(made, partial(generate.create_client, "stub", "words")), batched)


def generation_progress(spark, folder):
    return corpus.batch_progress(generate_stub(spark, folder))


def running_valid(spark, folder):
    valid = _judged(spark, folder).groupBy(F.floor(F.col("line_num") / 10).cast("bigint").alias("batch_id")).agg(F.count_if(F.col("reason").isNull()).alias("ok"))
    return assemble.running_total(valid, "batch_id", "ok")


def tokenized_pairs(spark, folder):
    return tokens.training_columns(_read(spark, folder, "parallel_pairs").filter("source is not null and target is not null"))


def _ids(spark, folder):
    return _read(spark, folder, "parallel_pairs").select("pair_id", F.floor(F.col("pair_id") / 8).cast("bigint").alias("batch_id"), F.transform(F.split(F.coalesce("target", F.lit("")), ""), lambda x: F.ascii(x)).alias("ids"))


def token_id_mask(spark, folder):
    masked = responses.mask_ids("ids", 1080)
    return _ids(spark, folder).select("pair_id", F.array_join(F.transform(masked, lambda x: x.cast("string")), " ").alias("ids"))


def pad_to_multiple(spark, folder):
    return assemble.padded(_ids(spark, folder), "ids", "batch_id").select("pair_id", F.size("ids").cast("bigint").alias("width"))


def training_steps(spark, folder):
    """For each origin, by the library's step arithmetic."""
    rows = _read(spark, folder, "parallel_pairs").groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
    made = [(r.origin, r.n, *assemble.training_steps(r.n, 4, 4, 10)) for r in rows.collect()]  # a row for each of a few origins
    return spark.createDataFrame(made, "origin string, n bigint, steps bigint, warmup bigint")


def stream_counts(spark, folder):
    """Records by model and month, counted by a stream over the table's files."""
    given = _read(spark, folder, "jsonl_corpus")
    stream = spark.readStream.schema(given.schema).parquet(f"{folder}/jsonl_corpus.parque[t]")  # a pattern, as the table may be a file or a folder
    events = stream.filter("ingested_at is not null").select(F.col("ingested_at").cast("timestamp").alias("at"), F.col("provenance.model").alias("model"))
    counts = ingest.windowed_counts(events, "at", "model", "7 days", "400 days")
    path = scratch(spark, "counts")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    query = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(path).select(F.date_format("window_start", "yyyy-MM-dd").alias("week"), "model", "n")


def p6_found(spark, folder):
    return rejects.rejects(_read(spark, folder, "raw_lines"))


def p6_records(spark, folder):
    return rejects.records(_read(spark, folder, "raw_lines"))


def p6_report(spark, folder):
    return rejects.reject_report(_read(spark, folder, "raw_lines"))


QUERIES = [
    sentence_ingest, sentence_limit, corpus_dedup, merge_corpora, swap_roles, tokenize_counts, tf_normalized, dict_match_topk, dict_match_batch, batch_assign, prompts, clean_text, validity_generator,
    reject_reason, reject_histogram, corpus_stats, clean_pairs, json_lines_stats, parse_json_response, parse_text_response, provenance_records, resume_pending, train_val_split, chat_format, chat_prompt,
    dialect_names, paired_predictions, bleu_ngram_stats, bleu_corpus, chrf_stats, chrf_corpus, ter_corpus, generate_stub, generation_progress, running_valid, tokenized_pairs, token_id_mask, pad_to_multiple, training_steps,
    stream_counts, p6_found, p6_records, p6_report,
]

TOKENS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token"
SIMILAR = """ours AS (SELECT {key}, token, count(*) AS n FROM (SELECT {key}, {tokens} FROM {table}) GROUP BY ALL),
theirs AS (SELECT entry_idx, token, count(*) AS m FROM (SELECT entry_idx, unnest(regexp_extract_all(lower(ukrainian), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM entries) GROUP BY ALL),
our_norms AS (SELECT {key}, sum(n * n) AS a FROM ours GROUP BY 1), their_norms AS (SELECT entry_idx, sum(m * m) AS b FROM theirs GROUP BY 1),
scored AS (SELECT {key}, entry_idx, sum(n * m)::BIGINT / sqrt((any_value(a) * any_value(b))::DOUBLE) AS sim FROM ours JOIN theirs USING (token) JOIN our_norms USING ({key}) JOIN their_norms USING (entry_idx) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sim DESC, entry_idx) AS rank FROM scored WHERE sim >= 0.05)"""


def _similar(key: str, table: str) -> str:
    return SIMILAR.format(key=key, table=table, tokens=TOKENS)


def _grams(side: str, n: int) -> str:
    return f"SELECT pair_id, array_to_string(list_slice({side}, i, i + {n - 1}), ' ') AS g FROM toks, unnest(range(1, len({side}) - {n - 2})) AS t(i)"


BLANK = "list_filter(string_split(regexp_replace(coalesce({}, ''), '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g'), ' '), lambda x: x != '')"


def _bleu_sql(source: str, target: str) -> str:
    parts = [f"WITH toks AS (SELECT pair_id, {source} AS a, {target} AS b FROM parallel_pairs)"]
    columns = []
    for n in range(1, 5):
        match = f"SELECT coalesce(sum(least(x.n, y.n)), 0) FROM (SELECT pair_id, g, count(*) AS n FROM ({_grams('a', n)}) GROUP BY ALL) x JOIN (SELECT pair_id, g, count(*) AS n FROM ({_grams('b', n)}) GROUP BY ALL) y USING (pair_id, g)"
        columns += [f"({match})::BIGINT AS c{2 * n - 2}", f"(SELECT sum(greatest(len(a) - {n - 1}, 0)) FROM toks)::BIGINT AS c{2 * n - 1}"]
    columns += ["(SELECT sum(len(a)) FROM toks)::BIGINT AS c8", "(SELECT sum(len(b)) FROM toks)::BIGINT AS c9"]
    return f"{parts[0]} SELECT {', '.join(columns)}"


def _chrf_sql() -> str:
    source, target = (f"regexp_replace(coalesce({c}, ''), '[{WS}]+', '', 'g')" for c in ("source", "target"))
    columns = []
    for n in range(1, 7):
        grams = [f"SELECT pair_id, substr({s}, i, {n}) AS g FROM toks, unnest(range(1, length({s}) - {n - 2})) AS t(i)" for s in ("a", "b")]
        match = f"SELECT coalesce(sum(least(x.n, y.n)), 0) FROM (SELECT pair_id, g, count(*) AS n FROM ({grams[0]}) GROUP BY ALL) x JOIN (SELECT pair_id, g, count(*) AS n FROM ({grams[1]}) GROUP BY ALL) y USING (pair_id, g)"
        columns += [f"(SELECT sum(greatest(length({s}) - {n - 1}, 0)) FROM toks)::BIGINT AS c{3 * n - 3 + k}" for k, s in enumerate("ab")] + [f"({match})::BIGINT AS c{3 * n - 1}"]
    return f"WITH toks AS (SELECT pair_id, {source} AS a, {target} AS b FROM parallel_pairs) SELECT {', '.join(columns)}"


def _bleu_score_sql() -> str:
    def tokens(c: str) -> str:
        t = f"coalesce({c}, '')"
        for mark, char in (("<skipped>", ""), ("-' || chr(10) || '", ""), ("' || chr(10) || '", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            t = f"replace({t}, '{mark}', '{char}')"
        t = rf"regexp_replace(' ' || {t} || ' ', '([{{-~\[-` -&(-+:-@/])', ' \1 ', 'g')"
        t = rf"regexp_replace(regexp_replace({t}, '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g')"
        return rf"regexp_extract_all(regexp_replace({t}, '([0-9])(-)', '\1 \2 ', 'g'), '[^{WS}]+')"

    counts = _bleu_sql(tokens("source"), tokens("target"))
    logs = " + ".join(f"ln(100.0 * c{2 * n} / c{2 * n + 1})" for n in range(4))
    return f"SELECT round(CASE WHEN c8 < c9 THEN exp(1 - c9 / c8) ELSE 1.0 END * exp(({logs}) / 4), 2) AS \"BLEU\" FROM ({counts})"


def _chrf_score_sql() -> str:
    word = "CASE WHEN length(w) > 1 AND contains({0}, right(w, 1)) THEN [left(w, -1), right(w, 1)] WHEN length(w) > 1 AND contains({0}, left(w, 1)) THEN [left(w, 1), substr(w, 2)] ELSE [w] END".format("""'!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'""".replace("\\\\", "\\"))
    lists = [f"flatten(list_transform(regexp_extract_all(coalesce({c}, ''), '[^{WS}]+'), lambda w: {word}))" for c in ("source", "target")]
    columns = []
    for n in (1, 2):
        match = f"SELECT coalesce(sum(least(x.n, y.n)), 0) FROM (SELECT pair_id, g, count(*) AS n FROM ({_grams('a', n)}) GROUP BY ALL) x JOIN (SELECT pair_id, g, count(*) AS n FROM ({_grams('b', n)}) GROUP BY ALL) y USING (pair_id, g)"
        columns += [f"(SELECT sum(greatest(len({s}) - {n - 1}, 0)) FROM toks)::BIGINT AS c{15 + 3 * n + k}" for k, s in enumerate("ab")] + [f"({match})::BIGINT AS c{17 + 3 * n}"]
    words = f"WITH toks AS (SELECT pair_id, {lists[0]} AS a, {lists[1]} AS b FROM parallel_pairs) SELECT {', '.join(columns)}"
    precision, recall = (" + ".join(f"c{3 * n + 2} / c{3 * n + k}" for n in range(8)) for k in (0, 1))
    return f"SELECT round(100 * 5 * p * r / (4 * p + r), 2) AS \"chrF++\" FROM (SELECT ({precision}) / 8 AS p, ({recall}) / 8 AS r FROM ({_chrf_sql()}), ({words}))"


def oracle_sql() -> dict[str, str]:
    turned = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in generate.StubClient.WORDS.items()) + " ELSE x END"
    said = f"""said AS (SELECT batch_id, sent_idx, text AS standard, {sql_clean(f"array_to_string(list_transform(string_split(text, ' '), lambda x: {turned}), ' ')")} AS dialect FROM batched),
        stub AS (SELECT *, 'stub:words' AS client, CASE WHEN dialect = '' THEN 'empty' WHEN length(dialect) >= 2 AND NOT {sql_artifact('dialect')} AND NOT (starts_with(dialect, '"') AND ends_with(dialect, '",')) THEN 'ok' ELSE 'rejected' END AS status FROM said)"""
    cleaned = sql_clean("coalesce(t, '')")
    stripped_lines = f"list_filter(list_transform(string_split({us('response')}, chr(10)), lambda x: {us('x')}), lambda x: x != '' AND NOT starts_with(x, '<s>') AND NOT contains(x, '[OUT]') AND NOT starts_with(x, 'Відповідь') AND NOT starts_with(x, 'Переклад'))"
    arrow = f"CASE WHEN contains(x, '→') THEN {us("string_split(x, '→')[-1]")} ELSE x END"
    numbered = f"list_filter(list_transform(list_transform({stripped_lines}, lambda x: {arrow}), lambda x: regexp_replace(x, '^\\p{{Nd}}+[.):][{WS}]*', '')), lambda x: x != '')"
    fit = "list_slice(list_concat({}, ['', '', '']), 1, 3)"
    positions = "unnest(range(0, 3))::BIGINT AS pos, unnest({}) AS translation"
    system = "'Ти — перекладач з діалектів та суржику на літературну українську мову.'"
    rendered = "string_agg('- ' || ukrainian || ' → ' || hutsul, chr(10) ORDER BY rank)"
    return {
        "sentence_ingest": f"WITH {SENTENCES} SELECT * FROM sentences",
        "sentence_limit": f"WITH {SENTENCES} SELECT * FROM sentences ORDER BY sent_id LIMIT 1000",
        "corpus_dedup": f"SELECT DISTINCT text FROM (SELECT text FROM standard_ukrainian UNION ALL SELECT target FROM parallel_pairs) WHERE length({us('text')}) > 0",
        "merge_corpora": "SELECT source, target FROM parallel_pairs UNION ALL SELECT generated_dialect, source_standard FROM jsonl_corpus",
        "swap_roles": "SELECT target AS source, source AS target FROM parallel_pairs",
        "tokenize_counts": f"WITH {SENTENCES} SELECT sent_id, token, count(*) AS n FROM (SELECT sent_id, {TOKENS} FROM sentences) GROUP BY ALL",
        "tf_normalized": f"WITH {SENTENCES}, c AS (SELECT sent_id, token, count(*) AS n FROM (SELECT sent_id, {TOKENS} FROM sentences) GROUP BY ALL) SELECT sent_id, token, n, round(n / max(n) OVER (PARTITION BY sent_id), 9) AS tf FROM c",
        "dict_match_topk": f"WITH {SENTENCES}, {DICTIONARY}, {_similar('sent_id', 'sentences')} SELECT sent_id, entry_idx, ukrainian, hutsul, round(sim, 9) AS sim, rank FROM ranked JOIN entries USING (entry_idx) WHERE rank <= 5",
        "dict_match_batch": f"WITH {INDEXED}, {DICTIONARY}, {_similar('batch_id', 'batched')} SELECT batch_id, entry_idx, ukrainian, hutsul, round(sim, 9) AS sim, rank FROM ranked JOIN entries USING (entry_idx) WHERE rank <= 50",
        "batch_assign": f"WITH {INDEXED} SELECT sent_id, sent_idx, batch_id FROM batched",
        "prompts": f"""WITH {INDEXED}, {DICTIONARY}, {_similar('batch_id', 'batched')},
            d AS (SELECT batch_id, {rendered} AS dict FROM ranked JOIN entries USING (entry_idx) WHERE rank <= 50 GROUP BY 1),
            u AS (SELECT batch_id, count(*) AS n, '{text.TASK}' || chr(10) || '{text.FORM}' || chr(10) || chr(10) || string_agg((sent_idx % 10 + 1) || '. ' || text, chr(10) ORDER BY sent_idx) AS user_prompt FROM batched GROUP BY 1),
            p AS (SELECT batch_id, n, 'Перекладай говіркою.' || chr(10) || chr(10) || coalesce(dict, '{text.NO_ENTRIES}') || chr(10) AS system_prompt, user_prompt FROM u LEFT JOIN d USING (batch_id))
            SELECT batch_id, n, system_prompt, user_prompt, (length(system_prompt) + length(user_prompt)) // 4 AS tokens FROM p""",
        "clean_text": f"SELECT DISTINCT record_id, {sql_clean('generated_dialect')} AS cleaned FROM jsonl_corpus",
        "validity_generator": f"""SELECT DISTINCT record_id, coalesce(length(c) >= 2 AND NOT {sql_artifact('c')} AND NOT (starts_with(c, '"') AND ends_with(c, '",')), false) AS valid FROM (SELECT record_id, {sql_clean('generated_dialect')} AS c FROM jsonl_corpus)""",
        "reject_reason": f"WITH {JUDGED} SELECT DISTINCT line_num, reason FROM judged",
        "reject_histogram": f"WITH {JUDGED} SELECT reason, count(*) AS n, min(line_num) AS first_line FROM judged WHERE reason IS NOT NULL GROUP BY 1",
        "corpus_stats": f"WITH {JUDGED} SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS valid, count(reason) AS filtered, printf('%.1f', 100.0 * count(*) FILTER (reason IS NULL) / count(*)) AS valid_percent, printf('%.1f', 100.0 * count(reason) / count(*)) AS filtered_percent FROM judged",
        "running_valid": f"WITH {JUDGED}, b AS (SELECT line_num // 10 AS batch_id, count(*) FILTER (reason IS NULL) AS ok FROM judged GROUP BY 1) SELECT *, sum(ok) OVER (ORDER BY batch_id)::BIGINT AS total FROM b",
        "clean_pairs": f"WITH {JUDGED} SELECT line_num, {sql_clean('translation')} AS source, source AS target FROM judged WHERE reason IS NULL",
        "parse_json_response": f"WITH {REPLIES}, p AS (SELECT batch_id, {fit.format(f'list_transform(said, lambda t: {cleaned})')} AS said FROM replies) SELECT batch_id, {positions.format('said')} FROM p",
        "parse_text_response": f"WITH {REPLIES}, r AS (SELECT batch_id, array_to_string(list_transform(said, lambda t, i: i || '. ' || t), chr(10)) AS response FROM replies), p AS (SELECT batch_id, {fit.format(f'list_transform({numbered}, lambda t: {sql_clean("t")})')} AS said FROM r) SELECT batch_id, {positions.format('said')} FROM p",
        "provenance_records": f"""SELECT source_standard, generated_dialect, 'hutsul' AS dialect, 'llm_generated' AS method, provenance.model AS model, '{RULES}' AS rules_file, '{STAMP}' AS timestamp FROM jsonl_corpus
            WHERE length({us('generated_dialect')}) >= 2 AND NOT {sql_artifact('generated_dialect')} AND NOT (starts_with(generated_dialect, '"') AND ends_with(generated_dialect, '",'))""",
        "resume_pending": f"WITH {SENTENCES} SELECT * FROM sentences s WHERE NOT EXISTS (SELECT 1 FROM jsonl_corpus j WHERE j.sent_id = s.sent_id)",
        "train_val_split": "SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY md5(pair_id || '-42'), pair_id) <= ceil(0.1 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM parallel_pairs",
        "chat_format": f"SELECT '<|user|>' || chr(10) || {system} || chr(10) || chr(10) || 'Перекладіть: ' || source || chr(10) || '<|assistant|>' || chr(10) || target || chr(10) AS text FROM parallel_pairs WHERE source IS NOT NULL AND target IS NOT NULL",
        "chat_prompt": f"SELECT pair_id, 'Перекладіть на літературну українську: ' || source AS prompt, '<s>[INST] ' || {system} || chr(10) || chr(10) || 'Перекладіть на літературну українську: ' || source || ' [/INST]' AS instruct FROM parallel_pairs",
        "dialect_names": r"SELECT DISTINCT record_id, regexp_replace(regexp_replace(regexp_extract(provenance.rules_file, '([^/]*)$', 1), '\.[^.]*$', ''), '(_rules_system|_rules|_system)$', '') AS name FROM jsonl_corpus",
        "paired_predictions": "SELECT pair_id AS idx, source AS prediction, target AS reference FROM parallel_pairs WHERE source IS NOT NULL AND target IS NOT NULL",
        "bleu_ngram_stats": _bleu_sql(BLANK.format("source"), BLANK.format("target")),
        "bleu_corpus": _bleu_score_sql(),
        "chrf_corpus": _chrf_score_sql(),
        "generate_stub": f"WITH {INDEXED}, {said} SELECT batch_id, sent_idx, standard, dialect, client, status FROM stub",
        "generation_progress": f"WITH {INDEXED}, {said}, b AS (SELECT batch_id, count(*) FILTER (status = 'ok') AS ok FROM stub GROUP BY 1) SELECT *, sum(ok) OVER (ORDER BY batch_id)::BIGINT AS total FROM b",
        "chrf_stats": _chrf_sql(),
        "token_id_mask": "SELECT pair_id, array_to_string(list_transform(string_split(coalesce(target, ''), ''), lambda x: CASE WHEN unicode(x) BETWEEN 0 AND 1079 THEN unicode(x) ELSE 0 END), ' ') AS ids FROM parallel_pairs",
        "pad_to_multiple": "SELECT pair_id, (ceil(max(greatest(length(coalesce(target, '')), 1)) OVER (PARTITION BY pair_id // 8) / 8.0) * 8)::BIGINT AS width FROM parallel_pairs",
        "training_steps": "SELECT origin, count(*) AS n, count(*) // 16 * 10 AS steps, least(1000, count(*) // 16 * 10 // 10) AS warmup FROM parallel_pairs GROUP BY 1",
        "stream_counts": "SELECT strftime(time_bucket(INTERVAL 7 DAYS, ingested_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, provenance.model AS model, count(*) AS n FROM jsonl_corpus WHERE ingested_at IS NOT NULL GROUP BY ALL",
    } | catalog_files.oracle_sql(us, sql_reason) | catalog_files.rejects_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | catalog_files.queries()
