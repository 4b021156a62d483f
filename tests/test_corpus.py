import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tkanyna.cli import main, read_environment
from tkanyna.operators import assemble, cleaning, generate, metrics, retrieval
from tkanyna.plans import corpus
from tkanyna.session import shared_folder
from tkanyna.sources import files
from tkanyna.streaming import ingest

RULES = "Правила.\n{dictionary}\nКінець."


@pytest.fixture
def rules(tmp_path):
    path = tmp_path / "test_rules.txt"
    path.write_text(RULES, encoding="utf-8")
    return str(path)


def test_sentences_of_csv_and_text(spark, tmp_path):
    csv, txt = tmp_path / "a.csv", tmp_path / "a.txt"
    csv.write_text('text,x\n"  Речення з ""лапками"" і\nрядком всередині  ",1\nкоротке,2\n"Друге досить довге речення",3\n', encoding="utf-8")
    txt.write_text("Перше досить довге речення\n\nкоротке\n", encoding="utf-8")
    assert [r.text for r in files.read_sentences(spark, str(csv)).orderBy("sent_idx").collect()] == ['Речення з "лапками" і\nрядком всередині', "Друге досить довге речення"]
    assert files.read_sentences(spark, str(csv), limit=1).count() == 1
    assert files.read_sentences(spark, str(csv), limit=0).count() == 2
    assert files.read_sentences(spark, str(csv), "missing").count() == 0
    assert [tuple(r) for r in files.read_sentences(spark, str(txt)).collect()] == [(0, "Перше досить довге речення")]


def test_dictionary_rules_and_inputs(spark, tmp_path, rules):
    path = tmp_path / "d.csv"
    path.write_text("Hutsul,Ukrainian\n хижа ,хата\n,порожнє\nNA,є\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_dictionary(spark, str(path)).collect()] == [(0, "хата", "хижа"), (1, "є", "NA")]
    assert files.read_dictionary(spark, str(tmp_path / "none.csv")).count() == 0
    assert files.read_rules(spark, rules) == RULES
    with pytest.raises(FileNotFoundError):
        files.read_rules(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError):
        files.read_inputs(spark, str(path))


def test_splits_are_united_by_name(spark, tmp_path):
    spark.createDataFrame([("а", "б")], "source string, target string").write.parquet(str(tmp_path / "train"))
    spark.createDataFrame([("г", "в", 1)], "target string, source string, extra int").write.parquet(str(tmp_path / "validation"))
    got = files.read_splits(spark, [str(tmp_path / "train"), str(tmp_path / "validation")]).select("source", "target").collect()
    assert sorted(tuple(r) for r in got) == [("а", "б"), ("в", "г")]


def test_union_distinct_keeps_unstripped_values(spark):
    a, b = (spark.createDataFrame([(t,) for t in ts], "text string") for ts in (["а ", "б", None, "  "], ["б", "а", ""]))
    assert sorted(r.text for r in assemble.assemble([a, b]).collect()) == ["а", "а ", "б"]


def test_batches_and_resumption(spark):
    rows = spark.createDataFrame([(i, f"т{i}") for i in range(23)], "sent_idx bigint, text string")
    made = {r.batch_id: [x.sent_idx for x in r.inputs] for r in assemble.batches(rows, 10).collect()}
    assert made == {0: list(range(10)), 1: list(range(10, 20)), 2: [20, 21, 22]}
    done = spark.createDataFrame([(1,), (1,), (22,)], "sent_idx bigint")
    assert assemble.pending(rows, done).count() == 21


@pytest.mark.parametrize("n", [0, 1, 9, 10, 101])
def test_split_is_exact_and_repeatable(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "k bigint")
    made = assemble.train_test_split(df, "k")
    rows = sorted(tuple(r) for r in made.collect())
    assert len(rows) == n and sum(s == "test" for _, s in rows) == math.ceil(0.1 * n)
    assert rows == sorted(tuple(r) for r in assemble.train_test_split(df.repartition(3), "k").collect())


def test_split_of_repeated_keys(spark):
    df = spark.createDataFrame([(7,)] * 40, "k bigint")
    assert assemble.train_test_split(df, "k").filter("split = 'test'").count() == 4


def test_padding(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (1, [1] * 9), (2, [5])], "b int, ids array<int>")
    assert sorted(len(r.ids) for r in assemble.padded(df, "ids", "b").collect()) == [8, 16, 16]
    assert assemble.training_steps(1000, 4, 4, 10) == (620, 62)


def test_retrieval_ties_and_threshold(spark):
    entries = spark.createDataFrame([(0, "синє небо", "а"), (1, "синє небо", "б"), (2, "земля", "в")], "entry_idx bigint, ukrainian string, hutsul string")
    sentences = spark.createDataFrame([(1, "Синє небо над нами"), (2, "нічого")], "batch_id bigint, text string")
    found = retrieval.relevant_entries(sentences, entries, top_k=1).collect()
    assert [(r.batch_id, r.entry_idx, r["rank"]) for r in found] == [(1, 0, 1)] and found[0].sim == pytest.approx(2 / math.sqrt(2 * 4))
    assert retrieval.relevant_entries(sentences, entries, threshold=0).count() == 6


def test_generation_resumes_without_gaps(spark, tmp_path, rules):
    class Flaky(generate.StubClient):
        def generate(self, system_prompt, user_prompt, num_sentences=0):
            assert system_prompt == RULES.replace("{dictionary}", "- дім → хижа") or "No relevant" in system_prompt
            return None if "впаде" in user_prompt and not os.path.exists(flag) else super().generate(system_prompt, user_prompt, num_sentences)

    flag, store = str(tmp_path / "flag"), str(tmp_path / "store")
    rows = [(i, f"Речення про дім номер {i}{' впаде' if i == 4 else ''}") for i in range(7)]
    sentences = spark.createDataFrame(rows, "sent_idx bigint, text string")
    entries = spark.createDataFrame([(0, "дім", "хижа")], "entry_idx bigint, ukrainian string, hutsul string")
    make = lambda: Flaky(generate.ClientConfig("m"))
    first = corpus.generate_corpus(spark, sentences, rules, store, make, entries, batch_size=3, timestamp="t1")
    assert first.filter("status = 'failed'").count() == 3
    open(flag, "w").close()
    corpus.generate_corpus(spark, sentences, rules, store, make, entries, batch_size=3, timestamp="t2")
    pairs = spark.read.options(**files.CSV).csv(f"{store}/pairs")
    assert sorted(r.target for r in pairs.collect()) == sorted(t for _, t in rows)
    records = spark.read.schema(files.RECORD).json(f"{store}/records").collect()
    assert len(records) == 7 and {r.dialect for r in records} == {"test"} and {r.provenance.model for r in records} == {"stub:m"}
    again = corpus.generate_corpus(spark, sentences, rules, store, make, entries, batch_size=3, resume=False, timestamp="t3")
    assert again.count() == 7


def test_retry_table():
    class Done(Exception):
        pass

    def run(replies, **options):
        waits, said = [], iter(replies)

        def post(url, headers, body, timeout):
            r = next(said)
            if isinstance(r, Exception):
                raise r
            return r

        client = generate.RemoteClient(generate.RemoteConfig("m", api_key="k", retry_delay=1.0, **options), post, waits.append)
        return client.generate("s", "u", 2), waits

    good = (200, {"choices": [{"message": {"content": "ok"}}]})
    assert run([(429, None), (429, None), good]) == ("ok", [1.0, 2.0])
    assert run([(500, None), (503, None), good]) == ("ok", [1.0, 2.0])
    assert run([TimeoutError(), (400, None), good]) == ("ok", [1.0, 1.0])
    assert run([(400, None)] * 2, max_retries=2) == (None, [1.0])
    assert run([(200, {"error": 1})]) == (None, [])
    assert run([ValueError("no JSON"), good]) == ("ok", [1.0])


def test_clients():
    with pytest.raises(ValueError):
        generate.create_client("nobody", "m")
    with pytest.raises(ValueError):
        generate.create_client("openrouter", "m")
    assert generate.create_client("openrouter", "m", api_key="k").name == "openrouter:m"
    body = generate.payload(generate.RemoteConfig("m", api_key="k"), "s", "u", 2)
    assert body["response_format"]["json_schema"]["strict"] and "response_format" not in generate.payload(generate.RemoteConfig("m", api_key="k"), "s", "u")
    assert generate.create_client("local", "m", run=lambda p: 1 / 0).generate("s", "u") is None
    assert generate.RemoteConfig("m").url.startswith("https://")
    sent = {}
    named = generate.RemoteClient(generate.RemoteConfig("m", api_key="k", referer="r", title="t"), lambda url, headers, body, timeout: sent.update(headers) or (200, None))
    assert named.generate("s", "u") is None and sent["HTTP-Referer"] == "r" and sent["X-Title"] == "t"


class Model:
    """A model for tests, as a worker would load it."""

    def __init__(self, name="m", quantisation="fp16"):
        self.name = name

    def __call__(self, prompt, top_p=1.0):
        return f'Ось: {{"x": 1}} {{"translations": ["{len(prompt)} {top_p}"]}} кінець'

    def encode(self, text):
        return list(text)

    def decode(self, ids):
        return "".join(ids)


def echo():
    return lambda texts: [t.upper() for t in texts]


def test_local_models():
    client = generate.create_client("local", "m", run="test_corpus:Model", quantisation="int8", sampling={"top_p": 0.9})
    assert client.name == "local:m:int8" and client.generate("s", "u" * 9000, 1) == '{"translations": ["4096 0.9"]}'
    assert client.generate("s", "u").startswith("Ось") and generate.inner_object('{"a": {"translations": 1}}') == '{"translations": 1}' and generate.inner_object("{{") == "{{"


LINES = [
    '{"source_standard": "дім", "generated_dialect": "хижа"}', "", "no json", '{"source_standard": "дім", "generated_dialect": "дім"}', '{"source_standard": null, "generated_dialect": "x"}', "[1]",
    '{"source_standard": "а", "generated_dialect": "1)"}', '{"source_standard": "а", "generated_dialect": "б", "x": NaN}',
]


def test_convert_and_stats(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(LINES), encoding="utf-8")
    summary, reasons = corpus.convert(spark, str(path), str(tmp_path / "out"))
    row = summary.first()
    assert (row.total, row.valid, row.filtered) == (7, 2, 5) and row.valid_percent == "28.6"
    assert [tuple(r) for r in reasons.collect()] == [("json_parse_error", 3, 3), ("translation identical to source", 1, 4), ("empty source or translation", 1, 5)]
    out = spark.read.options(**files.CSV).csv(str(tmp_path / "out")).collect()
    assert [(r.source or "", r.target) for r in out] == [("хижа", "дім"), ("", "а")]
    assert corpus.stats(spark, str(path))[0].first() == row
    empty = cleaning.summary(cleaning.judged(cleaning.parse_records(spark.createDataFrame([], "line_num bigint, line string")))).first()
    assert (empty.total, empty.valid_percent) == (0, "0.0")


def test_metrics(spark):
    same = spark.createDataFrame([("Кіт їсть рибу вдома сьогодні.",) * 2] * 2, "prediction string, reference string")
    assert metrics.compute_metrics(same) == {"BLEU": 100.0, "chrF++": 100.0, "TER": 0.0}
    apart = spark.createDataFrame([("aaa bbb ccc ddd", "xxx yyy zzz www"), (None, "x")], "prediction string, reference string")
    found = metrics.compute_metrics(apart)
    assert found["BLEU"] == 0.0 and found["chrF++"] == 0.0 and found["TER"] == 100.0
    assert metrics.compute_metrics(same.limit(0)) == {"BLEU": 0.0, "chrF++": 0.0, "TER": 0.0}
    assert metrics.ter_edits("d a b c".split(), "a b c d".split()) == 1
    assert metrics.ter_edits("a b c".split(), "a x c".split()) == 1
    assert metrics.standard_tokens('Він, 3.5 км &quot;туди&quot; за 5-6 т.') == ["Він", ",", "3.5", "км", '"', "туди", '"', "за", "5", "-", "6", "т", "."]
    with pytest.raises(ValueError):
        metrics.paired(spark.createDataFrame([(1, "a")], "idx bigint, prediction string"), spark.createDataFrame([(2, "b")], "idx bigint, reference string"))


def test_evaluation_and_sinks(spark, tmp_path):
    inputs = spark.createDataFrame([(0, "раз"), (1, "два\nрядки"), (2, None)], "idx bigint, source string")
    said, scores = corpus.evaluate(inputs, inputs.select("idx", F.coalesce("source", F.lit("")).alias("reference")), lambda: lambda texts: texts)
    assert scores["TER"] == 0.0 and said.count() == 3
    files.write_lines(said, str(tmp_path / "p"), "prediction", "idx")
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["раз", "два рядки", ""]
    files.write_metrics(scores, str(tmp_path / "m" / "x.json"), {"a": 1})
    assert json.loads((tmp_path / "m" / "x.json").read_text())["metrics"] == scores
    assert files.json_lines_path("a/b.csv") == "a/b.jsonl"


def test_stream_runs_each_file_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.jsonl").write_text(LINES[0] + "\n" + LINES[3] + "\nbroken{\n", encoding="utf-8")
    for _ in range(2):
        ingest.append_valid(ingest.record_stream(spark, str(source)), out, str(tmp_path / "check")).awaitTermination()
    (source / "2.jsonl").write_text(LINES[0] + "\n", encoding="utf-8")
    ingest.append_valid(ingest.record_stream(spark, str(source)), out, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(f"{out}/pairs").count() == 2
    outcomes = {r.outcome: r.n for r in spark.read.parquet(f"{out}/outcomes").groupBy("outcome").agg(F.sum("count").alias("n")).collect()}
    assert outcomes == {"valid": 2, "translation identical to source": 1, "json_parse_error": 1}


def test_stream_of_sentences(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Перше досить довге речення\nкоротке\n  Друге досить довге речення \n", encoding="utf-8")
    query = ingest.sentence_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("sentences").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.text for r in spark.table("sentences").collect()) == ["Друге досить довге речення", "Перше досить довге речення"]


def test_command_line(spark, tmp_path, rules, capsys):
    txt, jsonl = tmp_path / "s.txt", tmp_path / "r.jsonl"
    txt.write_text("Перше досить довге речення\n", encoding="utf-8")
    jsonl.write_text(LINES[0], encoding="utf-8")
    assert main(["generate", "--input", str(txt), "--output", str(tmp_path / "g"), "--rules", rules]) == 0
    assert main(["stats", str(jsonl)]) == 0 and main(["convert", str(jsonl), str(tmp_path / "c")]) == 0 and main(["info", rules]) == 0
    assert "dialect test" in capsys.readouterr().out
    assert main(["convert", str(jsonl), str(tmp_path / "c"), "--verbose"]) == 0


def test_prediction_command(spark, tmp_path):
    inputs, meant, out = tmp_path / "i.csv", tmp_path / "r.csv", tmp_path / "out"
    inputs.write_text("source\nраз два три\n чотири п'ять \n", encoding="utf-8")
    meant.write_text("target\nРАЗ ДВА ТРИ\nЧОТИРИ\n", encoding="utf-8")
    assert main(["predict", str(inputs), str(meant), str(out), "--run", "test_corpus:echo"]) == 0
    assert [r.value for r in spark.read.text(f"{out}/predictions.txt").collect()] == ["РАЗ ДВА ТРИ", " ЧОТИРИ П'ЯТЬ "]
    found = json.loads((out / "metrics.json").read_text())
    assert set(found["metrics"]) == {"BLEU", "chrF++", "TER"} and found["metrics"]["TER"] == 25.0 and found["config"]["batch_size"] == 8


def test_environment_file(tmp_path, monkeypatch):
    monkeypatch.setenv("ALREADY", "1")
    monkeypatch.delenv("NEW_NAME", raising=False)
    (tmp_path / ".env").write_text("# x=1\nALREADY=2\nexport NEW_NAME='a=b'\n\nnothing\n")
    read_environment(str(tmp_path / ".env"))
    assert os.environ["ALREADY"] == "1" and os.environ.pop("NEW_NAME") == "a=b"
    read_environment(str(tmp_path / "absent"))


def test_fields_keep_their_blanks(spark, tmp_path):
    rows = spark.createDataFrame([(1, " а "), (2, '"б", '), (3, "в\nг"), (4, None), (5, "\\")], "k int, t string")
    files.write_csv(rows, str(tmp_path / "c"), order="k")
    assert [r.t for r in files.read_csv(spark, str(tmp_path / "c"), ["t"]).collect()] == [" а ", '"б", ', "в\nг", "", "\\"]


def test_csv_is_split_where_no_record_goes_over_a_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('t,u\n"а, ""б""",1\nв,2\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('t,u\n"а\nб",1\nв,2\n', encoding="utf-8")
    assert files.one_line_records(spark, str(tmp_path / "a.csv")) and not files.one_line_records(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), ["t", "u"]).collect()] == [('а, "б"', "1"), ("в", "2")]
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv"), ["t", "u"]).collect()] == [("а\nб", "1"), ("в", "2")]


def test_tables_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_folder(Session())
