import pytest
from pyspark.sql import functions as F

from tkanyna.functions import responses, text, tokens

CLEAN = [
    ('"foo"', "foo"), ('"foo",', 'foo"'), ('"foo,"', "foo"), ('""', ""), ('"', ""), ('"1. foo"', "foo"), ("1)", ""), ("1. 2) foo", "2) foo"), ("12:30 x", "30 x"), ("10.5 m", "5 m"),
    ('" foo"', "foo"), (" 1. foo", "1. foo"), ("a\n", "a"), (None, None), ("", ""),
]
STRIP = [(" a ", "a"), ("\t\na\n", "a"), ("\x1ca", "a"), (" a", "a"), ("​a", "​a"), ("", ""), (None, None)]
WORDS = [("М'ята і ЄДЕШ", ["м", "ята", "і", "єдеш"]), ("за́мок", ["за", "мок"]), ("№5 ½ x² _a_b", ["5", "½", "x²", "_a_b"]), ("ІЇҐ 12-й", ["іїґ", "12", "й"]), ("", [])]
PARSE = [
    (None, ["", "", ""]), ("", ["", "", ""]), ('{"translations":["a b","c"]}', ["a b", "c", ""]), (' {"translations":["1. x",null,"\\"y\\"","z"]} ', ["x", "", "y"]),
    ('{"translations":"a"}', ['{"translations":"a"}', "", ""]), ('["a","b"]', ['["a","b"]', "", ""]), ('{"k":1}', ['{"k":1}', "", ""]), ("1. aa\n\n2) bb\n3: cc", ["aa", "bb", "cc"]), ("1. 2. aa", ["aa", "", ""]),
    ("src → dst\nx→y→z", ["dst", "z", ""]), ("Переклад: q\n<s>[INST]\n[OUT] k\nok", ["ok", "", ""]), ('"aa",\n"bb"', ['aa"', "bb", ""]), ("→\nok", ["ok", "", ""]), ("5.", ["", "", ""]), ("a\nb\nc\nd", ["a", "b", "c"]),
    ('```json\n{\n"translations": [', ["```json", "{", '"translations": ['], ),
]
REASONS = [
    ("", "x", responses.EMPTY), ("x", "", responses.EMPTY), (None, "xx", responses.EMPTY), ("[a]", "[a]", responses.ARTIFACT), ('s', '{ "translations": 1', responses.ARTIFACT), ("s", '"foo"', responses.ARTIFACT), ("s", '"foo",', responses.ARTIFACT),
    ("s", "translations : x", responses.ARTIFACT), ("s", 'x "translations": y', None), ("s", '"a" b "c"', None), ("a", "a", responses.IDENTICAL), ("b", "a", responses.TOO_SHORT), ("s", '"a" b "c",', responses.ELEMENT),
    ("s", "<SEP>x<SEP>", r"error pattern: <SEP>.*<SEP>"), ("s", "<SEP>\n<SEP>", None), ("s", "1. foo", r"error pattern: ^\d+\.\s+"), ("s", "1.foo", None), ("s", "1) foo", None), ("s", "10.5 m", None),
    ("s", "Переклад: x", "error pattern: ^Переклад:"), ("s", "Переклад x", None), ("s", "Відповідь: x", "error pattern: ^Відповідь:"),
]


def column(spark, rows, schema, made):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", made.alias("made")).orderBy("i").select("made").collect()]


def test_clean(spark):
    assert column(spark, [(a,) for a, _ in CLEAN], "t string", text.clean("t")) == [b for _, b in CLEAN]


def test_strip(spark):
    assert column(spark, [(a,) for a, _ in STRIP], "t string", text.strip("t")) == [b for _, b in STRIP]


def test_words(spark):
    assert column(spark, [(a,) for a, _ in WORDS], "t string", text.words("t")) == [b for _, b in WORDS]


def test_parse_response(spark):
    assert column(spark, [(a,) for a, _ in PARSE], "t string", responses.parse_response("t", 3)) == [b for _, b in PARSE]


def test_embedded_json(spark):
    said = 'Ось: {"translations": ["а", "б"]} далі'
    assert column(spark, [(said,), ('{"translations": [}',)], "t string", responses.parse_response("t", 2, extract_json=True)) == [["а", "б"], ['{"translations": [}', ""]]


def test_reject_reason(spark):
    assert column(spark, [(a, b) for a, b, _ in REASONS], "s string, t string", responses.reject_reason("s", "t")) == [c for _, _, c in REASONS]


def test_is_valid(spark):
    cases = [("ab", True), ("a", False), ("", False), (None, False), ("[a", False), ('"a"', False), ("1. foo", True), ("Переклад: x", True)]
    assert column(spark, [(a,) for a, _ in cases], "t string", responses.is_valid("t")) == [b for _, b in cases]


def test_length_range_includes_both_ends(spark):
    cases = [("я" * 14, False), ("я" * 15, True), ("я" * 1000, True), ("я" * 1001, False), (None, False)]
    assert column(spark, [(a,) for a, _ in cases], "t string", text.in_length("t")) == [b for _, b in cases]


def test_prompts(spark):
    made = column(spark, [(["а", "б"],), ([],)], "t array<string>", text.user_prompt("t"))
    assert made[0] == f"{text.TASK}\n{text.FORM}\n\n1. а\n2. б"
    assert made[1] == f"{text.TASK}\n{text.FORM}\n"
    entries = [([("дім", "хата")],), ([],), (None,)]
    assert column(spark, entries, "e array<struct<ukrainian: string, hutsul: string>>", text.render_dictionary("e")) == ["- дім → хата", text.NO_ENTRIES, text.NO_ENTRIES]
    assert column(spark, [("$1 \\x",)], "d string", text.system_prompt("a {dictionary} b", "d")) == ["a $1 \\x b"]


@pytest.mark.parametrize(("path", "name"), [("x/hutsul_rules_system.txt", "hutsul"), ("hutsul_rules.txt", "hutsul"), ("a_system.md", "a"), ("plain.txt", "plain"), ("dir/none", "none")])
def test_dialect_name(spark, path, name):
    assert column(spark, [(path,)], "p string", text.dialect_name("p")) == [name]


def test_chat(spark):
    row = spark.createDataFrame([("ж", "я")], "source string, target string").select(text.chat_text(text.chat_messages("source", "target")).alias("a"), text.chat_text(text.chat_messages("source", None, False)).alias("b"), text.instruct_text("source", "target").alias("c")).first()
    assert row.a == f"<|user|>\n{text.SYSTEM}\n\n{text.ASK}ж\n<|assistant|>\nя\n"
    assert row.b == f"<|user|>\n{text.ASK_PLAINLY}ж\n"
    assert row.c == "<s>[INST] ж\n\nя [/INST]"


def test_percent_of_nothing(spark):
    assert column(spark, [(1, 3), (0, 0)], "a int, b int", text.percent("a", "b")) == ["33.3", "0.0"]


def test_masked_ids(spark):
    assert column(spark, [([-100, 0, 5, 9, 10, -1],)], "a array<int>", responses.mask_ids("a", 10)) == [[0, 0, 5, 9, 0, 0]]


def test_token_ids(spark):
    pytest.importorskip("tokenizers")
    pairs = spark.createDataFrame([("добрий день", "день"), ("", None)], "source string, target string")
    rows = tokens.training_columns(pairs, max_length=3).collect()
    assert [len(r.input_ids) for r in rows] == [3, 0] and rows[0].attention_mask == [1, 1, 1] and rows[1].labels == []


def test_preview_and_estimate(spark):
    assert column(spark, [("я" * 100,)], "t string", F.length(text.preview("t"))) == [80]
    assert column(spark, [("abcd", "efg")], "a string, b string", text.token_estimate("a", "b")) == [1]
