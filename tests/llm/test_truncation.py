import pytest

from tkanyna.llm.align import begins, fold, reach, walk
from tkanyna.llm.truncation import cut_renderings, is_cut, prefix_copies, truncation_rates

WHOLE = "Поки Данило справді оцінив вовняну сорочку, Макар не побачив барвисту хустку біля села Смотарівка."
SAID = "Поки Данило справді оцінив вовнєну сорочку, Макар ни побачив барвисту хустку коло села Смотарівка."


@pytest.mark.parametrize("end", range(4, 13))
def test_every_cut_between_words_is_found(end):
    ws = SAID.split()
    assert is_cut(" ".join(ws[:end]), WHOLE)
    assert is_cut(" ".join(ws[:end]) + "…", WHOLE) and is_cut("Ой, " + " ".join(ws[:end]) + " -", WHOLE)


def test_cuts_inside_words():
    assert is_cut(SAID[:-6], WHOLE) and is_cut(SAID[:-20], WHOLE) and is_cut(SAID[:-5] + "�", WHOLE)


@pytest.mark.parametrize("said", [SAID, SAID[:-1], SAID[:-1] + "…", "«" + SAID + "»", "Ой, " + SAID, "3. " + SAID, SAID.upper(), SAID.replace("справді ", ""), "Зовсім інше речення про річку.", "", None, "…"])
def test_whole_renderings_are_no_case(said):
    assert not is_cut(said, WHOLE)


def test_sentences_without_words():
    assert not is_cut(SAID, None) and not is_cut(SAID, "") and not is_cut(SAID, "…")


def test_rotated_renderings_are_whole():
    assert not is_cut("у селі Короминка навесні сусід продав теплу хату", "навесні сусід продав теплу хату у селі Короминка")


def test_long_texts_are_walked():
    words = [f"слово{i}х" for i in range(3000)]
    assert walk(words[:2000], words) == (2000, 2000) and reach(words[:2000], words) == (2000, 2000)
    assert is_cut(" ".join(words[:2000]), " ".join(words)) and not is_cut(" ".join(words), " ".join(words))


def test_folding():
    assert fold("рідну") == fold("рінну") and fold("перевірила") == fold("пиривірела") and begins("пере", "перевірила") and not begins("перевірила", "перевірила")


def test_operator_and_rates(spark):
    rows = [(1, SAID[:40], WHOLE, "a", 0), (1, SAID[:40], WHOLE, "a", 0), (2, SAID, WHOLE, "a", 0), (3, None, WHOLE, None, 0), (4, SAID, None, None, 0), (5, SAID[:50], WHOLE, None, 0), (None, SAID[:40], WHOLE, "a", 0)]
    df = spark.createDataFrame(rows, "key bigint, said string, meant string, origin string, row int").withColumnRenamed("key", "pair_id")
    cut = cut_renderings(df, "pair_id", "said", "meant")
    assert sorted(r.row for r in cut.collect()) == [1, 5]
    rates = {r.source: (r.rows, r.cut_rows, r.rate) for r in truncation_rates(df.drop("row").filter("pair_id is not null"), "pair_id", "origin", cut).collect()}
    assert rates == {"a": (2, 1, 0.5), None: (3, 1, 0.333333)}
    assert cut_renderings(df.limit(0), "pair_id", "said", "meant").count() == 0


def test_prefix_copies(spark):
    rows = [(1, "Кіт їсть рибу вдома"), (2, "кіт їсть рибу вдома, бо голодний"), (3, "кіт їсть рибу вдома!"), (4, "кіт їсть"), (5, None), (6, "кіт їсть рибу вдома, бо голодний"), (7, "пес їсть рибу вдома")]
    df = spark.createDataFrame(rows, "row bigint, text string")
    assert sorted(r.row for r in prefix_copies(df, "row", "text").collect()) == [1, 3]
    assert prefix_copies(df.limit(0), "row", "text").count() == 0


def test_prefix_copies_of_both_fields_cut_anywhere(spark):
    said = ["Кіт їсть рибу вдома", "Кіт їсть ри", "Кіт їс", "К", "Кіт їсть", "Пише HT", "Пише со", None, "…"]
    other = ["кіт їсть рибу вдо", "кіт їсть рибу вдома, бо голодний", "кіт їсть раки", "пише HTML", "пише computer", "їсть рибу", "кіт їсть рибу вдома, бо голодний"]
    rows = [(t, k, v) for t, values in (("a", said), ("b", other)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, value string")
    found = prefix_copies(df, ["tbl", "row_id"], "value", least=1)
    assert sorted(map(tuple, found.collect())) == [*(("a", k) for k in range(7)), ("b", 0)]
    assert prefix_copies(df.limit(0), ["tbl", "row_id"], "value", least=1).count() == 0


def test_prefix_copies_query_takes_both_tables(spark, tmp_path):
    from tkanyna.llm.queries import p2_prefix_copies

    spark.createDataFrame([(1, "Мати пекла хл"), (2, "Ой, снігу")], "pair_id bigint, source string").write.parquet(f"{tmp_path}/parallel_pairs.parquet")
    spark.createDataFrame([(1, "Мати пекла хліб"), (2, "Ой"), (2, "Ой")], "record_id bigint, generated_dialect string").write.parquet(f"{tmp_path}/jsonl_corpus.parquet")
    assert sorted(map(tuple, p2_prefix_copies(spark, str(tmp_path)).collect())) == [("jsonl_corpus", 2), ("parallel_pairs", 1)]


def test_long_texts_are_aligned_as_short_ones(monkeypatch):
    import random

    from tkanyna.llm import align

    draw = random.Random(7)
    some = ["не", "на", "до", "ні", "дід", "хата", "хат", "сорочка", "сорочку", "річка", "рі", "й"]
    for _ in range(400):
        a, b = draw.choices(some, k=draw.randint(1, 25)), draw.choices(some, k=draw.randint(1, 25))
        assert walk(a, b) == reach(a, b)
    monkeypatch.setattr(align, "CELLS", 0)
    assert is_cut(SAID[:-20], WHOLE) and not is_cut(SAID, WHOLE)


def test_long_cuts_with_inserted_words_are_found():
    from tkanyna.llm.answers import defect, unlike

    letters = "бвжзклмпрстфхцчшщ"
    meant = [w for i in range(2000) for w in ([letters[i % 17] + "о" + letters[i // 17 % 17] + "а" + letters[i // 289] + "і"] + ["не"] * (i % 30 == 29))]
    said = [*meant[:10], "не", *meant[10:1400]]
    assert len(said) * len(meant) > 1_000_000
    assert is_cut(" ".join(said), " ".join(meant)) and not is_cut(" ".join(said + meant[1400:]), " ".join(meant))
    assert not unlike(meant, said) and defect(" ".join(meant), " ".join(said)) == "truncated"


@pytest.mark.parametrize("said", ["Він не", "Він не прий", "Він н", "Він", "Гей, люди добрі, слухайте но мене уважно: він не прийшов до нас учора із с"])
def test_short_cuts_and_long_leads_reach_the_alignment(said):
    sentence = "Він не прийшов до нас учора із села"
    assert is_cut(said, sentence) and not is_cut(said + ".", sentence)
    assert not is_cut("Ми " + sentence, sentence) and not is_cut("Та де", sentence)
