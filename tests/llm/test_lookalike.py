from tkanyna.llm import lookalike
from tkanyna.llm.lookalike import Trie, is_plain, open_tokens, shape, stacked, usual_values, with_usual


def values(spark, rows):
    return spark.createDataFrame(rows, "tbl string, row_id bigint, field string, value string, token string, shape string, n int")


def row(i, value):
    return ("t", i, "f", value, "x", "y", 1)


def test_every_value_in_the_usual_form(spark):
    given = ["кіт і пес", "кiт i пес", "кіт і пес", None, "", " ", "пес ​", "USB і web", "e-mail", "O котрій?", "кіт і пес", "xаta"]
    got = {r.row_id: r.usual for r in usual_values(values(spark, [row(i, v) for i, v in enumerate(given)]).repartition(3), ["tbl", "row_id", "field"]).collect()}
    assert got == {1: "кіт і пес", 2: "кіт і пес", 6: "пес ", 9: "О котрій?", 11: "xata"}


def test_vocabulary_decides_where_letters_leave_it_open(spark):
    assert shape("cop") == shape("сор") and is_plain("кіт") and is_plain("web") and not is_plain("cop") and not is_plain("кiт")
    trie = Trie()
    trie.add("сор", 3)
    trie.add("сорт", 9)
    trie.add("cop", 1)
    assert trie.spelling("cop") == "сор" and trie.spelling("c​op") == "сор" and trie.spelling("кіт") is None
    trie.add("cop", 5)
    assert trie.spelling("cop") == "cop"


def test_the_trie_reads_letters_that_no_table_lists(spark, monkeypatch):
    given = ["стара калина", "стара калина", "голуба калинка", "кɑлина", "стɑра", "Sтаровина", "Старовина", "кօлօда", "колода", "малɑ", "WEBінар", "ɑвто", "авто", "автҫ"]
    rows = [row(i, v) for i, v in enumerate(given)]
    want = {3: "калина", 4: "стара", 5: "Старовина", 11: "авто"}
    want.pop(11)  # too short for the others to tell
    for most in (lookalike.MOST, 0):
        monkeypatch.setattr(lookalike, "MOST", most)
        got = {r.row_id: r.usual for r in usual_values(values(spark, rows).repartition(3), ["tbl", "row_id", "field"]).collect()}
        assert got == want
        every = {r.row_id: r.usual for r in with_usual(values(spark, [*rows, row(99, None)]), ["tbl", "row_id", "field"]).collect()}
        assert every == {i: want.get(i, v) for i, v in enumerate(given)} | {99: None}


def test_costs():
    trie = Trie()
    for word, n in (("калина", 2), ("калита", 9), ("канина", 7)):
        trie.add(word, n)
    assert trie.spelling("калиɑа") == "калита" and trie.spelling("кaлина") == "калина" and trie.spelling("кɑлиɑа") is None and trie.spelling("калица") is None


def test_many_open_words_in_one_value(spark):
    value = " ".join(f"дло{chr(0x430 + i % 32)}{chr(0x430 + i // 32)}wо" for i in range(1000))
    assert usual_values(values(spark, [row(1, value), row(2, value.replace("w", "в"))]), ["tbl", "row_id", "field"]).first().usual == value.replace("w", "в")


def test_ties_go_to_the_first_in_order():
    trie = Trie()
    trie.add("cop", 2)
    trie.add("сор", 2)
    assert trie.spelling("сop") == "cop"


def test_open_tokens():
    assert open_tokens("кiт USB XIX 5 °C e") == ["кiт", "e"]


def test_long_and_empty(spark):
    got = usual_values(values(spark, [row(1, "кiт " * 50_000)]), ["tbl", "row_id", "field"]).first()
    assert got.usual == "кіт " * 50_000
    assert usual_values(values(spark, []), ["tbl", "row_id", "field"]).count() == 0


def test_stacking(spark):
    df = spark.createDataFrame([(1, "a", None, 5)], "k bigint, x string, y string, field int")
    assert sorted((r.field, r.value) for r in stacked([("t", df, "k", ["x", "y"])]).collect()) == [("x", "a"), ("y", None)]
