import random

import pytest

from tkanyna.llm import leak
from tkanyna.llm.leak import SuffixAutomaton, leaks, without_leaks
from tkanyna.llm.words import words


def brute(documents, items, least):
    runs = {}
    for i, t in items:
        ws = words(t)
        for k in range(len(ws) - least + 1):
            runs.setdefault(tuple(ws[k : k + least]), set()).add(i)
    out = set()
    for d, t in documents:
        ws = words(t)
        for k in range(len(ws) - least + 1):
            out |= {(d, i) for i in runs.get(tuple(ws[k : k + least]), ())}
    return out


def texts(seed, n, vocabulary=6):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("абвгдеєж"[:vocabulary]) for _ in range(rng.randrange(0, 40)))) for i in range(n)] + [(900, None), (901, ""), (902, "…")]


def tables(spark, documents, items):
    return spark.createDataFrame([(*r, "x", 1) for r in documents], "doc_id bigint, text string, item string, doc int"), spark.createDataFrame([(*r, 2) for r in items], "item_id bigint, text string, t int")


@pytest.mark.parametrize("words_at_once", [2_000_000, 50])
def test_as_brute_force(spark, monkeypatch, words_at_once):
    monkeypatch.setattr(leak, "ITEM_WORDS", words_at_once)
    documents, items = texts(1, 60), texts(2, 40)
    d, i = tables(spark, documents + documents[::2], items)
    for least in (4, 6, 12):
        got = [(r.doc, r.item) for r in leaks(d, i, "doc_id", "text", "item_id", "text", least).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(documents, items, least)


def test_lengths_and_spans():
    a = SuffixAutomaton([(1, "а б в г д".split()), (2, "в г д е".split())], 3)
    assert a.held("х а б в г д е у".split()) == ({1, 2}, [(1, 7)])
    assert a.held("а б х в г".split()) == (set(), [])


def test_cleaning(spark):
    passage = "перше друге третє четверте п'яте шосте сьоме восьме дев'яте десяте одинадцяте дванадцяте тринадцяте"
    documents = [(1, f"Свій початок тут, а потім довгий-довгий вступ до справи з кількох слів і ще. {passage.upper()}! А це кінець."), (2, passage), (3, "Нічого."), (4, None), (5, "")]
    d, i = tables(spark, documents, [(7, passage)])
    got = {r.doc_id: r.text for r in without_leaks(d, i, "doc_id", "text", "item_id", "text").select("doc_id", "text").collect()}
    assert got == {1: "Свій початок тут, а потім довгий-довгий вступ до справи з кількох слів і ще. ! А це кінець.", 2: "", 3: "Нічого.", 4: None, 5: ""}


def test_empty_tables(spark):
    d, i = tables(spark, texts(3, 5), texts(4, 5))
    assert leaks(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0
    assert leaks(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert without_leaks(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 8


def test_cleaning_of_texts_that_grow_in_lower_case(spark):
    item = [f"слово{chr(0x430 + k)}" for k in range(12)]
    rows = [(1, f"İİ перед, {' '.join(item)}; після İ кінець і ще кілька слів, щоб було їх більше ніж уривок сам має їх тут."), (2, f"Перед {' '.join(item)}! " + "інше слово " * 7 + "İ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert leaks(docs, items, "doc_id", "text", "item_id", "text").count() == 2
    clean = {r.doc_id: r.text for r in without_leaks(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert clean == {1: rows[0][1].replace(" ".join(item), ""), 2: rows[1][1].replace(" ".join(item), "")}
