import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tkanyna.llm.words import usual_form, words

USUAL = [
    None, "", " ", "Сім'я в селі, «добре» — так… №5 ½", "5 °C і 12 м²", "у XIX столітті", "з XVIII століття", "USB-портом, Wi-Fi, e-mail, web-сторінка", "драби́ну", "таб\tі\nрядок", "“лапки”", "I",
]
CHANGED = [
    ("Kлимкo пoлaгoдив", "Климко полагодив"), ("кpиницю i зeлeнe", "криницю і зелене"), ("за хвилину так　і ні", "за хвилину так і ні"), ("зва­жив сло​во﻿", "зважив слово"),
    ("йде їхати ïм", "йде їхати їм"), ("м’ята, м`ята, мʼята, м＇ята", "м'ята, м'ята, м'ята, м'ята"), ("так， １２３．", "так, 123."), ("ХІХ століття", "XIX століття"), ("5 °С", "5 °C"),
    ("РDF", "PDF"), ("сеρце Ηа", "сеpце На".replace("p", "р")), ("O шостій", "О шостій"), (" ", " "),
]


@pytest.mark.parametrize("text", USUAL[:-1])
def test_usual_values_stay(text):
    assert usual_form(text) == text


@pytest.mark.parametrize(("text", "usual"), CHANGED)
def test_odd_values_change(text, usual):
    assert usual_form(text) == usual
    assert usual_form(usual) == usual


def test_words():
    assert words("М’ЯТА, м'ята; 12-й за́мок­!") == ["м'ята", "м'ята", "12", "й", "замок"]
    assert words(None) == words("") == words("…​") == []
    assert words("Kіт") == words("кіт")


def test_foreign_texts_keep_their_letters():
    for text in ("Vecina noastră a adus o ladă", "într-o dimineață", "My cousin hid a copper bell"):
        assert usual_form(text) == text


ALPHABET = "абвіїйиуКСОРХІ'’`-— .,°²№XIVCMaopcxyiUSe1２ 　​­̆̈́ΟρΚK«»"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=30))
def test_the_usual_form_is_its_own(text):
    usual = usual_form(text)
    assert usual_form(usual) == usual and words(usual) == words(text)


def test_letters_are_composed_beside_a_stress_mark():
    assert usual_form("за́мок рёвом") == "за́мок рёвом" and words("за́мок рёвом") == ["замок", "рёвом"]
    assert usual_form("café") == "café" and usual_form("зáмок") == "за́мок" and usual_form("зáмок") == "за́мок"


def test_shapes_come_from_unicode_properties():
    assert usual_form("𝐚𝐛𝐜 ﬁn x\u0085y z") == "abc fin x y z"
    assert usual_form("12 м², 5 µm, № 3, ª ½⁦…⁩") == "12 м², 5 µm, № 3, ª ½…"
