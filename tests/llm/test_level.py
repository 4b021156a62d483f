import numpy as np
import pytest

from tkanyna.llm.level import LEVELS, SLOTS, Lexicon, features, fit, reading_levels


def graded(n, seed=3):
    """Texts whose sentences grow with their level."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        level = i % LEVELS + 1
        sentences = [" ".join(rng.choice(["кіт", "пес", "хата", "бо", "залежність", "упорядкованість", "річка"], size=level * 3 + rng.integers(0, 2))) for _ in range(6)]
        out.append((i, ". ".join(sentences) + ".", level))
    return out


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    score = 2 * x[:, 0] - x[:, 1]
    y = np.digitize(score, [-2.5, -0.8, 0.8, 2.5]) + 1
    model = fit(x, y, steps=600)
    assert (model.level(x) == y).mean() > 0.9 and (np.diff(model.cuts) > 0).all()
    assert (fit(x, y, steps=50).weights == fit(x, y, steps=50).weights).all()


def test_one_level_only():
    x = np.ones((5, 2))
    assert set(fit(x, np.full(5, 3), steps=200).level(x)) == {3}


def test_features_of_odd_texts():
    lexicon = Lexicon(np.ones(SLOTS + 1, np.int64))
    assert features("…", lexicon) is None and features("", lexicon) is None
    assert all(np.isfinite(features(t, lexicon)).all() for t in ("а", "а. б. в", "слово " * 50_000, "рядок\nрядок\n\nабзац"))


def test_held_out_levels_and_odd_rows(spark):
    rows = graded(300)
    documents = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(901, None, "x", 1), (902, "  ", "x", 1), (903, "…", "x", 1)], "doc_id bigint, text string, level string, row int")
    rated = [(i, level, "r") for i, _, level in rows if i % 3] + [(1, 2, "s"), (999, 1, "r"), (2, None, "r"), (4, 9, "r"), (None, 1, "r")]
    labels = spark.createDataFrame(rated, "doc_id bigint, level int, rater string")
    got = {r.doc_id: r.level for r in reading_levels(documents, labels, "doc_id", "text", "level").collect()}
    assert set(got) == {i for i, _, _ in rows} | {903} and got[903] == 1
    held = [(got[i], level) for i, _, level in rows if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert reading_levels(documents, labels.limit(0), "doc_id", "text", "level").count() == 0
    assert reading_levels(documents.limit(0), labels, "doc_id", "text", "level").count() == 0


@pytest.mark.parametrize("sample", [10, 200])
def test_sample_is_bounded(spark, sample):
    from tkanyna.llm.level import corpus_counts, fitted

    rows = graded(100)
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, level) for i, _, level in rows], "doc_id bigint, level int")
    assert fitted(documents, labels, "doc_id", "text", "level", corpus_counts(documents, "text"), sample) is not None
