import os

import pytest

from tkanyna.llm import mixing
from tkanyna.llm.mixing import RANKS, mixture, wanted_copies

pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")

SIZES = {"a": 700, "b": 150, "c": 30, "d": 40}
TARGETS = [("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.1, 2)]


def tables(spark, sizes=SIZES):
    rows = [(f"{s}{k}", "слово " * (3 + k % 17) + str(k), s) for s, n in sizes.items() for k in range(n)]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)] + [(9001, None, "a"), (9002, "", "a"), (9003, "текст", None)]
    documents = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "doc_id bigint, text string, source string, tokens int, p double")
    return documents, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_water_filling():
    copies = wanted_copies({"a": 100, "b": 10, "x": 50}, {"a": (0.5, 1), "b": (0.5, 2), "none": (0.2, 3)})
    assert copies == {"a": 0.9, "b": 2.0, "none": 0.0}
    assert wanted_copies({}, {"a": (1.0, 1)}) == {"a": 0.0} and wanted_copies({"a": 5}, {}) == {}
    assert wanted_copies({"a": 10}, {"a": (1.0, 3)}, budget=25) == {"a": 2.5}


@pytest.mark.parametrize("bucket", [20_000, 9])
def test_shares_caps_and_whole_copies(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    documents, targets = tables(spark)
    mixed, report = mixture(documents, targets, "doc_id", "text", "source")
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b", "c"}
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"a", "b", "c", "none"} and got["none"].share_reached == 0 and got["none"].docs == 0
    assert all(got[r.source].max_repeats >= r.copies >= 1 for r in rows)
    assert sum(r.share_reached for r in got.values()) == pytest.approx(1)
    wanted = wanted_copies({s: r.tokens_there for s, r in got.items()}, {s: (t, m) for s, t, m in TARGETS})
    for s, r in got.items():
        copies = sum(x.copies for x in rows if x.source == s)
        assert abs(copies - wanted[s] * r.docs) < 1 + 1e-6
        assert r.tokens_used == sum(x.copies * x.tokens for x in rows if x.source == s)
        assert abs(r.tokens_used - wanted[s] * r.tokens_there) < max(60, 0.03 * r.tokens_used)
    again = sorted(tuple(r) for r in mixture(documents.repartition(5), targets, "doc_id", "text", "source")[0].collect())
    assert again == sorted(tuple(r) for r in rows)


def test_empty_tables(spark):
    documents, targets = tables(spark)
    mixed, report = mixture(documents.limit(0), targets, "doc_id", "text", "source")
    assert mixed.count() == 0 and {r.share_reached for r in report.collect()} == {0.0}
    mixed, report = mixture(documents, targets.limit(0), "doc_id", "text", "source")
    assert mixed.count() == 0 and report.count() == 0


def test_tokens_are_those_of_the_tokenizer(spark):
    documents, _ = tables(spark, {"a": 40})
    encode = mixing.encoder(RANKS, mixing.PATTERN).encode_ordinary
    counted = {r.doc_id: r.tokens for r in mixing.token_counts(documents, "doc_id", "text", "source").collect()}
    assert counted == {r.doc_id: len(encode(r.text)) for r in documents.collect() if r.text is not None and r.source is not None}
