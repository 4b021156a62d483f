import numpy as np
import pytest

from tests_llm_noise import noisy
from tkanyna.llm import nearsame, overlap
from tkanyna.llm.nearsame import word_set
from tkanyna.llm.overlap import RUN, coverage, cross_split_pairs, cut, differing, overlap_report, runs
from tkanyna.llm.passages import PassageAutomaton
from tkanyna.llm.words import words

SPLITS = ["train", "train", "validation", "test", None]


def rows(seed):
    texts = [t for _, t in noisy(seed, 240)]
    shifted = [None if t is None else f"{t} хвіст" for t in texts]
    return [(i, a, b, SPLITS[(i * 7) % 5], f"o{i % 3}") for i, (a, b) in enumerate(zip(texts, shifted))] + [(900, texts[6], shifted[40], "test", None), (901, texts[6], shifted[6], "test", "o1"), (902, texts[6], shifted[6], "train", "o1")]


def enough(a, b):
    common = len(a & b)
    return a and b and 10 * common >= 7 * (len(a) + len(b) - common)


def brute(data):
    sets = [(k, set(word_set(a)), set(word_set(b)), s == "train") for k, a, b, s, _ in data]
    return {(x[0], y[0]) for x in sets if not x[3] for y in sets if y[3] and enough(x[1], y[1]) and enough(x[2], y[2])}


def table(spark, data):
    return spark.createDataFrame([(*r, 1) for r in data], "pair_id bigint, source string, target string, split string, origin string, id int")


def found(spark, data):
    got = [tuple(r) for r in cross_split_pairs(table(spark, data), "pair_id", ("source", "target"), "split").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("way", ["one scan", "many scans", "long records", "keys", "hot keys"])
def test_as_brute_force(spark, monkeypatch, way):
    monkeypatch.setattr(overlap, "SPAN", 50)
    if way != "one scan":
        monkeypatch.setattr(overlap, "SHARD", 40)
    if way == "long records":
        monkeypatch.setattr(overlap, "CUTS", 9)
    if "keys" in way:
        monkeypatch.setattr(overlap, "PASSES", 0)
    if way == "hot keys":
        monkeypatch.setattr(nearsame, "RARE", 3)
        monkeypatch.setattr(nearsame, "BLOCK", 6)
    data = rows(11)
    assert len(brute(data)) > 20
    assert found(spark, data) == brute(data)


def test_one_run_of_a_record_stands_whole_in_a_near_same_one():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        a = np.sort(rng.permutation(200)[: rng.integers(8, 60)])
        b = np.unique(np.r_[rng.permutation(a)[: len(a) - rng.integers(0, 6)], rng.integers(0, 200, rng.integers(0, 12))])
        n, m, common = len(a), len(b), len(np.intersect1d(a, b))
        if m < 8 or 10 * common < 7 * (n + m - common):
            continue
        assert n + m - 2 * common <= differing(n + m) <= (10 - 7) * n // 7 and differing(n + m) + 1 in (runs(n, overlap.CUTS) if n <= overlap.CUTS else [differing(n + m) + 1])
        text = f",{','.join(map(str, b))},"
        for k in runs(n, overlap.CUTS) if n > overlap.CUTS else [differing(n + m) + 1]:
            assert any(f",{','.join(map(str, a[s:e]))}," in text for s, e in cut(n, k))


def test_automaton_finds_what_a_scan_finds():
    rng = np.random.default_rng(4)
    wanted = {tuple(rng.integers(1, 4, rng.integers(1, 5)).tolist()) for _ in range(60)}
    wanted = sorted(wanted)
    size = np.array([len(p) for p in wanted])
    table = np.array([[*p, *[0] * (4 - len(p))] for p in wanted])
    automaton = PassageAutomaton(table, size)
    texts = [rng.integers(1, 5, n).tolist() for n in rng.integers(0, 30, 50)]
    got = {(int(t), end, int(p)) for ts, end, ps in automaton.intervals(np.array([x for t in texts for x in t]), np.array(list(map(len, texts)))) for t, p in zip(ts, ps)}
    assert got == {(i, end, k) for i, t in enumerate(texts) for end in range(len(t) + 1) for k, p in enumerate(wanted) if end >= len(p) and tuple(t[end - len(p) : end]) == p}
    assert not list(PassageAutomaton(np.zeros((0, 4), np.int64), np.zeros(0, np.int64)).intervals(np.array([1, 2]), np.array([2])))


def test_rows_given_twice(spark):
    data = rows(14)
    assert found(spark, data + data[::3]) == brute(data)


def test_empty_and_one_sided(spark):
    assert found(spark, []) == set()
    assert found(spark, [r for r in rows(12) if r[3] == "train"]) == set()


def test_reports(spark):
    data = rows(13)
    pairs = brute(data)
    report = overlap_report(table(spark, data), "pair_id", ("source", "target"), "split", "origin").collect()
    assert sum(r.rows for r in report) == sum(r[3] != "train" for r in data)
    assert sum(r.overlapping for r in report) == len({a for a, _ in pairs}) and sum(r.train_matches for r in report) == len(pairs)


@pytest.mark.parametrize("passes", [overlap.PASSES, 0])
def test_coverage(spark, monkeypatch, passes):
    monkeypatch.setattr(overlap, "PASSES", passes)
    monkeypatch.setattr(overlap, "SHARD", 20)
    if passes:
        monkeypatch.setattr(overlap, "PASSES", 1000)
    data = [*rows(13), (950, None, "а б в г ґ д е є ж з", "test", "o1"), (951, None, "б в г ґ д", "train", "o1"), (952, "", "д е є ж з и і", "train", "o1"), (953, "а б", "в г ґ д е є", "test", None)]
    seen = {(f, tuple(ws[i : i + RUN])) for r in data if r[3] == "train" for f, t in (("source", r[1]), ("target", r[2])) for ws in [words(t)] for i in range(len(ws) - RUN + 1)}
    want = {}
    for r in data:
        if r[3] != "train":
            for f, t in (("source", r[1]), ("target", r[2])):
                ws = words(t)
                held = {j for i in range(len(ws) - RUN + 1) if (f, tuple(ws[i : i + RUN])) in seen for j in range(i, i + RUN)}
                if held:
                    want[r[0], f] = (len(ws), round(len(held) / len(ws), 6))
    assert {(r.pair_id, r.field): (r.words, r.covered) for r in coverage(table(spark, data), "pair_id", ("source", "target"), "split").collect()} == want
    assert want[950, "target"] == (10, 0.9)
