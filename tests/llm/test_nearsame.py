import numpy as np
import pytest

from tests_llm_noise import noisy
from tkanyna.llm import nearsame
from tkanyna.llm.components import components
from tkanyna.llm.nearsame import Forest, keys_of, near_same_groups, near_same_pairs, word_set


def brute(rows):
    sets = [(k, set(word_set(t))) for k, t in rows]
    out = set()
    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            common = len(s & u)
            if s and u and 10 * common >= 7 * (len(s) + len(u) - common):
                out.add((min(a, b), max(a, b)))
    return out


def table(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "sent_id bigint, text string, row string, id int")


def pairs(spark, rows):
    got = [tuple(r) for r in near_same_pairs(table(spark, rows), "sent_id", "text").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = noisy(seed)
    assert pairs(spark, rows) == brute(rows)


def test_hot_keys_and_pairs_of_words(spark, monkeypatch):
    monkeypatch.setattr(nearsame, "RARE", 3)
    monkeypatch.setattr(nearsame, "BLOCK", 6)
    monkeypatch.setattr(nearsame, "VISITS", 5)
    rows = noisy(3)
    assert pairs(spark, rows) == brute(rows)


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(nearsame, "RARE", 1)
    base = [f"слово{i}" for i in range(130)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:115])), (3, " ".join(base[:92])), (4, " ".join(base[:60])), (5, " ".join(f"інше{i}" for i in range(40_000))), (6, " ".join(base * 300))]
    assert pairs(spark, rows) == brute(rows)


def test_a_third_are_copies(spark):
    text = "одне два три чотири п'ять шість сім вісім дев'ять"
    rows = [(i, text) for i in range(40)] + [(100 + i, text + " десять") for i in range(3)] + noisy(4)[5:80:9]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert pairs(spark, rows) == brute(rows)


def test_rows_given_twice(spark):
    rows = noisy(6, 80)
    assert pairs(spark, rows + rows[:40]) == brute(rows)
    groups = near_same_groups(table(spark, rows + [(None, rows[6][1])]), "sent_id", "text").collect()
    assert len(groups) == len(rows) + 1


def test_empty_table(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [(1, None), (2, "")]) == set()


def test_groups(spark):
    rows = noisy(5, 120)
    links = brute(rows)
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in sorted(links):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.sent_id: (r.group_id, r.links) for r in near_same_groups(table(spark, rows), "sent_id", "text").collect()}
    assert got == {k: (find(k), sum(k in p for p in links)) for k, _ in rows}


@pytest.mark.parametrize("visits", [7, 400_000])
def test_trees_find_what_a_scan_finds(monkeypatch, visits):
    monkeypatch.setattr(nearsame, "VISITS", visits)
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**63, (400, 2), dtype=np.uint64) & rng.integers(0, 2**63, (400, 2), dtype=np.uint64)
    bits[200:] = bits[:200] ^ (np.uint64(1) << rng.integers(0, 63, (200, 1), dtype=np.uint64))
    bits[390:] = bits[0]
    n, group = rng.integers(8, 30, 400), np.sort(rng.integers(0, 3, 400))
    forest = Forest(group, bits, n)
    d = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2)
    near = (group[:, None] == group) & (10 * n[:, None] >= 7 * n) & (10 * n >= 7 * n[:, None]) & (d <= nearsame.differing(n[:, None] + n))
    asked = rng.permutation(400)[:300]
    got = [(int(q), int(r)) for qs, rows in forest.search(group[asked], bits[asked], n[asked]) for q, r in zip(asked[qs], rows)]
    assert set(got) == {(int(q), r) for q in asked for r in range(400) if near[q, r]} and len(got) == len(set(got))
    own = {(int(q), int(r)) for qs, rows in forest.search(group, bits, n, forest.turn) for q, r in zip(qs, rows)}
    assert {(min(p), max(p)) for p in own if p[0] != p[1]} == {(a, b) for a in range(400) for b in range(a + 1, 400) if near[a, b]}
    assert not list(forest.search(np.array([9]), bits[:1], n[:1]))
    # edges: a child's distance to its parent, in order, and each row in one node
    assert sorted(forest.member.tolist()) == list(range(400)) and int((forest.end - forest.begin).sum()) == 400
    for node in range(len(forest.low)):
        for edge in range(forest.width - 1):
            for child in range(*forest.first[node * forest.width + edge : node * forest.width + edge + 2]):
                assert int(np.bitwise_count(forest.low[child] ^ forest.low[node]) + np.bitwise_count(forest.high[child] ^ forest.high[node])) == edge and forest.size[child] == forest.size[node]


def test_near_same_sets_have_a_key_in_common():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**63, 60, dtype=np.uint64)
    counts = np.zeros(nearsame.SLOTS, np.int64)
    counts[words & np.uint64(nearsame.SLOTS - 1)] = rng.integers(1, 1000, 60)
    kinds = set()
    for _ in range(2000):
        a = rng.permutation(60)[: rng.integers(8, 20)]
        b = np.unique(np.r_[rng.permutation(a)[: len(a) - rng.integers(0, 3)], rng.integers(0, 60, rng.integers(0, 3))])
        common = len(np.intersect1d(a, b))
        if len(b) >= 8 and 10 * common >= 7 * (len(a) + len(b) - common):
            keys = [{tuple(x[list(k)].tolist()) for k in keys_of(words[x], counts, 1000, 30)} for x in (a, b)]
            assert keys[0] & keys[1]
            kinds |= {len(k) for k in keys[0]}
    assert len(kinds) > 2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (0, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
