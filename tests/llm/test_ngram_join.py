import random

import numpy as np
import pytest

from lexigrid.llm.ngram_join import divide_skip, jaccard_components, jaccard_links, need, one_of_each

SCHEMA = "doc_id long, text string, node string, n int"


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = bytes(text or "", "utf-8").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows)), key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    base = [rnd.choices(vocab, k=80) for _ in range(6)]
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab).upper()
        rows.append((1000 - i, " ".join(w[: rnd.choice([80, 80, 70, 60])]), "clash", i))
    rows += [(i, " ".join(rnd.choices(vocab[:3], k=rnd.randint(1, 7))), None, 0) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", None, None), (3, " \n\t", None, None), (None, "a b c", None, None), (7, "A b c c", None, None), (8, "a B c", None, None), (8, "a B c", None, None), (9, "a b c d e f g", None, None), (10, "x " * 30000, None, None), (11, "X " * 4 + "x", None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(5))
def test_divide_skip(seed):
    rnd = np.random.default_rng(seed)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 60)).astype(np.uint64)) for _ in range(80)]
    q = np.unique(rnd.integers(0, 60, 50).astype(np.uint64))
    expected = [i for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= need(len(q), len(s), 75, 100)]
    assert sorted(divide_skip(q, sets, 75, 100)) == expected


def test_one_of_each(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "quite another text of some length that has no friend here"
    rows = [(5, a, "k", 1), (3, a.upper(), "k", 2), (9, b, None, None), (9, b, None, None), (None, a, None, None), (None, None, "x", 0), (2, "", "y", 0)]
    out = one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "node", "n"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(3, a.upper(), "k", 2), (9, b, None, None), (None, None, "x", 0), (2, "", "y", 0)], key=str)


@pytest.mark.parametrize("block", [512, 7])
def test_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr("lexigrid.llm.ngram_join.BLOCK", block)
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(90)]
    base = [rnd.choices(vocab, k=60) for _ in range(4)]
    rows = [(1, "a b c d e f g h", None, 0), (2, "a b c d e f g h i", None, 0), (3, None, None, 0), (4, "A b c d e f g h", None, 0), (5, "no friend", None, 0)]
    for i in range(100):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((100 + i, " ".join(w), "clash", i))
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    expected = {i: sum(linked(a, b) for b in set(sets.values()) if b != a and b and a) for i, a in sets.items()}
    assert max(expected.values()) > 9 and expected[1] == expected[2] == expected[4] == 1
    out = jaccard_links(spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"]: r["n_links"] for r in out.collect()} == expected
    assert sorted((tuple(r) for r in out.drop("n_links").collect()), key=str) == brute(rows)
