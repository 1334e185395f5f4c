import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexigrid.llm.hmm_scoring import Model, Settings, _begin, expected_counts, log_likelihoods, score_documents

SCHEMA = "doc_id long, text string, score double, n string"


def a_model(rnd, k=3, v=6):
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return Model(norm(rnd.random(k), 0), norm(rnd.random((k, k)), 1), norm(rnd.random((v, k)), 0))


def paths(seq, m):
    """Likelihood and expected counts by going through all state paths."""
    k = len(m.start)
    total, step, emit, start = 0.0, np.zeros((k, k)), np.zeros_like(m.emit), np.zeros(k)
    for code in range(k ** len(seq)):
        path = [code // k**i % k for i in range(len(seq))]
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.step[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        total += p
        start[path[0]] += p
        for t, s in enumerate(path):
            emit[seq[t], s] += p
            if t:
                step[path[t - 1], s] += p
    return total, Model(start / total, step / total, emit / total)


@pytest.mark.parametrize("stretch", [1024, 1, 2, 3])
@pytest.mark.parametrize("seed", range(3))
def test_forward_and_counts_match_all_paths(seed, stretch, monkeypatch):
    monkeypatch.setattr("lexigrid.llm.hmm_scoring.STRETCH", stretch)
    rnd = np.random.default_rng(seed)
    m = a_model(rnd)
    seqs = [rnd.integers(0, 6, n) for n in (1, 4, 6, 2, 6, 3)]
    counts = Model(np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3)))
    total = expected_counts(seqs, m, counts)
    exact = [paths(s.tolist(), m) for s in seqs]
    assert np.allclose(log_likelihoods(seqs, m), [math.log10(e[0]) for e in exact])
    assert math.isclose(total, sum(math.log10(e[0]) for e in exact))
    for name in ("start", "step", "emit"):
        assert np.allclose(getattr(counts, name), sum(getattr(e[1], name) for e in exact))


def plain_pass(seq, m):
    """Forward and backward over one text, a token at a time: log10 likelihood and expected counts."""
    n, k = len(seq), len(m.start)
    a, b, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        a[t] = (m.start if t == 0 else a[t - 1] @ m.step) * m.emit[seq[t]]
        scale[t] = a[t].sum()
        a[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        b[t] = m.step @ (m.emit[seq[t + 1]] * b[t + 1]) / scale[t + 1]
    step = sum((np.outer(a[t - 1], m.emit[seq[t]] * b[t]) * m.step / scale[t] for t in range(1, n)), np.zeros((k, k)))
    emit = np.zeros_like(m.emit)
    np.add.at(emit, seq, a * b)
    return np.log10(scale).sum(), a[0] * b[0], step, emit


def plain_scores(rows, s):
    """What score_documents() should give as score, from words to the last forward recursion."""
    toks = [[*(r[1] or "").encode().lower().split(), b" "] for r in rows]
    train = [t for r, t in zip(rows, toks, strict=True) if zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 != 2]
    c = Counter(w for t in train for w in t)
    total, kinds = sum(c.values()), len(c)
    top = [b" ", *(w for w, _ in sorted(((w, n) for w, n in c.items() if w != b" "), key=lambda x: (-x[1], x[0]))[: s.words])]
    number = {w: i for i, w in enumerate(top)}
    p = lambda w: (c[w] + 1) / (total + kinds + 1)
    prior = np.array([*map(p, top), sum(map(p, c.keys() - number.keys())) + 1 / (total + kinds + 1)])
    prior /= prior.sum()
    coded = [np.array([number.get(w, len(top)) for w in t]) for t in toks]
    m = _begin(prior, s)
    for _ in range(s.rounds):
        sums = [plain_pass(x, m)[1:] for x, t in zip(coded, toks, strict=True) if any(t is y for y in train)]
        start, step, emit = (sum(x[k] for x in sums) for k in range(3))
        start, step, emit = start + 1, step + 1, emit + s.prior * prior[:, None]
        m = Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    return [plain_pass(x, m)[0] + sum(math.log10(p(w) / prior[-1]) for w in t if w not in number) for x, t in zip(coded, toks, strict=True)]


@pytest.mark.parametrize("stretch", [256, 7])
def test_scores_of_the_whole_method(spark, stretch, monkeypatch):
    monkeypatch.setattr("lexigrid.llm.hmm_scoring.STRETCH", stretch)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices([f"w{k}" for k in range(30)], k=rnd.randint(0, 40))) + f" u{i % 9}", None, None) for i in range(60)] + [(None, None, None, None), (99, "w1 w2 " * 2000, None, None)]
    s = Settings(states=3, words=12, rounds=3, prior=4.0)
    out = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame(rows, SCHEMA), s).collect()}
    assert np.allclose([out[r[0]] for r in rows], plain_scores(rows, s), rtol=1e-9)


def base(rows):
    toks = [[*(r[1] or "").encode().lower().split(), b" "] for r in rows]
    held = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 == 2 for r in rows]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((r[0], h, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, h in zip(rows, toks, held)), key=str)


def test_scores(spark):
    rnd = random.Random(1)
    one, two = [f"a{i}" for i in range(40)], [f"B{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(rnd.choice([one, two]), k=rnd.randint(0, 60))) + f" u{i}", None, None) for i in range(300)]
    rows += [(None, None, 1.0, "x"), (7, "", None, None), (7, "", None, None), (9, "a1 " * 5000, None, None), (11, "a1 b \x0b c", None, None)]
    out = score_documents(spark.createDataFrame(rows, SCHEMA), Settings(states=2, words=50, rounds=4, prior=5.0)).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out), key=str) == base(rows)
    away = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in away) > sum(r["base_score"] for r in away) + 0.1 * sum(r["n_tokens"] for r in away)  # two states find the two vocabularies
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
