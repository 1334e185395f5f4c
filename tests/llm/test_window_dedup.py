import hashlib
import random

import pytest

from lexigrid.llm.window_dedup import dedup_windows

SCHEMA = "doc_id long, text string, kept string, n_words int"


def brute(rows, window):
    first, out = {}, []
    order = sorted({(r[0] if r[0] is not None else 2**63, r[1] or "") for r in rows})
    for doc, text in order:
        w = text.encode().split()
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (doc, p))
    for r in rows:
        w = (r[1] or "").encode().split()
        doc = r[0] if r[0] is not None else 2**63
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (doc, p):
                gone |= set(range(p, p + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    return sorted((tuple(r) for r in dedup_windows(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


@pytest.mark.parametrize(("window", "start"), [(20, 10), (8, 2), (6, 6)])
def test_matches_brute_force(spark, window, start):
    rnd = random.Random(window)
    shared = [[f"s{k}_{i}" for i in range(rnd.randint(5, 50))] for k in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += rnd.choice(shared) if rnd.random() < 0.5 else rnd.choices("abc", k=rnd.randint(1, 30))
        rows.append((100 - i, "\n ".join(w), None, None))
    rows += [(500 + i, rows[3][1], "x", 1) for i in range(4)] + [(700, "la " * 200, None, None)]
    assert run(spark, rows, window=window, start=start) == brute(rows, window)


def test_edges(spark):
    long = " ".join(f"w{i % 900}" for i in range(3000))
    rows = [(None, None, None, None), (1, "", None, None), (2, " \t", None, None), (3, "a  b", "k", 1), (None, long, None, None), (4, long, None, None), (4, long, None, None), (5, "Ä ß " * 25, None, None)]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == []
