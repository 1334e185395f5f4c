import hashlib
import random

import numpy as np
import pytest

from lexigrid.llm.suffix_dedup import dedup_substrings, without_repeats
from lexigrid.llm.suffix_sort import common_prefixes, sort_suffixes

SCHEMA = "doc_id long, text string, kept string, n_bytes int"


def brute(rows, length):
    count, out = {}, []
    raws = [(r[1] or "").encode() for r in rows]
    for raw in raws:
        for p in range(len(raw) - length + 1):
            count[raw[p : p + length]] = count.get(raw[p : p + length], 0) + 1
    for r, raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((r[0], len(raw), int(gone.sum()), edge.reshape(-1, 2).tolist(), kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    out = dedup_substrings(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4]), r[5]) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", range(12))
def test_sort(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(0, 400))
    text = rnd.integers(*rnd.choice([[0, 2], [0, 256], [254, 256], [97, 100]]), n).astype(np.uint8)
    if seed % 3 == 0 and n > 60:
        text[20:50] = text[0]
    wanted = rnd.random(n) < 0.7
    depth = int(rnd.choice([3, 8, 20]))
    order = sort_suffixes(text, wanted, depth)
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    full = text.tobytes() + b"\0" + b"\xff" * 50
    heads = [full[i : i + depth] for i in order]
    assert heads == sorted(heads)
    plain = text.tobytes() + b"\0" * 100
    shared = [next((k for k in range(depth) if plain[a + k] != plain[b + k]), depth) for a, b in zip(order, order[1:])]
    assert common_prefixes(text, order, depth).tolist() == shared


@pytest.mark.parametrize(("length", "key"), [(200, 100), (24, 10), (16, 16)])
def test_matches_brute_force(spark, length, key):
    rnd = random.Random(length)
    letters = "abcdeé \n"
    shared = ["".join(rnd.choice(letters) for _ in range(rnd.randint(length // 2, 3 * length))) for _ in range(8)]
    rows = []
    for i in range(70):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else "".join(rnd.choice(letters) for _ in range(rnd.randint(1, length))) for _ in range(rnd.randint(0, 5))]
        rows.append((i, "".join(parts), None, None))
    rows += [(500 + i, rows[3][1], "x", 1) for i in range(3)] + [(700, "la " * length, None, None), (701, "a" * 3 * length, None, None), (702, "b" * length, None, None), (703, "\0" * (length + 5), None, None)]
    assert run(spark, rows, length=length, key=key) == brute(rows, length)


def test_edges(spark):
    long = "".join(chr(97 + (i * i) % 26) + str(i) for i in range(1500))
    rows = [(None, None, None, None), (1, "", None, None), (2, "x" * 199, None, None), (3, "x" * 199, "k", 1), (None, long, None, None), (4, long[:400] + "ß" + long[600:], None, None), (5, long[50:251], None, None), (5, long[50:251], None, None)]
    assert run(spark, rows) == brute(rows, 200)
    assert run(spark, []) == []


def test_texts_without_repeats(spark):
    rnd = random.Random(9)
    part = "".join(rnd.choice("aéß ") for _ in range(150))
    rows = [(1, "x" + part + "y", "k", 1), (2, "éé" + part, None, None), (None, None, "n", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars int")
    out = {r["doc_id"]: r for r in without_repeats(docs).collect()}
    assert out[1].asDict() == {"doc_id": 1, "text": "xy", "kept": "k", "n_chars": 2}
    assert out[2]["text"] == "éé" and out[None].asDict() == {"doc_id": None, "text": "", "kept": "n", "n_chars": 0}
