import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from lexigrid.llm.filter_audit import audit_filters, order_table, subset_counts, text_flags

WORDS = re.compile("[^\x20\x09-\x0d]+")


def fails(rows, k):
    doc_id, text, *_ = rows[k]
    text = text or ""
    w = WORDS.findall(text)
    first = any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)
    return {x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), first), strict=True) if bad}


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for k, row in enumerate(rows):
        parts[row[2] or ""].append((row[0], fails(rows, k)))
    out = []
    for part, docs in parts.items():
        own, shapley = [], defaultdict(int)
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                alive = [d for d in docs if not d[1] & set(order[: step - 1])]
                removed = [d for d in alive if x in d[1]]
                shapley[x] += len(removed)
                own.append((part, "".join(order), step, len(alive) - len(removed), len(removed), sum(x in f for _, f in docs) - len(removed), sum(f == {x} for _, f in docs), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in own]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "B", "cc", "#", "é", *(f"w{i}" for i in range(n))], k=rng.choice([5, 220]))) for n in (1, 400, 400, 400) for _ in range(8)]
    texts += ["", None, "A" * 50_000, "\x0b\x1c word", " ".join(f"w{i}" for i in range(300))]
    rows = [(i, rng.choice(texts), rng.choice(["x", "y", "", None]), i, "kept") for i in range(150)]
    rows += [rows[7], (None, texts[0], "x", 0, ""), (None, None, None, 0, None), (-5, texts[-1], "z", 1, None)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    out = audit_filters(spark.createDataFrame(rows, "doc_id long, text string, source string, flags long, part string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert tuple(out.columns) == COLUMNS
    assert sorted(map(tuple, out.collect())) == brute([r[:3] for r in rows], labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(docs.limit(0), labels).count() == 0
    assert audit_filters(docs, labels).where("part = ''").count() == 600


def test_words_are_cut_at_ascii_white_space_only():
    assert text_flags(" ".join(["a\x1cb", "c d"] * 100)) & 1 == 0  # 200 words
    assert text_flags(None) == 1 and text_flags("") == 1


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_bitmaps_of_any_length(spark, n):
    rng = np.random.default_rng(n)
    rows = [(f"p{rng.integers(3)}", int(rng.integers(8)), bool(rng.integers(2)), bool(rng.integers(2))) for _ in range(n)]
    df = spark.createDataFrame(rows, "part string, flags int, good boolean, toxic boolean")
    got = {r["part"]: (r["kept"], r["good"], r["toxic"]) for r in subset_counts(df, 3).collect()}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        assert got[part] == tuple([sum(not f & s and on(r) for r in own for f in [r[1]]) for s in range(8)] for on in (lambda r: True, lambda r: r[2], lambda r: r[3]))
    assert set(got) == {r[0] for r in rows}
    assert order_table(subset_counts(df, 3), "XYZ").count() == 18 * len(got)
