import hashlib
import random
import re

import pytest

from lexigrid.llm import fill_in_middle as fim
from lexigrid.llm.fill_in_middle import Rates, Units, digest_outputs, fill_in_middle, restore_texts, restored, transformed

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
ALPHABET = ["a", "Z", "word", " ", "\n", "é", "漢", "\U0001f600", "<", ">", "<P>", "<S", "M>", "9", "-", "\0", " "]


def brute(doc_id, text):
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def some_texts(n, most=40):
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("span", [1, 2, 3, 7, 1 << 20])
def test_units_equal_a_scan(monkeypatch, span):
    monkeypatch.setattr(fim, "SPAN", span)
    for text in some_texts(300):
        units, found = UNIT.findall(text), Units(text)
        assert found.n == len(units) and found.marked == any(s in text for s in ("<P>", "<S>", "<M>"))
        assert [found.end_of(k) for k in range(found.n + 1)] == [len("".join(units[:k])) for k in range(found.n + 1)]


def test_outputs_and_their_texts(spark):
    texts = [*some_texts(400), None, "", "x" * 300_000, "<P>", "plain words only " * 20_000]
    rows = [(i, t, "psm", i) for i, t in enumerate(texts)] + [(3, texts[3], None, 0), (None, "null id", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output long")
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(((i, *brute("" if i is None else i, t or "")) for i, t, *_ in rows), key=str)
    back = restore_texts(out).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, t or "")) for i, t, *_ in rows)
    digests = {r["doc_id"]: r for r in digest_outputs(docs).where("doc_id IS NOT NULL").collect()}
    for i, t in enumerate(texts):
        assert digests[i]["output_sha256"] == hashlib.sha256(brute(i, t or "")[4].encode()).hexdigest()
        assert digests[i]["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_all_forms_come_back():
    forms = set()
    for i, text in enumerate(some_texts(500)):
        _, form, _, _, output = transformed(i, text, Rates(100, 50, "other"))
        forms.add(form)
        assert restored(output, form) == text
    assert forms == {"plain", "psm", "spm"}
