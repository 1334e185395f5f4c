import random
import re

import sentencepiece
import zstandard

from lexigrid.llm.quality_rules import Bands, duplicate_lines, keep_documents, rate_documents, repeated_words
from lexigrid.llm.sentencepiece_codec import codec, default_model, encode_documents

SCHEMA = "doc_id long, text string, n_words string, kept string"


def test_codec_matches_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    rnd = random.Random(1)
    alphabet = "aaabbetionsthr   ▁\n\t.,!éèüß日本\U0001f600\x00xX1290-_/\"'#*|"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(3000)] + [" " * n + "x" + " " * n for n in range(50)] + ["a" * 300, "the" * 2000, "", " ", "<s> </s> <unk> <0x41>"]
    c = codec(default_model())
    for t in texts:
        assert c.encode(t) == library.encode(t)
        assert c.decode(c.encode(t)) == library.decode(library.encode(t))
    rows = [(i, t.replace("\x00", ""), "n", None) for i, t in enumerate(texts[:50])] + [(None, None, None, None), (1, "", None, None)]
    out = encode_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in out] == [(r[0], library.encode(r[1] or ""), library.decode(library.encode(r[1] or ""))) for r in rows]
    assert encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_repeats(w):
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)}
    return len(covered)


def test_repeated_words():
    rnd = random.Random(2)
    for _ in range(200):
        w = [b"%d" % rnd.randint(0, rnd.choice([1, 2, 5, 400])) for _ in range(rnd.randint(0, 90))]
        assert repeated_words(w) == plain_repeats(w)


def test_rules(spark):
    prose = " ".join(f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "lanto mirel senuk varop tasin".split())
    rnd = random.Random(4)
    noise = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(5000))
    rows = [(1, prose, None, None), (2, "one two\n" * 90, None, None), (3, None, None, None), (4, "", None, None), (5, " ".join(noise[i : i + 50] for i in range(0, 5000, 50)), "x", None), (6, "la" * 4000 + " a b c d e f g h i j", None, None)]
    got = {r["doc_id"]: r for r in rate_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"]
    assert got[2]["base_failed"] and got[2]["n_dup_lines"] == 89 and got[2]["n_repeat_words"] == 180
    assert (got[3]["n_words"], got[3]["base_failed"], got[3]["kept"], got[3]["whole_ratio"]) == (0, True, False, None)
    assert not got[5]["base_failed"] and not got[5]["kept"]  # incompressible
    assert not got[6]["base_failed"] and not got[6]["kept"]  # one word of repeats
    kept = keep_documents(spark.createDataFrame(rows, SCHEMA), Bands())
    assert kept.columns == ["doc_id", "text", "n_words", "kept"] and [r["doc_id"] for r in kept.collect()] == [1]
    assert rate_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert duplicate_lines("a\n\nb\na\n \n ") == 1


def plain_rating(text):
    """All columns of rate_documents(), each by its definition."""
    text, bands = text or "", Bands()
    raw = text.encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    chars = len(re.findall(r"[^\x20\x09-\x0D]", text))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = plain_repeats(w)
    failed = len(w) < 10 or 100 * repeats > 20 * len(w)
    ratio = lambda x: len(zstandard.ZstdCompressor(level=bands.level).compress(x)) / len(x)

    def band(n):
        return max((b for b in bands.whole if b[0] <= n), default=None)

    def inside(x):
        b = band(len(x))
        return b is None or b[1] <= ratio(x) <= b[2]

    chunks = [raw[a : a + bands.chunk_bytes] for a in range(0, len(raw), bands.chunk_bytes)] if len(raw) >= bands.chunk_bytes else []
    chunks = [c for c in chunks if len(c) >= bands.whole[0][0]]
    bad = sum(not (bands.chunk[0] <= ratio(c) <= bands.chunk[1] if len(c) == bands.chunk_bytes else inside(c)) for c in chunks)
    kept = not failed and inside(raw) and (bad == 0 or bad < bands.bad_share * len(chunks))
    return len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats, failed, kept, ratio(raw) if raw else None, len(chunks), bad


def test_all_columns_by_brute_force(spark):
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzé#*$ \n\t\x0b\x1c\u00a0日"
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(n))
    prose = lambda n: " ".join("".join(rnd.choice("aeilnorst") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 900))) for _ in range(60)]
    texts += [prose(n) for n in (5, 9, 10, 30, 90, 500, 900, 1700, 3000)]
    texts += [prose(700)[:4096] + noise(4000), prose(700)[:4096] + "ab " * 1300, noise(200), noise(5000), prose(30) + " " + prose(8) * 3, "line one\nline one\n\nx", None, "", prose(700)[:4096] + "x" * 100, "x" * 300_000]
    texts += texts[60:64]  # repeated rows
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)]
    out = {r["doc_id"]: tuple(r)[1:] for r in rate_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        assert out[i] == plain_rating(t), (i, out[i], plain_rating(t))
    assert {r[6] for r in out.values()} == {True, False}
