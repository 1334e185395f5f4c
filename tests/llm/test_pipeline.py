"""The pipeline against plain Python, stage by stage, on a small table."""

import random

import sentencepiece

import corpus_pipeline
from lexigrid.llm.quality_rules import Bands, Rater
from lexigrid.llm.sentencepiece_codec import default_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def cut_repeats(texts, length=200):
    raws = [t.encode() for t in texts]
    count = {}
    for raw in raws:
        for p in range(len(raw) - length + 1):
            count[raw[p : p + length]] = count.get(raw[p : p + length], 0) + 1
    out = []
    for t, raw in zip(texts, raws):
        gone = set()
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1:
                gone |= set(range(p, p + length))
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if gone.isdisjoint(range(at, at + n)):
                kept.append(c)
            at += n
        out.append("".join(kept))
    return out


def test_stages(spark, tmp_path):
    rnd = random.Random(6)
    words = lambda n: " ".join("".join(rnd.choice("abcdeéfghilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    passage = words(60)
    rows = []
    for i in range(60):
        text = words(rnd.randint(40, 120))
        if i % 6 == 0:
            text = f"{text}\n{passage}\n{words(40)}"
        if i % 10 == 9:
            text = rows[i - 2][1] if i % 20 == 9 else rows[i - 2][1] + " end"
        if i % 15 == 14:
            text = "again and again " * 60
        rows.append((i, text, "en", f"s{i % 3}" if i % 2 else "s0", len(text)))
    rows += [(100, None, None, None, 0), (101, "", "x", "s1", 0), (102, "too short", "x", None, 9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        out.append({r["doc_id"]: r for r in docs.collect()})

    rater = Rater(Bands())
    kept = {r[0]: r[1] for r in rows if rater.rate(r[1])[6]}
    assert out[0].keys() == kept.keys() and 100 not in kept and 14 not in kept
    sets = {i: shingles(t) for i, t in kept.items()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    first = {i for i in kept if not any(j < i and near(i, j) for j in kept)}
    assert out[1].keys() == first and len(first) < len(kept)
    cut = dict(zip(sorted(first), cut_repeats([kept[i] for i in sorted(first)])))
    assert {i: r["text"] for i, r in out[2].items()} == cut and any(len(cut[i]) < len(kept[i]) for i in first)
    assert all(r["n_chars"] == len(r["text"]) for r in out[2].values())
    assert {i: tuple(r) for i, r in out[3].items()} == {i: tuple(r) for i, r in out[2].items()}
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    assert {i: r["ids"] for i, r in out[4].items()} == {i: library.encode(t) for i, t in cut.items()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(first)
