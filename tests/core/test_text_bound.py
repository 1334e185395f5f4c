import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import chunking, evaluation


@pytest.mark.parametrize("size, overlap", [(1200, 150), (10, 3), (10, 9), (7, 7), (5, 0), (1, 0), (4, 20)])
def test_windows_equal_slices(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choices(["a", "é", "漢", "\U0001f600", " ", "\n", " "], k=rng.randint(0, 60))) for _ in range(60)] + ["", "  ", None, "x" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.inline(chunking.fixed_windows(F.col("text"), size, overlap))).collect()
    step = max(1, size - (overlap if overlap < size else size // 4))
    expected = []
    for k, text in enumerate(texts):
        t = (text or "").strip()
        starts = [] if not t else range(0, max(0, -(-(len(t) - size) // step)) * step + 1, step)
        expected += [(k, i, t[s : s + size], s, min(s + size, len(t))) for i, s in enumerate(starts)]
    assert sorted(map(tuple, rows)) == expected


def test_windows_of_a_long_text_take_linear_time(spark):
    df = spark.createDataFrame([("abcdé fgh " * 300_000,)], "text string")
    assert df.select(F.size(chunking.fixed_windows(F.col("text")))).first()[0] == 2857


def test_aliases_in_the_plan_and_in_a_join_find_the_same(spark, monkeypatch):
    rng = random.Random(8)
    words = ["deep", "vein", "clot", "a", "b", "hip"]
    texts = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(200)], "key int, text string")
    aliases = spark.createDataFrame([("dvt", "deep vein clot"), ("dvt", "vein clot"), ("hip", "hip"), ("x", "a b a"), ("y", "clo"), ("z", ""), (None, "deep")], "canonical string, alias string")
    planned = sorted(map(str, evaluation.alias_hits(texts, aliases).collect()))
    monkeypatch.setattr(evaluation, "ALIASES", 2)
    assert planned == sorted(map(str, evaluation.alias_hits(texts, aliases).collect())) and len(planned) > 50
    assert evaluation.alias_hits(texts, aliases.limit(0)).count() == 0


def test_chunks_of_a_large_batch_are_made_in_parts(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "Results\n\n" + "long " * 500_000] + ["Methods\n\n" + "word é " * rng.randint(0, 900) for _ in range(3000)]
    cut = chunking.Sections()
    batch, sizes = pa.array(texts).slice(1), []
    made = [x for part in chunking.in_parts(iter([batch]), cut.chunks, chunking.CHUNK_ARROW) for x in (sizes.append((len(part), part.nbytes)), part)[1].to_pylist()]
    assert made == [cut.chunks(t) for t in texts[1:]] and sum(n for n, _ in sizes) == len(batch)
    assert len(sizes) > 5 and all(n == 1 or size < 2 * chunking.PART for n, size in sizes)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    got = df.select("k", chunking.section_chunks(F.col("text")).alias("c"), chunking.sentence_chunks(F.col("text")).alias("s")).orderBy("k").collect()
    assert [[c.asDict() for c in r["c"]] for r in got] == [cut.chunks(t) for t in texts]
    assert [len(r["s"]) for r in got[:3]] == [0, 0, 0] and all(r["s"] for r in got[4:] if texts[r["k"]].strip())
