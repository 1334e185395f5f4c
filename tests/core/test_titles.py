"""Titles' similarity over whole texts, by brute force."""

import re
from difflib import SequenceMatcher

from lexigrid.plans import record_queries


def test_whole_texts_of_one_key_are_compared(spark, tmp_path):
    long = "deep vein clot " * 30
    left = [(1, long + "end"), (2, " "), (3, "Other"), (4, None), (9, "no partner")]
    right = [(1, "x " + long), (2, "text"), (3, "OTHER."), (4, "y"), (7, "alone")]
    spark.createDataFrame(left, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(right, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def plain(text):
        return re.sub(r"[^a-z0-9 ]+", "", " ".join((text or "").lower().split()))

    def ratio(a, b):
        a, b = plain(a), plain(b)
        return round(SequenceMatcher(None, a, b).ratio(), 6) if a.strip() and b.strip() else 0.0

    texts = dict(right)
    got = record_queries.title_similarity_match(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, i, ratio(a, texts[i])) for i, a in left if i in texts]
