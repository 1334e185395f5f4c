import random

import sentencepiece

from lexigrid.llm.sentencepiece_codec import default_model
from lexigrid.llm.token_counts import count_lengths, length_quantile, length_table, truncated_total


def test_answers_every_limit(spark):
    rnd = random.Random(2)
    texts = ["the of and x" * rnd.choice([0, 1, 2, 5, 40]) for _ in range(60)] + [None, "", "word " * 3000, "word " * 3000]
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    lengths = [len(sp.encode(t or "")) for t in texts]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    table = length_table(count_lengths(docs)).cache()
    assert {r["n_tokens"]: r["n_docs"] for r in table.collect()} == {n: lengths.count(n) for n in set(lengths)}
    for r in table.collect():
        n = r["n_tokens"]
        assert (r["docs_up_to"], r["docs_over"], r["tokens_over"]) == (sum(x <= n for x in lengths), sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert (r["truncated_total"], r["total_docs"], r["total_tokens"]) == (sum(min(x, n) for x in lengths), len(lengths), sum(lengths))
    for limit in (0, 1, 7, 100, 2048, 10**6):
        assert truncated_total(table, limit) == sum(min(x, limit) for x in lengths)
    for share in (0.0, 0.25, 0.5, 1.0):
        assert length_quantile(table, share) == min(x for x in lengths if sum(y <= x for y in lengths) >= share * len(lengths))
    assert length_table(count_lengths(docs.limit(0))).count() == 0
