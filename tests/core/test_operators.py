"""Golden orders, edges and budgets of the retrieval and evaluation operators."""

import json
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexigrid.functions import dates, ids, similarity, status, text
from lexigrid.operators import answers, assembly, chunking, evaluation, ingest, ranking, retrieval, schedules


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("written", "found"), [("see https://doi.org/10.1234/AbC).", "10.1234/abc"), ("nothing", ""), (None, ""), ("10.12/short", "")])
def test_canonical_doi(spark, written, found):
    assert one(spark, text.canonical_doi(F.lit(written).cast("string"))) == found


def test_text_functions(spark):
    assert one(spark, text.truncated(F.lit("  abcdefgh "), 6)) == "abc..."
    assert one(spark, text.truncated(F.lit("ab"), 2)) == "ab"
    assert one(spark, text.section_title(F.lit("materials AND methods"))) == "Materials and Methods"
    assert one(spark, text.section_weight(F.lit(None).cast("string"))) == 1.0
    assert one(spark, text.canonical_name(F.lit("History of  VTE"))) == "prior vte"
    assert one(spark, text.canonical_name(F.lit("Other One"))) == "Other One"
    assert one(spark, text.squeeze(F.lit("a b  c"))) == "a b c"
    assert one(spark, similarity.ratio(F.lit("Deep vein."), F.lit("deep VEIN"))) == 1.0
    assert one(spark, similarity.ratio(F.lit(" "), F.lit(" "))) == 0.0


def test_uuid5(spark):
    import uuid

    space = uuid.UUID(ids.NAMESPACE)
    assert one(spark, ids.point_id(F.lit("dé"), F.lit(3))) == str(uuid.uuid5(space, "dé:3"))


def test_status(spark):
    assert one(spark, status.query_status(F.lit(0), F.lit(0))) == "SUCCESS"
    assert one(spark, status.query_status(F.lit(2), F.lit(2))) == "FAILED"
    assert one(spark, status.retry_after(F.lit(2), F.lit(3))) == 10
    assert one(spark, F.date_format(dates.next_run(F.to_timestamp(F.lit("2024-05-01 19:00:00")), F.array(F.lit("06:00"), F.lit("19:00"))), "dd HH:mm")) == "02 06:00"


def test_filters():
    with pytest.raises(ValueError, match="unknown filters: a, b"):
        retrieval.compile_filters({"b": 1, "a": 2})


def test_knn_ties_and_empty(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    c = spark.createDataFrame([(9, [2.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [0.0, 0.0]), (7, None)], "point_id long, vector array<double>")
    assert [(r["point_id"], r["rank"]) for r in retrieval.knn(q, c, 3).orderBy("rank").collect()] == [(3, 1), (9, 2), (5, 3)]
    assert retrieval.knn(q, c, 0).count() == 0 and retrieval.knn(q, c.limit(0), 3).count() == 0
    near = retrieval.knn(q, c, 1, "euclid").first()
    assert (near["point_id"], near["score"]) == (3, 0.0)


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double, chunk_text string, section string")


@pytest.mark.parametrize("group", [2048, 16])
def test_knn_euclid_copies_and_groups(spark, monkeypatch, group):
    monkeypatch.setattr(retrieval, "QUERY_GROUP", group)
    rnd = random.Random(2)
    vectors = [[rnd.uniform(-1, 1) for _ in range(16)] for _ in range(3000)]
    # copies in one large batch: 40 * 6000 pairs
    c = spark.createDataFrame([(i + 9000 * copy, v) for copy in (1, 0) for i, v in enumerate(vectors)], "point_id long, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(i, vectors[i * 7]) for i in range(40)], "query_id long, vector array<double>")
    out = retrieval.knn(q, c, 1, "euclid")
    assert sorted((r["query_id"], r["point_id"], r["score"]) for r in out.collect()) == [(i, i * 7, 0.0) for i in range(40)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("named", [int, "p{:03}".format])
def test_knn_of_many_ties_over_small_batches(spark, distance, named):
    rnd = random.Random(5)
    draw = lambda: [float(rnd.randint(-2, 2)) for _ in range(3)]
    asked, known = [(i, draw()) for i in range(30)], [(named(i), draw()) for i in rnd.sample(range(900), 400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        out = retrieval.knn(spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(known, f"point_id {'long' if named is int else 'string'}, vector array<double>").coalesce(2), 7, distance).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def score(a, b):
        dot, sizes = sum(x * y for x, y in zip(a, b, strict=True)), sum(x * x for x in a) * sum(x * x for x in b)
        return {"dot": dot, "euclid": -math.dist(a, b), "cosine": dot / math.sqrt(sizes) if sizes else None}[distance]

    expected = []
    for i, a in asked:
        scored = sorted((-round(s, 9), p) for p, b in known if (s := score(a, b)) is not None)[:7]
        expected += [(i, p, -s, n) for n, (s, p) in enumerate(scored, 1)]
    assert sorted((r["query_id"], r["point_id"], r["score"], r["rank"]) for r in out) == sorted(expected)


def test_knn_holds_few_scores_at_once(spark, monkeypatch):
    steps, kind = [], type(spark.range(1))
    keep = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, schema: steps.append(f) or keep(self, f, schema))
    rng = np.random.default_rng(3)
    asked, known = rng.normal(size=(1000, 8)), rng.normal(size=(8000, 8))
    retrieval.knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<double>"), spark.createDataFrame([], "point_id long, vector array<double>"), 5)
    batch = pd.DataFrame({"point_id": range(8000), "vector": list(known)})
    tracemalloc.start()
    out = pd.concat(steps[0](iter([batch, batch.assign(point_id=batch.point_id + 8000)])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6  # all scores of a batch are 64 MB, of which several copies were held
    scores = asked @ known.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(known, axis=1)
    assert (np.sort(out.sort_values("query_id").score.to_numpy().reshape(1000, 5)) == np.round(np.sort(np.repeat(scores, 2, axis=1))[:, -5:], 9)).all()


def test_rerank_orders(spark):
    q = spark.createDataFrame([(1, "deep clot")], "query_id long, question string")
    same = candidates(spark, [(1, "c1", 0.9, "deep clot", "Methods"), (1, "c2", 0.8, "deep clot", "Results")])
    assert [r["chunk_id"] for r in ranking.rerank(same, q).orderBy("rank").collect()] == ["c2", "c1"]
    lexical = candidates(spark, [(1, "c1", 0.9, "other words", None), (1, "c2", 0.1, "deep clot", None)])
    assert [r["chunk_id"] for r in ranking.rerank(lexical, q, {"dense": 0.1, "lexical": 1.0}).orderBy("rank").collect()] == ["c2", "c1"]


def test_union_keeps_question_on_ties(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id long, chunk_id string, score double, t string")
    out = ranking.union_candidates(make([(1, "a", 0.5, "q"), (1, "b", 0.2, "q")]), make([(1, "a", 0.5, "h"), (1, "b", 0.9, "h"), (1, "c", 0.1, "h")]))
    assert sorted((r["chunk_id"], r["t"], r["origin"]) for r in out.collect()) == [("a", "q", "both"), ("b", "h", "both"), ("c", "h", "hyde")]


def test_bm25_value(spark):
    q = spark.createDataFrame([(1, "Clot clot x")], "query_id long, question string")
    got = ranking.bm25(candidates(spark, [(1, "a", 0.0, "clot clot vein", None), (1, "b", 0.0, "vein", None)]), q).collect()
    assert len(got) == 1 and math.isclose(got[0]["bm25"], math.log((2 - 1 + 0.5) / 1.5 + 1) * (2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2))))


def test_overlap_text(spark):
    rows = [("d", 0, 5, 0, "hello"), ("d", 3, 8, 1, "lowor"), ("d", 4, 6, 2, "ow"), ("d", 8, -1, 3, "ld")]
    df = spark.createDataFrame(rows, "doc_id string, start int, end int, chunk_index int, chunk_text string").withColumn("chunk_id", F.col("chunk_index").cast("string")).withColumn("section", F.lit(None).cast("string"))
    out = assembly.assemble(df, ["doc_id"]).first()
    assert (out["text"], out["chunk_ids"], out["sections"]) == ("helloworld", ["0", "1", "2", "3"], [])


def test_pack_context_budget(spark):
    rows = [(1, 1, "a", "", "x" * 30), (1, 2, "b", "S", "y" * 500), (1, 3, "c", "", "z"), (1, 4, " ", "", "w")]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, section string, chunk_text string")
    whole = assembly.pack_context(df, 10_000).first()
    assert whole["chunk_ids"] == ["a", "b", "c"]
    cut = assembly.pack_context(df, 120).first()
    assert cut["chunk_ids"] == ["a", "b"] and cut["n_chars"] == 120 and "..." in cut["context"]
    exact = len("\nCHUNK a\n") + 30 + len("\nENDCHUNK\n")
    assert assembly.pack_context(df, exact).first()["n_chars"] == exact
    assert assembly.pack_context(df, 10_000, max_chunks=1).first()["chunk_ids"] == ["a"]


def test_fixed_windows(spark):
    got = one(spark, chunking.fixed_windows(F.lit("abcdefgh"), 4, 10))
    assert [(c["index"], c["text"], c["start"], c["end"]) for c in got] == [(0, "abcd", 0, 4), (1, "defg", 3, 7), (2, "gh", 6, 8)]
    assert one(spark, chunking.fixed_windows(F.lit("  "), 4, 1)) is None


@pytest.mark.parametrize(
    ("body", "size", "expected"),
    [
        ("  \n ", 5, []),
        ("Methods\n\nWe did.\n\nResults\n\nIt worked.", 200, [("Methods", "We did."), ("Results", "It worked.")]),
        ("Results\n\nIt worked.\n\nReferences\n\n1. A.", 200, [("Results", "It worked.")]),
        ("BACKGROUND: a b\nMETHODS: c d\nRESULTS: e f", 500, [("Background", "a b"), ("Methods", "c d"), ("Results", "e f")]),
        ("Results", 50, []),
        ("a lower case sentence here", 50, [(None, "a lower case sentence here")]),
    ],
)
def test_section_chunks(body, size, expected):
    assert [(c["section"], c["text"]) for c in chunking.Sections(size=size, overlap=0).chunks(body)] == expected


def test_section_chunks_split(spark):
    cut = chunking.Sections(size=80, overlap=0)
    out = chunking.chunk_table(spark.createDataFrame([(1, "Results\n\n" + "a" * 120 + "\n\n" + "b" * 120)], "doc_id int, text string"), sections=cut).collect()
    assert len(out) >= 2 and {r["section"] for r in out} == {"Results"}


def test_metrics_golden(spark):
    order = ["d1", "d2", "d3", "d1", *(f"d{i}" for i in range(4, 11))]
    rows = [("direct", "q1", d, i + 1, i + 1) for i, d in enumerate(order)] + [("direct", "q2", f"z{i}", i, i) for i in range(1, 11)]
    qrels = [("q1", f"d{i}", {1: 2, 2: 1}.get(i, 0)) for i in range(1, 11)] + [("q2", f"z{i}", 0) for i in range(1, 11)]
    out = evaluation.query_metrics(spark.createDataFrame(rows, "mode string, query_id string, doc_id string, rank int, line int"), spark.createDataFrame(qrels, "query_id string, doc_id string, relevance int"))
    got = {r["query_id"]: r.asDict() for r in out.collect()}
    assert (got["q1"]["depth"], got["q1"]["mrr"], got["q1"]["p@5"], got["q1"]["recall@5"], got["q1"]["ndcg@10"]) == (10, 1.0, 0.4, 1.0, 1.0)
    assert (got["q2"]["mrr"], got["q2"]["p@10"], got["q2"]["recall@5"], got["q2"]["ndcg@5"]) == (0.0, 0.0, None, None)
    with pytest.raises(ValueError, match="positive"):
        evaluation.valid_ks([0, 5])


def test_identity_is_required(spark):
    rows = spark.createDataFrame([("q", " ", None, "10.1/x", None)], "query_id string, doc_id string, pmid string, doi string, chunk_id string")
    assert rows.select(evaluation.resolved_id().alias("i")).first()["i"] == "10.1/x"
    with pytest.raises(PySparkException, match="no identifier"):
        rows.withColumn("doi", F.lit("")).select(evaluation.resolved_id()).collect()


def test_extraction_golden(spark):
    make = lambda rows, c: spark.createDataFrame(rows, f"key string, {c} array<string>")
    rows = evaluation.extraction_rows(make([("q1", ["obesity", "hypertension"]), ("q2", ["prior vte", "smoking"])], "predicted"), make([("q1", ["obesity", "smoking"]), ("q2", ["prior vte"])], "gold"))
    s = evaluation.extraction_summary(rows).first()
    assert (s["micro_precision"], round(s["micro_recall"], 6), round(s["micro_f1"], 6)) == (0.5, 0.666667, 0.571429)


def test_answers_are_grounded(spark):
    good = json.dumps({"answer": {"summary": "s", "risk_factors": [{"name": "DM", "citations": ["zz"], "rank": "2", "confidence": "0.5"}] * 9}, "citations": ["c1", {"chunk_id": "c2"}, "no"]})
    rows = [("a", f"Sure: {good} ok", ["c1", "c2", "c3"]), ("b", "{broken", ["c1"]), ("c", "  ", ["c1"]), ("d", "no json", ["c1"]), ("e", '{"answer": {"summary": NaN}}', [])]
    out = {r["request_id"]: r for r in answers.ground(spark.createDataFrame(rows, "request_id string, raw string, allowed array<string>")).collect()}
    a = out["a"]
    assert a["grounded"] and len(a["factors"]) == 8 and a["factors"][0]["normalized_name"] == "diabetes" and a["factors"][0]["citations"] == ["c1", "c2"] and a["factors"][0]["rank"] == 2
    assert a["citations"] == ["c1", "c2"] and answers.BACKFILLED in a["limitations"] and any("only 2 unique" in x for x in a["limitations"])
    assert [out[k]["code"] for k in "bcd"] == ["truncated_json", "llm_empty_output", "invalid_json"]
    assert out["e"]["code"] == "" and not out["e"]["grounded"] and out["e"]["summary"] == answers.NO_SUMMARY and out["e"]["limitations"] == [answers.UNGROUNDED]


def test_upsert_is_idempotent(spark):
    index = spark.createDataFrame([("p1", 1), ("p2", 2)], "point_id string, v int")
    new = spark.createDataFrame([("p2", 5, 1), ("p2", 6, 2), ("p3", 7, 1)], "point_id string, v int, position int")
    once = ingest.upserted(index, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ingest.upserted(once, new).collect())) == [("p1", 1), ("p2", 6), ("p3", 7)]


def test_scheduler_outcomes(spark):
    enq = spark.createDataFrame([("10.1/A",), ("10.1/b",), ("10.1/c",)], "doi string")
    items = spark.createDataFrame([(" 10.1/a ", "failed", "x", 1), ("10.1/A", "succeeded", None, 2), ("10.1/b", "skipped_duplicate", None, 1)], "doi string, state string, message string, position int")
    assert sorted((r["doi"], r["status"]) for r in schedules.doi_outcomes(enq, items).collect()) == [("10.1/A", "SUCCEEDED"), ("10.1/b", "SKIPPED_EXISTS"), ("10.1/c", "ENQUEUED")]
