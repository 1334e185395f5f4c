import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexigrid.functions.ids import document_id
from lexigrid.operators import answers, documents

INDEX = "point_id string, doi_text string, chunk_index int, text string, section string, doi_original string, doi string, doi_normalized string, authors array<string>, journal string, year int, disease string, source_type string, title string, updated_at string, created_at string"


def test_lookup(spark):
    x = "10.1000/xyz123"
    rows = [
        ("c1", x, 1, "world", "Results", x, None, x, None, None, None, None, None, None, None, "2026-01-18T14:32:05Z"),
        ("c0", x, 0, "hello", "Introduction", "10.1000/XYZ123", None, x, ["A"], "J", 2020, "cancer", "odd", "T", None, "2026-01-18T14:32:04Z"),
        ("a9", x, None, "no place", None, x, None, x, ["first"], "K", 2021, "flu", "full_text", None, "never", None),
        ("z", "10.1000/other", 0, "o", None, "", "10.1000/Other", "", None, None, None, None, None, None, None, None),
    ]
    index = spark.createDataFrame(rows, INDEX).withColumn("doc_id", document_id(F.col("doi_text")))
    requests = spark.createDataFrame([(1, "https://doi.org/10.1000/XYZ123."), (2, "not-a-doi"), (3, "10.1000/none"), (4, "10.1000/other"), (5, None), (6, x)], "request_id int, doi string")
    out = {r["request_id"]: r for r in documents.lookup_by_doi(requests, index, F.lit(datetime.datetime(2030, 1, 1)).cast("timestamp")).collect()}
    assert [out[k]["status"] for k in range(1, 7)] == ["found", "validation_error", "not_found", "found", "validation_error", "found"]
    r = out[1]
    assert r["chunk_ids"] == ["c0", "c1", "a9"] and [s["section"] for s in r["sections"]] == ["Introduction", "Results", None] and r["content_text"] == "hello\nworld" and r["chunk_total"] == 3
    # fields are the smallest point's; a topic that nobody knows is none
    assert (r["doi"], r["authors"], r["journal"], r["year"], r["disease"], r["source_type"], r["title"]) == (x, ["first"], "K", 2021, None, "full_text", None)
    assert r["updated_at"] == datetime.datetime(2026, 1, 18, 14, 32, 5) and out[4]["updated_at"] == datetime.datetime(2030, 1, 1) and out[4]["doi"] == "10.1000/Other"
    assert out[3]["chunk_ids"] is None and out[3]["doc_id"] is not None and out[2]["doc_id"] is None


FETCHED = "requested_doi string, requested_pmid string, found boolean, doi string, pmid string, full_text string, abstract string, title string, journal string, year int, authors array<string>"


def test_responses_and_items(spark):
    rows = [
        ("10.1/a", None, True, "10.1234/Full", "1", "whole text", "short", "Deep vein thrombosis", "J", 2020, ["A"]),
        (None, "2", True, None, "2", "", "an abstract on carcinoma", "T", None, None, None),
        (None, "3", True, None, None, None, " ", "T", None, None, None),
        (None, "4", False, None, None, None, None, None, None, None, None),
        ("10.5555/Req", None, True, "", "9", None, "abstract", None, None, None, None),
        (None, "6", True, "10.1234/z", "6", "  ", "abstract", None, None, None, None),
    ]
    out = documents.fetched_responses(spark.createDataFrame(rows, FETCHED))
    got = [(r["status"], r["resolved_doi"], r["resolved_pmid"], r["source_type"], r["content_text_source"], r["full_text_available"]) for r in out.collect()]
    none = ("not_found", None, None, None, None, None)
    assert got == [("ok", "10.1234/Full", "1", "full_text", "pmc", True), ("ok", None, "2", "pubmed_abstract", "abstract", False), none, none, ("ok", "10.5555/Req", "9", "pubmed_abstract", "abstract", False), none]
    items = documents.fetched_items(out).collect()
    assert [(i["doi_original"], i["doi_normalized"], i["disease"], i["source_type"], i["authors"]) for i in items] == [("10.1234/Full", "10.1234/full", "thrombosis", "full_text", ["A"]), ("pmid:2", "pmid:2", "cancer", "pubmed_abstract", []), ("10.5555/Req", "10.5555/req", "unknown", "pubmed_abstract", [])]


def test_index_file(spark):
    rows = spark.createDataFrame([(1, " 10.1/A ", "d1"), (2, "10.1/a", "d2"), (3, "10.1/b", "d3"), (4, " ", "d4"), (5, "10.1/b", "d3")], "line int, doi string, doc_id string")
    known, twice = documents.document_index(rows)
    assert sorted(map(tuple, known.collect())) == [("10.1/a", "d2"), ("10.1/b", "d3")] and [tuple(r) for r in twice.collect()] == [("10.1/a", 2)]


def test_answers_over_three_modes(spark):
    raw = {"citations": [{"snippet": " s1 "}, {"snippet": "", "text": "t2"}, {"content": 5}, "x"], "evidence": ["s1", {"content_text": "e"}, {"snippet": " ", "text": "hidden"}, 3], "contexts": ["c", " "]}
    made = [("a", "rag_no_hyde", json.dumps(raw), None, None), ("a", "rag_hyde", "{}", None, None), ("a", "llm_only", None, "text", None), ("b", "rag_no_hyde", "[]", None, None), ("b", "rag_hyde", None, None, "timeout"), ("b", "llm_only", None, "t", None), ("c", "rag_no_hyde", None, None, "down")]
    responses = spark.createDataFrame(made, "query_id string, mode string, raw string, text string, error string").withColumn("raw", F.parse_json("raw"))
    queries = spark.createDataFrame([("a", "Qa"), ("b", "Qb"), ("c", "Qc")], "query_id string, question string")
    rows = answers.answer_records(queries, responses)
    got = sorted((r["query_id"], r["mode"], r["contexts"], r["contexts_source"], r["answer_text"]) for r in rows.select("query_id", "mode", "contexts", "contexts_source", "answer_text").collect())
    assert got == [("a", "llm_only", [], "none", "text"), ("a", "rag_hyde", [], "ask", None), ("a", "rag_no_hyde", ["s1", "t2", "e", "c"], "ask", None), ("b", "rag_no_hyde", [], "ask", None)]
    assert tuple(answers.generation_failures(queries, responses).first()) == (3, 2)
    with pytest.raises(PySparkException, match="failed for all"):
        answers.generation_failures(queries.where("query_id <> 'a'"), responses).collect()
    with pytest.raises(ValueError):
        answers.answer_records(queries, responses, ("other",))
    fallback = spark.range(1).select(answers.fallback_answer(F.lit("truncated_json")).alias("f")).first()["f"]
    assert fallback["summary"] == answers.NO_SUMMARY and fallback["limitations"] == ["truncated_json"] and fallback["factors"] == [] and fallback["citations"] == []
