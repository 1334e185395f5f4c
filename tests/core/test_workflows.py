import json

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import ports
from lexigrid.plans import workflows
from lexigrid.streaming import registry


def chunks(spark):
    rows = [(f"c{i}", f"d{i // 2}", t, None, i % 2, 0, len(t)) for i, t in enumerate(["deep vein clot", "risk of clot", "apples and pears", "bread", "the weather", "clot weather"])]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_text string, section string, chunk_index int, start int, end int")
    return df.withColumn("vector", ports.embed(F.col("chunk_text")))


def test_search_and_ask(spark):
    queries = spark.createDataFrame([(1, "deep  vein clot"), (2, "apples")], "query_id long, question string")
    found = workflows.search(queries, chunks(spark), top_k=2).orderBy("query_id", "doc_rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in found][:1] == [(1, "d0")] and (2, "d1") in [(r["query_id"], r["doc_id"]) for r in found]
    assert found[0]["chunk_ids"] == ["c0", "c1"]
    packed = workflows.ask_contexts(queries, chunks(spark), queries.select("query_id", F.lit("weather").alias("text")), final=3)
    assert {r["query_id"]: len(r["chunk_ids"]) for r in packed.collect()} == {1: 3, 2: 3}

    def model():
        return lambda prompts: [json.dumps({"answer": {"summary": "s"}, "citations": ["c0", "zz"]}) for _ in prompts]

    out = {r["request_id"]: r for r in workflows.answer(packed, queries, model, chunks(spark)).collect()}
    assert out[1]["grounded"] and out[1]["citations"] == ["c0"]


def test_judging_round(spark):
    rows = [("q", d, i + 1, f"t{d}") for i, d in enumerate("abc")]
    make = lambda r: spark.createDataFrame(r, "query_id string, doc_id string, rank int, title string")
    direct, hyde = make(rows), make(rows[::-1])
    with pytest.raises(ValueError, match="not 5"):
        workflows.prepare_judging(direct, hyde, 5)
    pool = workflows.prepare_judging(direct, hyde, 3)
    assert pool.count() == 3
    judged = pool.withColumn("row", F.lit(2)).withColumn("relevance", F.when(F.col("doc_id") == "b", "2").otherwise("0")).withColumn("rationale", F.lit("why"))
    ranking = direct.select(F.lit("direct").alias("mode"), "query_id", "doc_id", "rank", F.col("rank").alias("line"))
    got = workflows.finish_judging(judged, pool, ranking, (2,)).first()
    assert (got["mrr"], got["p@2"]) == (0.5, 0.5)
    with pytest.raises(ValueError, match="relevance must be"):
        workflows.finish_judging(judged.withColumn("relevance", F.lit("7")), pool, ranking)


def test_registry_and_retention(spark):
    events = [("d", "reserve", "a", 1), ("d", "reserve", "b", 2), ("d", "commit", "b", 3), ("d", "commit", "a", 4), ("d", "reserve", "b", 5), ("d", "delete", "b", 6), ("d", "reserve", "b", 7), ("d", "release", "b", 8), ("e", "delete", "a", 1)]
    df = spark.createDataFrame(events, "doc_id string, action string, owner string, at long").withColumn("at", F.timestamp_seconds("at"))
    out = [r["outcome"] for r in registry.replay(df).orderBy("doc_id", "at").collect()]
    assert out == ["reserved", "reserved_by_other", "not_reserved", "committed", "already_indexed", "deleted", "reserved", "released", "not_found"]
    jobs = spark.createDataFrame([("a", None, 9000), ("b", 100, 9000), ("c", 8000, 9000), ("d", 8500, 9000)], "job_id string, c long, n long").select("job_id", F.timestamp_seconds("c").alias("completed_at"), F.timestamp_seconds("n").alias("now"))
    assert sorted(r["job_id"] for r in registry.retained(jobs, 1, 1).collect()) == ["a", "d"]


def test_registry_stream(spark, tmp_path):
    df = spark.createDataFrame([("d", "reserve", "a", 1), ("d", "commit", "a", 2)], "doc_id string, action string, owner string, at long").withColumn("at", F.timestamp_seconds("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = registry.track(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["committed", "reserved"]
