import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexigrid.sources import readers, writers
from lexigrid.streaming import jobs


def test_jsonl_names_the_bad_line(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"query_id": "q", "rank": 1, "doi": "doi:10.1/X"}\n\n{"query_id": "r", "rank": 2, "doi": "y", "score": 0.5}\n')
    bad.write_text('{"query_id": "q"}\n[1]\n')
    got = readers.read_pool(spark, str(good)).orderBy("line").collect()
    assert [(r["query_id"], r["score"], r["doi_norm"], r["line"]) for r in got] == [("q", 0.0, "10.1/x", 1), ("r", 0.5, "y", 3)]
    with pytest.raises(PySparkException, match="line 2"):
        readers.read_jsonl(spark, str(bad), "query_id string").collect()


def test_qrels_round_trip_and_errors(spark, tmp_path):
    rows = spark.createDataFrame([("q", "d", 2), ("q", "e", 0)], "query_id string, doc_id string, relevance int")
    writers.write_qrels(rows, str(tmp_path / "q"))
    assert sorted(map(tuple, readers.read_qrels(spark, str(tmp_path / "q")).collect())) == [("q", "d", 2), ("q", "e", 0)]
    for extra in (("q", "d", 1), ("q", "x", 3)):
        writers.write_qrels(rows.unionByName(spark.createDataFrame([extra], rows.schema)), str(tmp_path / "bad"))
        with pytest.raises(PySparkException):
            readers.read_qrels(spark, str(tmp_path / "bad")).collect()


def test_three_forms(spark, tmp_path):
    writers.write_three(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, b double"), str(tmp_path / "m.csv"))
    assert sorted(map(str, spark.read.json(str(tmp_path / "m.jsonl")).select("a", "b").collect())) == ["Row(a=1, b=None)", "Row(a=2, b=0.5)"]
    text = spark.read.text(str(tmp_path / "m.json"), wholetext=True).first()[0]
    assert sorted(x["a"] for x in json.loads(text)) == [1, 2]
    with pytest.raises(ValueError, match="csv"):
        writers.write_three(spark.range(1), "x.txt")


def test_body_text(spark):
    xml = '<a xmlns="u"><body><sec><title>T</title><p>one <b>two</b></p><sec><title>U</title><p>x</p></sec></sec></body></a>'
    rows = spark.createDataFrame([(xml,), ("<a><body>just text</body></a>",), ("<a/>",), ("<a",)], "x string")
    assert [r[0] for r in rows.select(readers.body_text(F.col("x"))).collect()] == ["T\n\none two\n\nU\n\nx", "just text", "", None]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, "k", "2024-01-01 00:00:01"), (2, "k", "2024-01-01 00:00:30"), (3, "m", "2024-01-01 00:02:00")], "id int, key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, form in (("once", lambda df: jobs.once_within(df, "key").select("key")), ("slots", jobs.slots)):
        out = tmp_path / name
        query = form(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(map(str, spark.read.parquet(str(out)).collect())) == sorted(map(str, form(events).collect()))
