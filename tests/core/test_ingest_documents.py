from pyspark.sql import functions as F

from lexigrid.functions.ids import point_id
from lexigrid.operators import chunking, ingest


def test_failures_are_values(spark):
    def model():
        def run(texts):
            if "boom" in texts[0]:
                raise RuntimeError("out of memory")
            if "none" in texts[0]:
                return [[] for _ in texts]
            return [[float(len(t))] for t in texts if "skip" not in t]

        return run

    rows = [("ok", "abc " * 10), ("blank", " \n"), ("null", None), ("boom", "boom"), ("short", "skip this"), ("empty", "none"), ("there", "known text"), ("boom there", "boom"), ("cut away", "zzz")]
    items = spark.createDataFrame([(i, t, "J", ["A"], 2020) for i, t in rows], "doc_id string, content_text string, journal string, authors array<string>, year int")
    index = spark.createDataFrame([("there",), ("boom there",), ("there",)], "doc_id string")
    cut = lambda t: F.when(~t.contains("zzz"), chunking.fixed_windows(t, 16, 4))
    done = ingest.ingest_documents(items, index, cut, model)
    got = {r["doc_id"]: (r["state"], r["message"], r["n_points"]) for r in ingest.item_statuses(done).collect()}
    assert got == {
        "ok": ("succeeded", None, 3), "blank": ("failed", "empty_document_text", 0), "null": ("failed", "empty_document_text", 0), "boom": ("failed", "embedding_failed", 0),
        "short": ("failed", "embedding_count_mismatch", 0), "empty": ("failed", "invalid_vector_size", 0), "there": ("skipped_duplicate", "duplicate_doc", 0),
        "boom there": ("failed", "embedding_failed", 0), "cut away": ("failed", "no_chunks", 0),
    }
    assert {r["failure_detail"] for r in done.where("failure = 'embedding_failed'").collect()} == {"RuntimeError: out of memory"}
    points = ingest.item_points(done, F.lit("2024-01-01T00:00:00Z")).orderBy("chunk_index").collect()
    assert [(p["doc_id"], p["chunk_index"], p["chunk_start"], p["chunk_end"], p["vector"]) for p in points] == [("ok", 0, 0, 16, [16.0]), ("ok", 1, 12, 28, [16.0]), ("ok", 2, 24, 39, [15.0])]
    assert points[0]["text"] == "abc abc abc abc " and points[0]["journal"] == "J" and points[0]["section"] is None and points[0]["year"] == 2020
    wanted = spark.range(1).select(point_id(F.lit("ok"), F.lit(1))).first()[0]
    assert points[1]["point_id"] == wanted


def test_section_chunks_carry_their_titles(spark):
    text = "Results\n\nMany patients had a clot. " + "x" * 50 + "."
    items = spark.createDataFrame([("a", text)], "doc_id string, content_text string")
    done = ingest.ingest_documents(items, items.limit(0), chunking.section_chunks)
    assert [p["section"] for p in ingest.item_points(done, F.lit("now")).collect()] == ["Results"]
    assert ingest.item_statuses(ingest.ingest_documents(items.limit(0), items, chunking.section_chunks)).count() == 0
