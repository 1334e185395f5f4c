import datetime
import random

import pytest

from lexigrid.streaming import enqueue
from lexigrid.streaming.enqueue import Rules

BASE = datetime.datetime(2024, 1, 1)
RULES = Rules(patience=100_000, payload=300_000, give_up=500_000)
SCHEMA = "job_id string, at timestamp, action string, doc_id string"


def at(s):
    return BASE + datetime.timedelta(seconds=s)


def outcomes(df):
    return sorted((r["job_id"], r["at"], r["doc_id"] or "", r["outcome"]) for r in df.collect())


SMALL = [
    ("ok", 0, "reserve", "a"), ("ok", 1, "reserve", "b"), ("ok", 1, "reserve", "a"), ("ok", 2, "store", None), ("ok", 3, "enqueue", None), ("ok", 200, "work", None),
    ("refused", 0, "reserve", "a"), ("refused", 1, "reserve", "known"), ("refused", 2, "store", None), ("refused", 3, "enqueue_failed", None), ("refused", 4, "work", None),
    ("slow", 0, "reserve", "x"), ("slow", 150, "enqueue", None),
    ("lost", 0, "reserve", "y"), ("lost", 1, "enqueue", None), ("lost", 2, "work", None),
    ("old", 0, "reserve", "z"), ("old", 0, "store", None), ("old", 0, "enqueue", None), ("old", 301, "work", None),
    ("idle", 0, "reserve", "w"), ("idle", 0, "store", None), ("idle", 1, "enqueue", None),
    ("only known", 0, "reserve", "known"), ("only known", 1, "enqueue", None),
]


def test_rollback_and_lost_payloads(spark):
    events = spark.createDataFrame([(j, at(s), a, d) for j, s, a, d in SMALL], SCHEMA)
    index = spark.createDataFrame([("known",), ("known",)], "doc_id string")
    got = [(j, (t - BASE).seconds, d, o) for j, t, d, o in outcomes(enqueue.replay(events, index, RULES))]
    own = lambda job: [x[1:] for x in got if x[0] == job]
    assert own("ok") == [(0, "a", "reserved"), (1, "a", "skipped_duplicate"), (1, "b", "reserved"), (3, "", "queued"), (200, "", "succeeded"), (200, "a", "succeeded"), (200, "b", "succeeded")]
    assert own("refused") == [(0, "a", "reserved"), (1, "known", "already_indexed"), (3, "", "rolled_back"), (3, "a", "released"), (4, "", "not_found")]
    assert own("slow") == [(0, "x", "reserved"), (100, "", "rolled_back"), (100, "x", "released"), (150, "", "not_found")]
    assert own("lost") == [(0, "y", "reserved"), (1, "", "queued"), (2, "", "failed"), (2, "y", "failed: missing_payload"), (2, "y", "released")]
    assert own("old")[-3:] == [(301, "", "failed"), (301, "z", "failed: missing_payload"), (301, "z", "released")]
    assert own("idle")[-3:] == [(501, "", "failed"), (501, "w", "failed: missing_payload"), (501, "w", "released")]
    assert own("only known") == [(0, "known", "already_indexed"), (1, "", "not_found")]


@pytest.mark.parametrize("files", [1, 5])
def test_stream_and_table_agree(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [(f"j{rng.randint(0, 12)}", at(rng.randint(0, 3000)), rng.choice(["reserve", "reserve", *enqueue.ACTIONS]), rng.choice("abcdef")) for _ in range(400)]
    rows = [(j, t, a, d if a == "reserve" else None) for j, t, a, d in rows]
    rows += [(j, at(s), a, d) for j, s, a, d in SMALL]
    rows.sort(key=lambda r: r[1])
    # files hold events of their own stretch of time, in any order, and the last one an event far ahead that lets all others pass
    parts = [rows[k * len(rows) // files : (k + 1) * len(rows) // files] for k in range(files)]
    parts[-1].append(("end", at(100_000), "reserve", "e"))
    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    index = spark.createDataFrame([("known",)], "doc_id string")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = enqueue.track_jobs(stream, index, RULES, "10 minutes")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    streamed = outcomes(spark.read.parquet(str(tmp_path / "out")))
    replayed = outcomes(enqueue.replay(spark.read.parquet(str(tmp_path / "in")), index, RULES, int((at(100_000) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000) - 600_000))
    assert streamed == replayed and len(streamed) > 300
