import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import asof, schedules
from lexigrid.streaming import capture

BASE = datetime.datetime(2024, 1, 1)


def at(s):
    return BASE + datetime.timedelta(seconds=s)


@pytest.mark.parametrize("seconds", [1, 60, 10**6])
def test_as_of_equals_a_scan(spark, seconds):
    rng = random.Random(seconds)
    left = [(i, rng.choice(["a", "b", None]), None if rng.random() < 0.1 else at(rng.randint(-50, 500))) for i in range(150)]
    right = [(rng.choice(["a", "b", "c", None]), None if rng.random() < 0.1 else at(rng.randint(0, 500)), i) for i in range(60)]
    a = spark.createDataFrame(left, "id int, k string, t timestamp")
    b = spark.createDataFrame(right, "k string, u timestamp, n int")
    got = {r["id"]: r["last"] and r["last"]["n"] for r in asof.as_of(a, b, "k", "t", "u", F.col("n"), seconds).collect()}
    for i, k, t in left:
        before = [(u, n) for key, u, n in right if key == k and k is not None and t is not None and u is not None and u <= t]
        assert got[i] == (max(before)[1] if before else None)
    assert len(got) == 150


def sample(seed, n=120):
    rng = random.Random(seed)
    requests = [(i, rng.choice("uvw"), at(rng.randint(0, 40_000)), f"/p{i}") for i in range(n)]
    responses = [(1000 + i, rng.choice("uvwx"), at(rng.randint(0, 60_000)), rng.choice([200, 204, 399, 400, 500])) for i in range(n)]
    return requests, responses


def brute(requests, responses, hours):
    closed = {}
    for rid, key, done, code in sorted(responses, key=lambda r: (r[2], r[0])):
        mine = [(t, i) for i, k, t, _ in requests if k == key and t <= done]
        if mine and done <= max(mine)[0] + datetime.timedelta(hours=hours):
            closed[max(mine)[1]] = (done, code)
    out = []
    for i, key, t, path in requests:
        done, code = closed.get(i, (None, None))
        out.append((i, key, t, path, done, code, None if done is None else int((done - t).total_seconds() * 1000), "ERROR" if code is not None and code >= 400 else "SUCCESS"))
    return sorted(out)


ASK, ANSWER = "audit_id int, request_id string, received_at timestamp, path string", "response_id int, request_id string, completed_at timestamp, response_status int"


def test_a_response_closes_the_latest_request(spark):
    requests, responses = sample(1)
    requests += [(900, "u", at(100), "/same"), (901, "u", at(100), "/same")]
    got = capture.captured(spark.createDataFrame(requests, ASK), spark.createDataFrame(responses, ANSWER), 2)
    assert sorted(map(tuple, got.collect())) == brute(requests, responses, 2)


def test_stream_and_tables_agree(spark, tmp_path):
    requests, responses = sample(2)
    far = 10**6  # later ones let the watermark pass all others
    for name, rows, schema in (("q", [*requests, (999, "end", at(far), "/")], ASK), ("a", [*responses, (1999, "none", at(far), 200)], ANSWER)):
        rows.sort(key=lambda r: r[2])
        for k in range(3):
            spark.createDataFrame(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    pairs = capture.capture_stream(read("q", ASK), read("a", ANSWER), 2, "12 hours")
    query = pairs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    written = spark.read.parquet(str(tmp_path / "out"))
    got = sorted(tuple(r) for r in capture.settled(written).collect() if r["audit_id"] != 999)
    assert got == brute(requests, responses, 2) and {r[4] is None for r in got} == {True, False}


def test_schedule_status_and_run_results(spark):
    asked = spark.createDataFrame([("s", at(50), ["06:00"]), ("s", at(5), []), ("other", at(50), ["00:00"])], "schedule string, asked_at timestamp, times array<string>")
    runs = spark.createDataFrame([("s", 1, at(10), "FAILED"), ("s", 2, at(10), "SUCCESS"), ("s", 3, at(60), "RUNNING")], "schedule string, run_id int, started_at timestamp, status string")
    got = sorted((r["schedule"], r["asked_at"], r["next_run_at"], r["last_run_at"], r["last_run_status"]) for r in schedules.schedule_status(asked, runs).collect())
    assert got == [("other", at(50), at(86_400), None, None), ("s", at(5), at(5), None, None), ("s", at(50), at(21_600), at(10), "SUCCESS")]
    dois = spark.createDataFrame([(1, "b", "FAILED", "why", at(2)), (1, "a", "SUCCEEDED", None, at(1)), (9, "z", "x", None, at(0))], "run_id int, doi string, status string, error_message string, created_at timestamp")
    out = {r["run_id"]: r["results"] for r in schedules.run_results(spark.createDataFrame([(1,), (2,), (9,)], "run_id int"), runs, dois).collect()}
    assert [(d["doi"], d["status"], d["error_message"]) for d in out[1]] == [("a", "SUCCEEDED", None), ("b", "FAILED", "why")] and out[2] == [] and out[9] is None
