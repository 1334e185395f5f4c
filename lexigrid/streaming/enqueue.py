"""Jobs between acceptance and work: reservations, payloads, and what undoes them.

Events of a job: job_id, at, action, doc_id. `reserve` takes a document for the job, `store` keeps its payload, `enqueue` hands it to the
workers, `enqueue_failed` says that they refused, `work` is a worker that begins. Outcomes (job_id, doc_id, at, outcome):

* a document is reserved, already_indexed (the index has it: the reservation is undone at once), or skipped_duplicate within its job;
* a refused job, and one that nobody enqueues in time, is rolled back: every reservation is released, payload and job are forgotten;
* work on a job whose payload is lost or too old fails each document (failed: missing_payload) and releases it; so does a queued
  job that no worker takes. Else each document has succeeded. Either ends the job; a later event of its id begins a new one.

The stream and the table follow the same steps. In a stream, events wait until the watermark has passed them, and are then taken in order
of time, so its outcomes don't depend on how the events were dealt into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "job_id string, doc_id string, at timestamp, outcome string"
#: Events of one instant are taken in this order.
ACTIONS = ("reserve", "store", "enqueue", "enqueue_failed", "work")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """Milliseconds: until a job that isn't enqueued is rolled back, that a payload is kept, and until a queued job is given up."""

    patience: int = 600_000
    payload: int = 86_400_000
    give_up: int = 172_800_000


@dataclass
class Job:
    begun: int
    docs: list[str] = field(default_factory=list)
    queued: int | None = None
    stored: int | None = None

    def deadline(self, rules: Rules) -> int:
        return self.begun + rules.patience if self.queued is None else self.queued + rules.give_up


def undone(job: Job) -> list[tuple[str | None, str]]:
    return [*((d, "released") for d in job.docs), (None, "rolled_back")]


def failed(job: Job) -> list[tuple[str | None, str]]:
    return [*((d, "failed: missing_payload") for d in job.docs), *((d, "released") for d in job.docs), (None, "failed")]


def expired(job: Job) -> list[tuple[str | None, str]]:
    """What becomes of a job at its deadline."""
    return undone(job) if job.queued is None else failed(job)


def step(job: Job | None, action: str, doc: str | None, indexed: bool, at: int, rules: Rules) -> tuple[Job | None, list[tuple[str | None, str]]]:
    """A job and an event -> the job after it (None: forgotten) and what came of it."""
    if action == "reserve":
        job = job or Job(at)
        if indexed:
            return (job if job.docs or job.stored is not None else None), [(doc, "already_indexed")]
        if doc in job.docs:
            return job, [(doc, "skipped_duplicate")]
        job.docs.append(doc)
        return job, [(doc, "reserved")]
    if action == "store":
        job = job or Job(at)
        job.stored = at
        return job, []
    if job is None or (action == "enqueue" and not job.docs):
        return job, [(None, "not_found")]
    if action == "enqueue":
        job.queued = at if job.queued is None else job.queued
        return job, [(None, "queued")]
    if action == "enqueue_failed":
        return (job, [(None, "already_queued")]) if job.queued is not None else (None, undone(job))
    if job.queued is None:
        return job, [(None, "not_queued")]
    if job.stored is None or at - job.stored > rules.payload:
        return None, failed(job)
    return None, [*((d, "succeeded") for d in job.docs), (None, "succeeded")]


def _ready(events: DataFrame, indexed: DataFrame | None) -> DataFrame:
    """Events with at_ms, their order within an instant, and if the index has the document (a join of the stream with a static table)."""
    order = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")) - 1
    rows = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull() & (order >= 0)).select(F.col("job_id").cast("string").alias("job_id"), F.col("at").cast("timestamp").alias("at"), order.cast("int").alias("place"), F.col("doc_id").cast("string").alias("doc_id"))
    rows = rows.where("place > 0 OR doc_id IS NOT NULL")
    if indexed is None:
        return rows.withColumn("indexed", F.lit(False))
    known = indexed.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("_in", F.lit(True))
    return rows.join(known, "doc_id", "left").select("job_id", "at", "place", "doc_id", F.coalesce("_in", F.lit(False)).alias("indexed"))


def _frame(rows: list[tuple[str, int, str | None, str]]) -> pd.DataFrame:
    text = lambda k: pd.Series([r[k] for r in rows], dtype=object)
    return pd.DataFrame({"job_id": text(0), "doc_id": text(2), "at": pd.to_datetime([r[1] for r in rows], unit="ms"), "outcome": text(3)})


def replay(events: DataFrame, indexed: DataFrame | None = None, rules: Rules = Rules(), until_ms: int | None = None) -> DataFrame:
    """Outcomes of a static table of events; deadlines and events after until_ms (none: all) don't count. Times are taken to the millisecond.

    A job's events pass one after the other, and only the job is held; events of one instant come in the order of ACTIONS, then by document.
    """
    rows = _ready(events, indexed).withColumn("ms", F.unix_millis("at"))
    rows = (rows if until_ms is None else rows.where(F.col("ms") <= until_ms)).select("job_id", "ms", "place", "doc_id", "indexed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, job = None, None

        def over(limit: int | None) -> list[tuple]:
            nonlocal job
            if job is None or (limit is not None and job.deadline(rules) >= limit):
                return []
            done, job = [(job.deadline(rules), *x) for x in expired(job)], None
            return done

        end = None if until_ms is None else until_ms + 1
        for rows in batches:
            out = []
            for key, ms, place, doc, there in zip(rows.job_id, rows.ms, rows.place, rows.doc_id, rows.indexed, strict=True):
                if key != now:
                    out += [(now, *x) for x in over(end)]
                    now, job = key, None
                out += [(key, *x) for x in over(ms)]  # a deadline that comes before the event
                job, came = step(job, ACTIONS[place], doc, bool(there), ms, rules)
                out += [(key, ms, *x) for x in came]
            yield _frame(out)
        yield _frame([(now, *x) for x in over(end)])

    return rows.repartition("job_id").sortWithinPartitions("job_id", "ms", "place", "doc_id").mapInPandas(run, OUTCOME)


class _Jobs(StatefulProcessor):
    """State of a job: its fields, its documents, and events that the watermark hasn't passed. Timers: an event's time, and the deadline."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "begun long, queued long, stored long")
        self.docs = handle.getListState("docs", "doc_id string")
        self.waiting = handle.getListState("waiting", "ms long, place int, doc_id string, indexed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            times = batch["at"].astype("datetime64[us]").astype("int64") // 1000
            self.waiting.appendList([(int(ms), int(p), d, bool(i)) for ms, p, d, i in zip(times, batch.place, batch.doc_id, batch.indexed, strict=True)])
            for ms in sorted(set(map(int, times))):
                self.handle.registerTimer(ms)
        yield _frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed, at the first timer of several
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda e: (e[0], e[1], e[2] or "")) if self.waiting.exists() else []
        job = Job(0) if self.job.exists() else None
        if job is not None:
            job.begun, job.queued, job.stored = self.job.get()
            job.docs = [d for (d,) in self.docs.get()] if self.docs.exists() else []
        out, rest = [], []
        for ms, place, doc, there in held:
            if ms > now:
                rest.append((ms, place, doc, there))
                continue
            if job is not None and job.deadline(self.rules) < ms:
                out += [(job.deadline(self.rules), *x) for x in expired(job)]
                job = None
            job, came = step(job, ACTIONS[place], doc, there, ms, self.rules)
            out += [(ms, *c) for c in came]
        if job is not None and job.deadline(self.rules) <= now:
            out += [(job.deadline(self.rules), *x) for x in expired(job)]
            job = None
        self.waiting.put(rest) if rest else self.waiting.clear()
        if job is None:
            self.job.clear()
            self.docs.clear()
        else:
            self.job.update((job.begun, job.queued, job.stored))
            self.docs.put([(d,) for d in job.docs]) if job.docs else self.docs.clear()
            self.handle.registerTimer(job.deadline(self.rules))
        yield _frame([(key[0], *x) for x in out])

    def close(self) -> None:
        pass


def track_jobs(events: DataFrame, indexed: DataFrame | None = None, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """The same over a stream; events that come more than `late` after later ones are dropped. Outcomes follow once the watermark passes them.

    Several state variables need the RocksDB state store, which this sets for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = _ready(events, indexed).withWatermark("at", late)
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_Jobs(rules), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime")
