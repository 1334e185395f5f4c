"""Streaming forms of the queue, the key stores and the status tables.

Every function takes a streaming or a static DataFrame alike; state is bounded by watermarks, and writes are idempotent, so
a micro-batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once_within(events: DataFrame, key: str, time: str = "ts", hours: int = 24, body: str | None = None) -> DataFrame:
    """The events that begin a record of their key: the first one, then each that comes when the record is over so many hours
    old or, with `body`, that has another body than the record. Such an event replaces the record; others leave it as it is.

    Of events of one time the least by all their columns comes first. Events without a key or a time go. A stream knows no bodies,
    and forgets records by its watermark.
    """
    if events.isStreaming:
        return events.withWatermark(time, f"{hours} hours").dropDuplicatesWithinWatermark([key])
    mark = F.coalesce(F.col(body).cast("string"), F.lit("")) if body else F.lit("")
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), mark.alias("b"), F.struct(*(events[c] for c in events.columns)).alias("row"))
    limit = hours * 3_600_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, since, held = None, 0, None
        for batch in batches:
            keep = []
            for k, t, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                new = k != last or t - since > limit or b != held
                if new:
                    last, since, held = k, t, b
                keep.append(new)
            yield batch.filter(pa.array(keep, pa.bool_()))

    # a key's events pass one after the other; only its record is held
    return rows.repartition("k").sortWithinPartitions("k", "t", F.to_json("row")).mapInArrow(run, rows.schema).select("row.*")


def conflicts(events: DataFrame) -> DataFrame:
    """Keys that came with different bodies (idempotency_key, body_hash)."""
    return events.groupBy("idempotency_key").agg(F.count_distinct("body_hash").alias("bodies")).where("bodies > 1")


def slots(events: DataFrame, time: str = "ts") -> DataFrame:
    """Each minute that has an event, once."""
    out = events.select(F.date_trunc("minute", time).alias("slot"))
    return out.withWatermark("slot", "10 minutes").dropDuplicates(["slot"]) if events.isStreaming else out.distinct()


def counts_by_window(events: DataFrame, length: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work off what is there, batch by batch, then stop."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
