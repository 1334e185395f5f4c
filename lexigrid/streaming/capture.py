"""Capture of requests and of the responses that close them.

A response closes the latest request of its id that came at or before it, up to a bound of time; a later response to the same request takes
the place of an earlier one. A request that nobody closes stays open, as it was received.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import as_of

FIELDS = ("completed_at", "response_status", "duration_ms", "status")


def _closing(received: Column, completed: Column, code: Column) -> list[Column]:
    """Milliseconds from the request to the response, and ERROR from code 400 on; an open request counts as SUCCESS."""
    took = F.greatest(F.lit(0), F.floor((F.unix_micros(completed) - F.unix_micros(received)) / 1000)).cast("long")
    return [F.when(completed.isNotNull(), took).alias("duration_ms"), F.when(code >= 400, "ERROR").otherwise("SUCCESS").alias("status")]


def _closed(requests: DataFrame, closings: DataFrame) -> DataFrame:
    """requests with their last closing (audit_id, completed_at, response_status, response_id)."""
    last = closings.groupBy("audit_id").agg(F.max_by(F.struct("completed_at", "response_status"), F.struct("completed_at", "response_id")).alias("c"))
    out = requests.join(last, "audit_id", "left")
    return out.select(*requests.columns, "c.completed_at", "c.response_status", *_closing(F.col("received_at"), F.col("c.completed_at"), F.col("c.response_status")))


def captured(requests: DataFrame, responses: DataFrame, hours: int = 24) -> DataFrame:
    """requests with completed_at, response_status, duration_ms and status.

    requests: audit_id (unique; the larger of one instant is the later), request_id, received_at, others; responses: response_id, request_id,
    completed_at, response_status. Responses without a request of their id within `hours` are dropped.
    """
    own = responses.select("response_id", "request_id", "completed_at", "response_status")
    asked = as_of(own, requests.select("audit_id", "request_id", "received_at"), "request_id", "completed_at", "received_at", F.col("audit_id"), hours * 3600, "r")
    near = asked.where(F.col("r").isNotNull() & (F.col("completed_at") <= F.col("r.received_at") + F.expr(f"INTERVAL {hours} HOURS")))
    return _closed(requests, near.select("r.audit_id", "completed_at", "response_status", "response_id"))


def capture_stream(requests: DataFrame, responses: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """The stream of pairs: every request with every response of its id that came within `hours`, or with none once the watermark has passed
    them. State lasts as long as the bound and the lateness. settled() makes of what was written what captured() makes of tables."""
    ask = requests.withWatermark("received_at", late).alias("q")
    answer = responses.select("response_id", F.col("request_id").alias("_id"), "completed_at", "response_status").withWatermark("completed_at", late).alias("a")
    near = F.expr(f"request_id = _id AND completed_at >= received_at AND completed_at <= received_at + INTERVAL {hours} HOURS")
    return ask.join(answer, near, "left_outer").drop("_id")


def settled(pairs: DataFrame) -> DataFrame:
    """What captured() gives, from the pairs of capture_stream(): each response stays with the latest of its requests."""
    columns = [c for c in pairs.columns if c not in ("response_id", "completed_at", "response_status")]
    requests = pairs.groupBy("audit_id").agg(F.any_value(F.struct(*columns)).alias("r")).select("r.*")
    place = F.row_number().over(Window.partitionBy("response_id").orderBy(F.desc("received_at"), F.desc("audit_id")))
    closings = pairs.where("response_id IS NOT NULL").withColumn("_n", place).where("_n = 1")
    return _closed(requests, closings.select("audit_id", "completed_at", "response_status", "response_id"))
