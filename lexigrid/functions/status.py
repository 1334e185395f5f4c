"""States of jobs and runs from their counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def job_state(failed: Column, succeeded: Column) -> Column:
    return F.when((failed > 0) & (succeeded > 0), "partial").when(failed > 0, "failed").otherwise("succeeded")


def query_status(resolved: Column, failed: Column) -> Column:
    return F.when((resolved == 0) | (failed == 0), "SUCCESS").when(failed >= resolved, "FAILED").otherwise("PARTIAL")


def run_status(total: Column, succeeded: Column, failed: Column) -> Column:
    return F.when(total == succeeded, "SUCCESS").when(total == failed, "FAILED").otherwise("PARTIAL")


def item_status(state: Column) -> Column:
    low = F.lower(F.trim(state))
    return F.when(low == "succeeded", "SUCCEEDED").when(low == "failed", "FAILED").when(low == "skipped_duplicate", "SKIPPED_EXISTS").otherwise("ENQUEUED")


def retry_after(size: Column, limit: Column) -> Column:
    """Seconds that a sender should wait: longer when the queue is nine tenths full, or takes nothing."""
    return F.when((limit <= 0) | (size >= F.floor(limit * 0.9)), 10).otherwise(3)


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(zero)


def token_rate(tokens: Column, nanoseconds: Column) -> Column:
    return F.when(nanoseconds > 0, tokens / (nanoseconds / F.lit(1e9)))


def error_status(code: Column) -> Column:
    """HTTP status of an error."""
    return F.when(code == "validation_error", 400).when(code == "not_found", 404).when(code == "conflict", 409).when(code == "too_many_requests", 429).otherwise(500)
