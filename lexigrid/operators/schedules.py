"""Saved queries, their runs, and what became of each DOI they found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, status
from ..functions.text import strip
from .asof import as_of
from .ingest import first_of_each


def newer_than(results: DataFrame, since: Column) -> DataFrame:
    """All results without a mark, else those published after it."""
    return results.where(since.isNull() | (F.col("published_at") > since))


def unique_dois(results: DataFrame, order: str = "position") -> DataFrame:
    """Each DOI once whatever its case, spelled as it came first."""
    return first_of_each(results.where(strip(F.coalesce("doi", F.lit(""))) != ""), F.lower(strip(F.col("doi"))), order)


def split_known(results: DataFrame, indexed: DataFrame, key: str = "doi") -> tuple[DataFrame, DataFrame]:
    """Those that the index lacks, and those that it has."""
    known = indexed.select(key).distinct()
    return results.join(known, key, "left_anti"), results.join(known, key, "left_semi")


def doi_outcomes(enqueued: DataFrame, items: DataFrame) -> DataFrame:
    """Enqueued DOIs with the status of their job's item (the last one by position); without an item they stay enqueued."""
    key = F.lower(strip(F.col("doi")))
    last = items.groupBy(key.alias("_k")).agg(F.max_by("state", "position").alias("_s"), F.max_by("message", "position").alias("error_message"))
    out = enqueued.withColumn("_k", key).join(last, "_k", "left")
    return out.withColumn("status", F.when(F.col("_s").isNull(), "ENQUEUED").otherwise(status.item_status(F.col("_s")))).drop("_k", "_s")


def execution_counts(dois: DataFrame, key: str = "query_execution_id") -> DataFrame:
    """Counts of one query execution, and its status."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = dois.groupBy(key).agg(F.count("*").alias("resolved"), n("SKIPPED_EXISTS").alias("skipped_exists"), n("ENQUEUED").alias("enqueued"), n("SUCCEEDED").alias("succeeded"), n("FAILED").alias("failed"))
    return out.withColumn("status", status.query_status(F.col("resolved"), F.col("failed")))


def run_rollup(executions: DataFrame, key: str = "run_id") -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    out = executions.groupBy(key).agg(F.count("*").alias("total"), n("SUCCESS").alias("succeeded"), n("FAILED").alias("failed"))
    return out.withColumn("status", status.run_status(F.col("total"), F.col("succeeded"), F.col("failed")))


def runs_with_executions(runs: DataFrame, executions: DataFrame) -> DataFrame:
    """Runs with their executions in a list by started_at."""
    listed = executions.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("started_at", "query_id", "status"))).alias("executions"))
    return runs.join(listed, "run_id", "left").withColumn("executions", F.coalesce("executions", F.expr("cast(array() as array<struct<started_at:timestamp,query_id:string,status:string>>)")))


def list_runs(runs: DataFrame, wanted: str | None = None, since=None, until=None) -> DataFrame:
    """Runs of a status that began between two times, both included, newest first."""
    if since is not None and until is not None and since > until:
        raise ValueError("the first time must not come after the last")
    for rule in ((F.col("status") == wanted) if wanted else None, (F.col("started_at") >= F.lit(since)) if since is not None else None, (F.col("started_at") <= F.lit(until)) if until is not None else None):
        runs = runs if rule is None else runs.where(rule)
    return runs.orderBy(F.desc("started_at"))


def enabled_queries(saved: DataFrame) -> DataFrame:
    return saved.where("enabled").orderBy("created_at")


def high_water_marks(executions: DataFrame) -> DataFrame:
    """When the last execution of each query that brought something began."""
    return executions.where("status IN ('SUCCESS', 'PARTIAL')").groupBy("query_id").agg(F.max("started_at").alias("last_successful_run_at"))


def fired_slots(events: DataFrame, time_col: str = "ts") -> DataFrame:
    """Each minute of each day that has an event, once."""
    return events.select(F.date_trunc("minute", time_col).alias("slot")).distinct()


def schedule_status(asked: DataFrame, runs: DataFrame, seconds: int = 30 * 86_400) -> DataFrame:
    """What a scheduler says of itself at each asked time: asked's columns, next_run_at, last_run_at and last_run_status (null before the first run).

    asked: schedule, asked_at, times (array of HH:MM in UTC); runs: schedule, run_id, started_at, status. The last run is the last that began at
    or before the asked time; of several at one time the largest run_id.
    """
    known = as_of(asked, runs.select("schedule", "run_id", "started_at", "status"), "schedule", "asked_at", "started_at", F.col("run_id"), seconds, "_run")
    return known.select(*asked.columns, dates.next_run(F.col("asked_at"), F.col("times")).alias("next_run_at"), F.col("_run.started_at").alias("last_run_at"), F.col("_run.status").alias("last_run_status"))


def run_results(asked: DataFrame, runs: DataFrame, dois: DataFrame) -> DataFrame:
    """run_id, results: what became of the DOIs of each asked run, in order of created_at; empty for a run without any, null for an unknown one.

    dois: run_id, doi, status, error_message, created_at. A run's results are one value, as they are one answer.
    """
    listed = dois.join(asked.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "doi", "status", "error_message"))).alias("l"))
    known = runs.select("run_id").distinct().withColumn("_in", F.lit(True))
    results = F.transform("l", lambda x: F.struct(x["doi"].alias("doi"), x["status"].alias("status"), x["error_message"].alias("error_message")))
    none = F.expr("cast(array() as array<struct<doi:string,status:string,error_message:string>>)")
    return asked.select("run_id").distinct().join(known, "run_id", "left").join(listed, "run_id", "left").select("run_id", F.when(F.col("_in"), F.coalesce(results, none)).alias("results"))
