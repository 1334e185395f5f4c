"""Reserve, commit, release and delete of documents as keyed state.

Events: doc_id, action (reserve, commit, release, delete), owner, at. A reservation holds against other owners until it is
released or forgotten; a committed document refuses reservations until it is deleted. Each event gets an outcome.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOME = "doc_id string, action string, owner string, at timestamp, outcome string"


def _step(state: tuple[str, str], action: str, owner: str) -> tuple[tuple[str, str], str]:
    """(kind, owner) of a document and an event -> what it is then, and what came of the event."""
    kind, holder = state
    if action == "reserve":
        return (("reserved", owner), "reserved") if kind == "free" else (state, "already_indexed" if kind == "committed" else "reserved_by_other" if holder != owner else "reserved")
    if action == "commit":
        return (("committed", owner), "committed") if kind == "reserved" and holder == owner else (state, "not_reserved")
    if action == "release":
        return (("free", ""), "released") if kind == "reserved" and holder == owner else (state, "not_reserved")
    return (("free", ""), "deleted") if kind == "committed" else (state, "not_found")


def replay(events: DataFrame) -> DataFrame:
    """Outcomes of a static table of events, in order of time and owner. A document's events pass one after the other; only its state is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, ("free", "")
        for rows in batches:
            out = []
            for doc, action, owner in zip(rows.doc_id, rows.action, rows.owner, strict=True):
                if doc != last:
                    last, state = doc, ("free", "")
                state, outcome = _step(state, action, owner)
                out.append(outcome)
            yield rows.assign(outcome=out)

    rows = events.select("doc_id", "action", "owner", "at").repartition("doc_id").sortWithinPartitions("doc_id", "at", "owner", "action")
    return rows.mapInPandas(run, OUTCOME)


def track(events: DataFrame, hours: int = 24) -> DataFrame:
    """The same over a stream; a document without events for so many hours of event time is forgotten if it isn't committed.

    Events that come later than that are dropped. Event time, as timeouts by the clock would start empty batches without end.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = held.get if held.exists else ("free", "")
        rows = pd.concat(list(batches)).sort_values(["at", "owner"])
        out = []
        for action, owner in zip(rows.action, rows.owner, strict=True):
            state, outcome = _step(tuple(state), action, owner)
            out.append(outcome)
        held.update(tuple(state))
        if state[0] != "committed":
            held.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + hours * 3_600_000)
        yield rows.assign(outcome=out)[["doc_id", "action", "owner", "at", "outcome"]]

    rows = events.select("doc_id", "action", "owner", "at").withWatermark("at", f"{hours} hours")
    return rows.groupBy("doc_id").applyInPandasWithState(run, OUTCOME, "kind string, holder string", "append", GroupStateTimeout.EventTimeTimeout)


def retained(jobs: DataFrame, hours: float, most: int, now_col: str = "now") -> DataFrame:
    """Finished jobs kept for so many hours, and of those the newest; jobs that run are all kept. Ranks are taken per tenant if there is one.

    Every task keeps its own newest ones first, so that only those meet.
    """
    age = F.col(now_col).cast("double") - F.col("completed_at").cast("double")
    running, done = jobs.where(F.col("completed_at").isNull()), jobs.where(age <= hours * 3600)
    order = F.desc("completed_at"), F.col("job_id")
    if "tenant" not in jobs.columns:
        return running.unionByName(done.orderBy(*order).limit(most))
    place = F.row_number().over(Window.partitionBy("tenant").orderBy(*order))
    return running.unionByName(done.withColumn("_n", place).where(F.col("_n") <= most).drop("_n"))
