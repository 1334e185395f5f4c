"""Ordered ids cut into batches of bounded number and length, without a task that walks the whole list.

Batches are filled greedily, so each begins where the one before ends. The list is cut into blocks; each block tabulates, for
every place where a batch may begin in it, where the first batch of the next block begins and how many begin before that. Such
tables compose, first within groups of blocks, then groups of groups; going back down, every block learns its own first batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Ids of a block (more than a batch may hold), and tables that are composed in one task at a time.
BLOCK, FAN = 4096, 256


def next_starts(lengths: np.ndarray, most: int, chars: int) -> np.ndarray:
    """Where the batch ends that begins at each place: `most` ids at most, of `chars` characters with commas between them; one id always fits."""
    ends = np.concatenate(([0], np.cumsum(lengths + 1)))
    fit = np.searchsorted(ends, ends[:-1] + chars + 1, "right") - 1
    place = np.arange(len(lengths))
    return np.maximum(place + 1, np.minimum(fit, place + most))


def table_of(lengths: np.ndarray, block: int, most: int, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first `most` places of a block: the first start at or after its end (from there), and starts before it."""
    after = next_starts(lengths, most, chars)
    out, n = np.arange(len(lengths) + most) - block, np.zeros(len(lengths) + most, np.int64)
    for k in range(min(block, len(lengths)) - 1, -1, -1):
        out[k], n[k] = (out[after[k]], n[after[k]] + 1) if after[k] < block else (after[k] - block, 1)
    return np.maximum(out[:most], 0), n[:most]


def id_batches(ids: DataFrame, most: int = 200, chars: int = 1800, block: int = BLOCK) -> DataFrame:
    """key, position, id, batch (from 0 for each key). ids: key, position (whole number), id.

    Ids are trimmed; blank ones go, and so do rows without a key or a position. A key's ids are taken by position, then by id; one key may have all rows. A batch holds up to `most` ids
    of `chars` characters with the commas between them; an id that is longer is a batch by itself. Blocks hold `block` ids and their
    neighbours' first ones, so memory doesn't grow with a key, and positions that are spread thinly cost no more.
    """
    if most < 1 or block < most:
        raise ValueError("a batch must hold an id, and a block a batch")
    rows = ids.select(F.col("key").cast("string").alias("key"), F.col("position").cast("long").alias("position"), strip(F.col("id").cast("string")).alias("id")).where("key IS NOT NULL AND id <> '' AND position IS NOT NULL")
    # number the rows of each key: counts of ranges of positions first, then rows within a range
    rows = rows.withColumn("range", F.floor(F.col("position") / block))
    counts = rows.groupBy("key", "range").agg(F.count("*").alias("n")).withColumn("far", F.floor(F.col("range") / block))
    far = counts.groupBy("key", "far").agg(F.sum("n").alias("n")).select("key", "far", (F.sum("n").over(Window.partitionBy("key").orderBy("far")) - F.col("n")).alias("b"))
    before = counts.join(far, ["key", "far"]).select("key", "range", (F.col("b") + F.sum("n").over(Window.partitionBy("key", "far").orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("key", "range").orderBy("position", "id")) - 1
    placed = rows.withColumn("own", own).join(before, ["key", "range"]).withColumn("i", F.col("before") + F.col("own"))
    placed = placed.withColumn("block", F.expr(f"i div {block}")).withColumn("at", F.expr(f"i % {block}").cast("int"))
    # a batch that begins near a block's end reaches into the next one
    both = F.when((F.col("at") < most) & (F.col("block") > 0), F.array(F.struct("block", "at"), F.struct((F.col("block") - 1).alias("block"), (F.col("at") + block).alias("at")))).otherwise(F.array(F.struct("block", "at")))
    spread = placed.select("key", "position", "id", F.explode(both).alias("p"))
    member = F.struct("p.at", "id", "position")
    blocks = spread.groupBy("key", "p.block").agg(F.array_sort(F.collect_list(member)).alias("members"))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [table_of(np.array([len(m["id"]) for m in members], np.int64), block, most, chars) for members in rows.members]
            yield pd.DataFrame({"key": rows.key, "block": rows.block, "out": [m[0] for m in made], "n": [m[1] for m in made]})

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, n = None, None, None
        for rows in batches:
            for key, group, o, m in zip(rows.key, rows.group, rows.out, rows.n, strict=True):
                if now != (key, group):
                    if now is not None:
                        yield pd.DataFrame({"key": [now[0]], "block": [now[1]], "out": [out], "n": [n]})
                    now, out, n = (key, group), np.asarray(o), np.asarray(m)
                else:
                    out, n = np.asarray(o)[out], n + np.asarray(m)[out]
        if now is not None:
            yield pd.DataFrame({"key": [now[0]], "block": [now[1]], "out": [out], "n": [n]})

    def entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, n = None, 0, 0
        for rows in batches:
            first, counts = [], []
            for key, group, at_group, n_group, o, m in zip(rows.key, rows.group, rows["first"], rows.begun, rows.out, rows.n, strict=True):
                if now != (key, group):
                    now, at, n = (key, group), at_group, n_group
                first.append(at)
                counts.append(n)
                at, n = o[at], n + m[at]
            yield pd.DataFrame({"key": rows.key, "block": rows.block, "first": first, "begun": counts})

    kind = "key string, block long, out array<int>, n array<long>"
    levels = [blocks.mapInPandas(tables, kind)]
    longest = counts.groupBy("key").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    top = -(-longest // block)
    while top > 1:
        grouped = levels[-1].withColumn("group", F.expr(f"block div {FAN}"))
        levels.append(grouped.repartition("key", "group").sortWithinPartitions("key", "group", "block").mapInPandas(composed, kind))
        top = -(-top // FAN)
    entries = levels[-1].select("key", "block", F.lit(0).alias("first"), F.lit(0).cast("long").alias("begun"))
    for level in reversed(levels[:-1]):
        grouped = level.withColumn("group", F.expr(f"block div {FAN}")).join(entries.withColumnRenamed("block", "group"), ["key", "group"])
        entries = grouped.repartition("key", "group").sortWithinPartitions("key", "group", "block").mapInPandas(entered, "key string, block long, first int, begun long")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members = row["members"]
                after = next_starts(np.array([len(m["id"]) for m in members], np.int64), most, chars)
                size = min(block, len(members))
                starts, k = np.zeros(size, np.int64), row["first"]
                while k < size:
                    starts[k] = 1
                    k = after[k]
                batch_of = row["begun"] - 1 + np.cumsum(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]] * size, pa.string()), pa.array([m["position"] for m in members[:size]], pa.int64()), pa.array([m["id"] for m in members[:size]], pa.string()), pa.array(batch_of, pa.int64())],
                    ["key", "position", "id", "batch"],
                )

    return blocks.join(entries, ["key", "block"]).mapInArrow(dealt, "key string, position long, id string, batch long")


def batch_table(batched: DataFrame) -> DataFrame:
    """key, batch, ids (joined by commas, in order), n_ids: what each call asks for."""
    listed = batched.groupBy("key", "batch").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("l"))
    return listed.select("key", "batch", F.array_join(F.transform("l", lambda x: x["id"]), ",").alias("ids"), F.size("l").alias("n_ids"))
