"""As-of joins: the last row of another table at or before a time, without pairing rows and without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, tie: Column | None = None, seconds: int = 86_400, name: str = "last") -> DataFrame:
    """left with the struct `name`: the row of right of the same `on` whose time is the last at or before left's; null without one.

    Of rows of one time the largest `tie` (a column of right) comes last, else any. Time is cut into stretches of `seconds`: rows meet the rows of
    their own stretch in order, and of all earlier ones only the last. So a key that has most rows is spread over as many tasks as
    it has stretches. Rows of right without a key or a time are never the last; rows of left without one get null.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    stretch = F.floor(F.col("_t") / (seconds * 1_000_000))
    a = left.select(F.col(on).alias("_k"), micros(left_time).alias("_t"), F.struct(*(left[c] for c in left.columns)).alias("_row"))
    b = right.withColumn("_t", micros(right_time)).withColumn("_tie", F.lit(0) if tie is None else tie).where(F.col(on).isNotNull() & F.col("_t").isNotNull())
    b = b.select(F.col(on).alias("_k"), "_t", "_tie", F.struct(*(F.col(c) for c in right.columns)).alias("_last")).withColumn("_s", stretch)
    ends = b.groupBy("_k", "_s").agg(F.max_by("_last", F.struct("_t", "_tie")).alias("_end"))
    a = a.withColumn("_s", stretch)
    # stretches of either table, with the last row before each
    asked = a.where("_k IS NOT NULL AND _t IS NOT NULL").select("_k", "_s").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    known = ends.unionByName(asked).groupBy("_k", "_s").agg(F.max_by("_end", F.col("_end").isNotNull()).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    known = known.select("_k", "_s", before.alias("_before"))
    none_row, none_last = F.lit(None).cast(a.schema["_row"].dataType), F.lit(None).cast(ends.schema["_end"].dataType)
    tie_type = b.schema["_tie"].dataType
    both = b.select("_k", "_s", "_t", F.lit(0).alias("_side"), "_tie", "_last", none_row.alias("_row")).unionByName(a.select("_k", "_s", "_t", F.lit(1).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), none_last.alias("_last"), "_row"))
    inside = F.last("_last", ignorenulls=True).over(Window.partitionBy("_k", "_s").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_in", inside).where("_side = 1").join(known, ["_k", "_s"], "left")
    return found.select("_row.*", F.coalesce(F.when(F.col("_t").isNotNull() & F.col("_k").isNotNull(), F.col("_in")), F.col("_before")).alias(name))
