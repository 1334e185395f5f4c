"""Tables of the latest row of each key, cut into buckets by key, so that an upsert rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import nonblank, strip

BUCKETS = 64


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def upsert_latest(batch: DataFrame, path: str, keys: Sequence[str], order: str, buckets: int = BUCKETS) -> None:
    """Merge a batch into the table at path: of each key the row of largest `order` stays, of the batch if both have it.

    Only the touched buckets are read and written, each as a partition that takes the place of the old one when all are written, so merging the same
    batch again, or a micro-batch that runs again, changes nothing. Numbers of touched buckets pass the driver, `buckets` at most.
    One writer at a time; `buckets` mustn't change in the life of a table.
    """
    spark = batch.sparkSession
    new = batch.withColumn("bucket", _bucket(keys, buckets)).withColumn("_new", F.lit(1))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    if not touched:
        return
    if _exists(spark, path):
        old = spark.read.schema(new.drop("_new").schema).parquet(path).where(F.col("bucket").isin(touched)).withColumn("_new", F.lit(0))
        new = new.unionByName(old)
    place = F.row_number().over(Window.partitionBy("bucket", *keys).orderBy(F.desc(order), F.desc("_new")))
    rows = new.withColumn("_n", place).where("_n = 1").drop("_n", "_new")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_latest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table's rows, without their buckets; without a table, none of the given schema."""
    if schema is not None and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, bucket int")
    return reader.parquet(path).drop("bucket")


#: What can be asked of a saved query.
COMMANDS = ("create", "update", "enable", "disable")


def saved_query_changes(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of commands on saved queries, and the queries after them.

    commands: query_id, at (unique in a query), command, pubmed_query, description, enabled. Outcomes: query_id, at, command, outcome (created, updated,
    enabled, disabled, exists, not_found, or what is invalid); queries: query_id, pubmed_query, description, enabled, created_at, updated_at, texts
    trimmed. A query begins with its first valid creation; texts mustn't be blank. Facts of each query are sums and extremes
    that are taken before rows are shuffled, so one query may have most commands.
    """
    text, words = nonblank(F.col("pubmed_query")), nonblank(F.col("description"))
    writes = F.col("command").isin("create", "update")
    invalid = F.when(writes & text.isNull(), "invalid: pubmed_query").when(writes & words.isNull(), "invalid: description").when(~F.col("command").isin(*COMMANDS), "invalid: command")
    rows = commands.where("query_id IS NOT NULL AND at IS NOT NULL").withColumn("_bad", invalid)
    begun = rows.where("command = 'create' AND _bad IS NULL").groupBy("query_id").agg(F.min("at").alias("created_at"))
    known = rows.join(begun, "query_id", "left")
    first, late = F.col("at") == F.col("created_at"), F.col("created_at").isNull() | (F.col("at") < F.col("created_at"))
    outcome = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when((F.col("command") == "create") & first, "created").when(late, "not_found").when(F.col("command") == "create", "exists").otherwise(F.concat("command", F.lit("d")))
    told = known.withColumn("outcome", outcome)
    done = told.where(F.col("outcome").isin("created", "updated", "enabled", "disabled"))
    written = F.when(F.col("outcome").isin("created", "updated"), F.col("at"))
    switch = F.when(F.col("outcome") == "created", F.coalesce("enabled", F.lit(True))).otherwise(F.col("outcome") == "enabled")
    switched = F.when(F.col("outcome") != "updated", F.col("at"))
    queries = done.groupBy("query_id").agg(F.max_by(strip(F.col("pubmed_query")), written).alias("pubmed_query"), F.max_by(strip(F.col("description")), written).alias("description"), F.max_by(switch, switched).alias("enabled"), F.max("created_at").alias("created_at"), F.max("at").alias("updated_at"))
    return told.select("query_id", "at", "command", "outcome"), queries


def complete(rows: DataFrame, completions: DataFrame, key: str, fields: Sequence[str], time: str = "finished_at") -> DataFrame:
    """rows (runs, or executions of queries) with the fields of their last completion by `time`; rows without one stay as they are, and completions of unknown rows go."""
    last = completions.groupBy(key).agg(F.max_by(F.struct(*fields, time), time).alias("_c"))
    out = rows.join(last, key, "left")
    named = [*fields, time]
    own = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return out.select(*(c for c in rows.columns if c not in named), *(F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(own(c)).alias(c) for c in named))
