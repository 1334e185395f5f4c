"""Where intermediate tables live: in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it names none, one in the warehouse, which off local[...] mustn't be a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local[") and (":" not in folder or folder.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder}/shared"


def computed_once(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there by all that comes after; Spark removes it when nothing refers to it any more."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
