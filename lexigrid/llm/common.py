"""Helpers that the training-data operators share: words, shared storage, Arrow columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder as shared_dir

#: bytes.split() without an argument cuts at exactly these bytes: the words are [^\x20\x09-\x0D]+.
WHITE = b" \t\n\v\f\r"


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text, null as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text; with lower, A-Z are lower-cased (other letters stay)."""
    raw = encode(text)
    return (raw.lower() if lower else raw).split()


#: Drops the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Lists that note the tables which are stored while they are in use (see noted()).
_notes: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later reads don't compute it again,
    and a lost executor takes none of it away. What was shuffled to make it goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigrid/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for tables in _notes:
        tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables. Only for tables that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """Notes the tables that are stored inside, so that their owner can discard them once the result they serve is written."""
    tables: list[DataFrame] = []
    _notes.append(tables)
    try:
        yield tables
    finally:
        _notes.remove(tables)


#: Tasks whose tables of numbers are added up together first.
FAN_IN = 256


def pack_numbers(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def numbers_of_task(parts: list[np.ndarray]) -> pa.RecordBatch:
    """The tables of one task for added_up(): part, task, cells."""
    from pyspark import TaskContext

    task = TaskContext.get()
    here = task.partitionId() if task else 0
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([here] * len(parts), pa.int32()), pa.array([pack_numbers(x) for x in parts], pa.binary())], ["part", "task", "cells"])


NUMBERS = "part int, task int, cells binary"


def added_up(tables: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """Sums of the tables (NUMBERS) of each part, added in the order of tasks, so a repeated task changes nothing.

    Up to FAN_IN tasks meet in one task, then their sums; either holds one running sum and reads the rest as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([pack_numbers(total)], pa.binary())], ["part", "task", "cells"])

        key, total = None, None
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            cells = column(batch, "cells")
            for k, now in enumerate(zip(column(batch, "part").to_pylist(), column(batch, "bundle").to_pylist(), strict=True)):
                x = np.frombuffer(expand(cells[k].as_py()), kind)
                if now == key:
                    total += x
                    continue
                if key is not None:
                    yield send()
                key, total = now, x.copy()
        if key is not None:
            yield send()

    for bundle in (F.expr(f"task div {FAN_IN}").cast("int"), F.lit(0)):
        tables = tables.withColumn("bundle", bundle).repartition("part", "bundle").sortWithinPartitions("part", "bundle", "task").mapInArrow(trimmed(run), NUMBERS)
    return {r["part"]: np.frombuffer(zstandard.ZstdDecompressor().decompress(r["cells"]), kind) for r in tables.collect()}


def trimmed(run):
    """run (for mapInArrow), after which its worker gives freed memory back to the machine: the next task there may need none of it, and
    the worker's idle memory counts against its executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library, that has no such call

    return wrapped


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    """The texts of one column, one at a time: a batch of long ones is never held twice."""
    for value in column(batch, name):
        yield value.as_py()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
