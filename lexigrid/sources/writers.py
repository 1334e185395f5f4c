"""Writers. Tables go through Spark's own writers; the reports made on the driver are a few rows by definition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that is rendered on the driver.
REPORT_ROWS = 10_000
#: Most objects of one JSON array: a file of arrays can't be read in parts.
ARRAY_ROWS = 1_000_000


def write_three(df: DataFrame, path: str) -> None:
    """CSV, JSON lines and JSON arrays (one per file of the folder, and one file per ARRAY_ROWS rows) beside one another; NaN becomes null in both JSON forms."""
    if not path.endswith(".csv"):
        raise ValueError("the path must end in .csv")
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    stem = path.removesuffix(".csv")
    df.write.mode("overwrite").option("header", True).csv(path)
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(f"{stem}.jsonl")
    rows = clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("value"))
    files = -(-rows.count() // ARRAY_ROWS) or 1
    rows.repartition(files).mapInArrow(_arrays, "value string").write.mode("overwrite").text(f"{stem}.json")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one JSON array from a partition's objects, batch by batch."""
    opening = "["
    for batch in batches:
        lines = []
        for value in batch.column(0).to_pylist():
            lines.append(opening + value)
            opening = ","
        yield pa.record_batch([pa.array(lines, pa.string())], ["value"])
    yield pa.record_batch([pa.array(["[]" if opening == "[" else "]"], pa.string())], ["value"])


def write_rankings(df: DataFrame, path: str) -> None:
    """Rows in order of query, mode, rank, chunk and document; the files' names keep the order."""
    df.orderBy("query_id", "retrieval_mode", "rank", "chunk_id", "doc_id").write.mode("overwrite").json(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select("query_id", "doc_id", "relevance").orderBy("query_id", "doc_id").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def latex_table(df: DataFrame, columns: Sequence[str], missing: str = "") -> str:
    """A LaTeX table of a few rows: four places for numbers, `missing` for nulls."""
    rows = df.select(*columns).limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"over {REPORT_ROWS} rows are no report")
    show = lambda v: missing if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("_", "\\_").replace("%", "\\%")
    lines = [" & ".join(map(show, r)) + " \\\\" for r in rows]
    return "\n".join([f"\\begin{{tabular}}{{{'l' * len(columns)}}}", "\\hline", " & ".join(map(show, columns)) + " \\\\", "\\hline", *lines, "\\hline", "\\end{tabular}"])


def audit_rows(df: DataFrame, content: str) -> DataFrame:
    """Rows of the audit log: the content's hash and size beside it."""
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).withColumn("n_bytes", F.octet_length(content)).withColumn("logged_at", F.current_timestamp())
