"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

A limit keeps min(length, limit) tokens of each document. Between two lengths that occur, the total kept grows
by one for each longer document and each token, so the sums at the lengths that occur answer for every limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column

#: Lengths whose sums are taken together, so that no task orders all lengths.
RANGE = 1024


def count_lengths(docs: DataFrame, model: str | None = None, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many texts have each encoded length. Null and empty texts have none (length 0)."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
        counts: Counter = Counter()
        for batch in batches:
            for text in column(batch, text_col):
                counts[len(encode(text.as_py() or ""))] += 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n_docs"])

    return docs.select(text_col).mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs: n_tokens, n_docs, docs_up_to (documents of that length or less), docs_over (longer ones),
    tokens_over (their tokens), truncated_total (tokens kept under that limit), total_docs, total_tokens.

    An empty histogram gives an empty table.
    """
    h = histogram.withColumn("range", F.expr(f"n_tokens div {RANGE}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    zero = F.lit(0).cast("long")
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(later), zero).alias("later_docs"), F.coalesce(F.sum("t").over(later), zero).alias("later_tokens"))
    totals = histogram.agg(F.sum("n_docs").alias("total_docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total_tokens"))
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(ranges, "range").withColumn("docs_over", F.coalesce(F.sum("n_docs").over(inside), zero) + F.col("later_docs")).withColumn("tokens_over", F.coalesce(F.sum("tokens").over(inside), zero) + F.col("later_tokens"))
    kept = F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return out.join(F.broadcast(totals)).select("n_tokens", "n_docs", (F.col("total_docs") - F.col("docs_over")).alias("docs_up_to"), "docs_over", "tokens_over", kept.alias("truncated_total"), "total_docs", "total_tokens")


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens kept of all documents under any limit (from a length_table)."""
    row = table.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).first()
    if row is not None:
        return row["truncated_total"] + (limit - row["n_tokens"]) * row["docs_over"]
    first = table.first()
    return 0 if first is None else max(limit, 0) * first["total_docs"]


def length_quantile(table: DataFrame, share: float) -> int | None:
    """Least length that at least `share` of the documents don't exceed; null without documents."""
    row = table.where(F.col("docs_up_to") >= F.col("total_docs") * share).orderBy("n_tokens").first()
    return None if row is None else row["n_tokens"]
