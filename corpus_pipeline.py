"""The corpus pipeline: quality rules, near duplicates, repeated passages, source mix, token ids.

Each stage takes the columns of documents and all but the last return them. What a stage does with nulls, empty and very long
texts, ties, repeated rows, empty tables and further columns is what its operator does:

* quality: null and empty texts go, repeated rows share their fate;
* near_duplicates: of rows of equal id and text one stays; rows without an id come after those with one;
* repeated_passages: null texts become empty, all rows stay, also those whose texts are cut away as a whole;
* mix: all rows stay; a null source is a source; repeated rows stand together, other ties in any order;
* token_ids: null and empty texts have no ids.

Columns of other names are carried along up to the last stage, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import discard, noted, stored
from lexigrid.llm.ngram_join import one_of_each
from lexigrid.llm.quality_rules import keep_documents
from lexigrid.llm.sentencepiece_codec import encode_documents
from lexigrid.llm.source_mix import in_mix_order
from lexigrid.llm.suffix_dedup import without_repeats

#: Tables that the stage before stored for its result. It is written by then, so they go when the next stage begins.
_left: list[DataFrame] = []


def _stage(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    while _left:
        discard(_left.pop())
    with noted() as tables:
        out = work(docs)
    _left.extend(tables)
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _stage(docs, keep_documents)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _stage(docs, one_of_each)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand elsewhere too are cut out of the texts; all documents stay."""
    return _stage(docs, without_repeats)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources take turns."""
    return _stage(docs, in_mix_order)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their number."""
    return _stage(docs, lambda d: encode_documents(d, decode=False).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("token_ids", token_ids)]

#: SQL has no zstandard and no SentencePiece; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table documents; each works on what the one before left, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs
