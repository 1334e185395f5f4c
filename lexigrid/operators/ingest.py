"""Batches of items on their way into the index: split, duplicates, jobs, points, and the index's own writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ports, status
from ..functions.dates import valid_year
from ..functions.ids import document_id, point_id
from ..functions.text import canonical_doi, first_nonblank, name_list, nonblank, strip


def split_valid(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a DOI (doi_normalized, doc_id added), and those without."""
    known = items.withColumn("doi_normalized", canonical_doi(F.col("doi")))
    return known.where("doi_normalized <> ''").withColumn("doc_id", document_id(F.col("doi_normalized"))), known.where("doi_normalized = ''")


def mark_duplicates(items: DataFrame, key: str = "doc_id", order: str = "position") -> DataFrame:
    """The first of each key is queued, later ones are skipped."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return items.withColumn("_n", n).withColumn("state", F.when(F.col("_n") == 1, "queued").otherwise("skipped_duplicate")).withColumn("message", F.when(F.col("_n") > 1, "duplicate_doi")).drop("_n")


def build_job(items: DataFrame, indexed: DataFrame) -> DataFrame:
    """Items of one batch (position, doi, ...) with their states: invalid, skipped (in the batch or the index), queued."""
    valid, invalid = split_valid(items)
    marked = mark_duplicates(valid)
    there = indexed.select("doc_id").distinct().withColumn("_in", F.lit(True))
    marked = marked.join(there, "doc_id", "left").withColumn("state", F.when(F.col("_in"), "skipped_duplicate").otherwise(F.col("state"))).withColumn("message", F.when(F.col("_in"), "already_indexed").otherwise(F.col("message"))).drop("_in")
    bad = invalid.withColumn("doc_id", F.lit(None).cast("string")).withColumn("state", F.lit("failed")).withColumn("message", F.lit("invalid_doi"))
    return bad.select(marked.columns).unionByName(marked)


def job_counts(items: DataFrame, key: str = "job_id") -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    out = items.groupBy(key).agg(F.count("*").alias("total"), n("succeeded").alias("succeeded"), n("failed").alias("failed"), n("skipped_duplicate").alias("skipped_duplicate"))
    return out.withColumn("state", status.job_state(F.col("failed"), F.col("succeeded")))


def apply_outcomes(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items with the states that processing gave (done: doi, state, message; the last by position wins); ones that no item has are failures."""
    last = F.row_number().over(Window.partitionBy("doi").orderBy(F.desc("position")))
    new = done.withColumn("_n", last).where("_n = 1").select("doi", F.col("state").alias("_state"), F.col("message").alias("_message"), F.lit(True).alias("_new"))
    out = items.join(new, "doi", "full_outer")
    unexpected = F.col("state").isNull() & F.col("_new")
    return out.select("doi", F.when(unexpected, "failed").otherwise(F.coalesce("_state", "state")).alias("state"), F.when(unexpected, "unexpected_doi").when(F.col("_new"), F.col("_message")).otherwise(F.col("message")).alias("message"))


def points(chunks: DataFrame) -> DataFrame:
    """Chunks with the ids under which the index keeps them."""
    return chunks.withColumn("point_id", point_id(F.col("doc_id"), F.col("chunk_index")))


#: What a point keeps of its item, beside the chunk's own fields.
PAYLOAD = ("job_id", "doc_id", "doi_original", "doi_normalized", "title", "journal", "year", "authors", "disease", "source_type")


def embedded_chunks(texts: Column, make: Callable[[], Callable] = ports.hashing_embedder) -> Column:
    """struct(vectors, error) for the array of an item's texts. The model sees one item at a time; what it raises becomes the error."""

    @F.pandas_udf("struct<vectors:array<array<float>>,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for series in batches:
            rows = []
            for own in series:
                try:
                    rows.append(([[float(x) for x in v] for v in model(list(own))] if own is not None and len(own) else [], None))
                except Exception as e:  # noqa: BLE001: a model may raise anything, and another item must not suffer
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"vectors": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})

    return run(texts)


def ingest_documents(items: DataFrame, indexed: DataFrame, cut: Callable[[Column], Column], make: Callable[[], Callable] = ports.hashing_embedder) -> DataFrame:
    """items with chunks, vectors and `failure`: null for those that become points, else why not, one row for each item.

    items: doc_id (unique in the batch), content_text, others; indexed: doc_id; cut: from a text to an array of struct(index, text, start, end,
    section, subsection) or without the last two. Failures, the first that holds: empty_document_text, no_chunks, embedding_failed (with the model's
    words in failure_detail), embedding_count_mismatch, invalid_vector_size, duplicate_doc. The model is costly, so store the result before reading it twice.
    """
    text = strip(F.coalesce("content_text", F.lit("")))
    rows = items.withColumn("chunks", F.when(text != "", cut(text)))
    rows = rows.withColumn("_e", embedded_chunks(F.transform("chunks", lambda c: c["text"]), make))
    known = indexed.select("doc_id").distinct().withColumn("_in", F.lit(True))
    rows = rows.join(known, "doc_id", "left")
    failure = (
        F.when(text == "", "empty_document_text")
        .when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, "no_chunks")
        .when(F.col("_e.error").isNotNull(), "embedding_failed")
        .when(F.size("_e.vectors") != F.size("chunks"), "embedding_count_mismatch")
        .when(F.size(F.get("_e.vectors", F.lit(0))) <= 0, "invalid_vector_size")
        .when(F.col("_in"), "duplicate_doc")
    )
    return rows.select(*items.columns, "chunks", F.col("_e.vectors").alias("vectors"), failure.alias("failure"), F.col("_e.error").alias("failure_detail"))


def item_statuses(ingested: DataFrame) -> DataFrame:
    """doc_id, state, message, n_points of every item of ingest_documents()."""
    whole = F.col("failure").isNull()
    state = F.when(whole, "succeeded").when(F.col("failure") == "duplicate_doc", "skipped_duplicate").otherwise("failed")
    return ingested.select("doc_id", state.alias("state"), F.col("failure").alias("message"), F.when(whole, F.size("chunks")).otherwise(0).alias("n_points"))


def item_points(ingested: DataFrame, created_at: Column) -> DataFrame:
    """Points of the items that didn't fail: point_id, vector, chunk_index, chunk_start, chunk_end, text, section, subsection, created_at, and PAYLOAD as far as items have it."""
    fields = ingested.schema["chunks"].dataType.elementType.names
    whole = ingested.where("failure IS NULL").select(*(c for c in PAYLOAD if c in ingested.columns), F.explode(F.arrays_zip(F.col("chunks").alias("c"), F.col("vectors").alias("v"))).alias("_p"))
    part = lambda name: F.col(f"_p.c.{name}") if name in fields else F.lit(None).cast("string")
    out = whole.withColumn("chunk_index", part("index"))
    return out.select(point_id(F.col("doc_id"), F.col("chunk_index")).alias("point_id"), F.col("_p.v").alias("vector"), "chunk_index", part("start").alias("chunk_start"), part("end").alias("chunk_end"), part("text").alias("text"), part("section").alias("section"), part("subsection").alias("subsection"), created_at.alias("created_at"), *(c for c in whole.columns if c != "_p"))


def upserted(index: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The index with new rows in place of old ones of the same key; of several new ones the last by `position`."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("position")))
    rows = new.withColumn("_n", last).where("_n = 1").select(index.columns)
    return index.join(rows, key, "left_anti").unionByName(rows)


def without_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def first_of_each(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, as it is written."""
    n = F.row_number().over(Window.partitionBy("_k").orderBy(order))
    return rows.withColumn("_k", key).withColumn("_n", n).where("_n = 1").drop("_k", "_n")


def coalesce_sources(tasks: DataFrame, key: str, sources: Sequence[DataFrame], fields: Sequence[str]) -> DataFrame:
    """Each field from the first source, in this order, that has it; the task's own value comes first."""
    out = tasks
    for i, source in enumerate(sources):
        out = out.join(source.select(key, *(F.col(f).alias(f"_{i}_{f}") for f in fields)), key, "left")
    own = [F.col(f) for f in fields if f in tasks.columns]
    picked = [F.coalesce(*([F.col(f)] if f in tasks.columns else []), *(F.col(f"_{i}_{f}") for i in range(len(sources)))).alias(f) for f in fields]
    return out.select(*(c for c in tasks.columns if c not in fields), *picked) if own or picked else out


def reject_reasons(df: DataFrame) -> Column:
    """What a task lacks, in this order: source, source_id, doi, year, journal, authors, title, abstract."""
    lacks = lambda c: nonblank(F.col(c).cast("string")).isNull()
    authors = F.col("authors").isNull() | (F.size("authors") <= 0) | F.exists("authors", lambda a: nonblank(a).isNull())
    rules = [*((lacks(c), f"missing {c}") for c in ("source", "source_id", "doi")), (~valid_year(F.col("year")), "missing or invalid year"), (lacks("journal"), "missing journal"), (authors, "missing authors"), (lacks("title"), "missing title"), (lacks("abstract"), "missing abstract")]
    return F.array_compact(F.array(*(F.when(rule, F.lit(text)) for rule, text in rules)))


def ingest_items(tasks: DataFrame) -> DataFrame:
    """Tasks as items to ingest; those that lack a field go."""
    out = tasks.select(*(strip(F.col(c)).alias(c) for c in ("doi", "title", "journal")), F.col("year").try_cast("int").alias("year"), "authors", first_nonblank(F.col("abstract")).alias("content_text"))
    whole = F.forall("authors", lambda a: nonblank(a).isNotNull())
    return out.where("doi <> '' AND title <> '' AND journal <> '' AND year IS NOT NULL AND content_text IS NOT NULL").where(F.col("authors").isNotNull() & whole)


def screening(df: DataFrame, excluded: str | None = None, unrelated: str | None = None, reporting: str | None = None) -> DataFrame:
    """Rows not excluded, not unrelated and reporting; a column that isn't there filters nothing."""
    for name, wanted in ((excluded, False), (unrelated, False), (reporting, True)):
        if name and name in df.columns:
            df = df.where(F.coalesce(F.col(f"`{name}`"), F.lit(False)) == wanted)
    return df


def author_names(authors: Column) -> Column:
    return name_list(authors)


def ensure_table(spark: SparkSession, name: str, ddl: str, partition: str | None = None) -> None:
    """The table of an index, if it isn't there yet."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet" + (f" PARTITIONED BY ({partition})" if partition else ""))
