"""Documents as the service hands them out: looked up by DOI in the index, or fetched from a source and turned into items to ingest.

What a single request would raise is a status here, so one bad row never stops a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso
from ..functions.ids import document_id
from ..functions.text import canonical_doi, disease, first_nonblank, nonblank, strip

#: Topics and kinds of sources that the index knows.
TOPICS, KINDS = ("thrombosis", "unknown", "cancer"), ("pubmed_abstract", "other_abstract", "full_text")


def lookup_by_doi(requests: DataFrame, chunks: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per request (request_id unique, doi): request_id, status (found, not_found, validation_error), doc_id, doi, chunk_ids, sections (of
    each chunk), chunk_total, authors, journal, year, disease, source_type, title, content_text, updated_at.

    chunks: the index, with point_id, doc_id, chunk_index, text, section, doi_original, doi, doi_normalized, authors, journal, year, disease,
    source_type, title, updated_at, created_at. Texts are joined by line breaks in order of chunk_index; chunks without an index or a
    text come last, and add none. Fields are those of the smallest point_id; unknown topics and kinds become null. updated_at is the latest of the
    chunks' updated_at or else created_at, or `now` without any. Only chunks of wanted documents are moved.
    """
    asked = requests.select("request_id", F.col("doi").alias("asked"), canonical_doi(F.col("doi")).alias("_n"))
    asked = asked.withColumn("doc_id", F.when(F.col("_n") != "", document_id(F.col("_n"))))
    own = chunks.join(asked.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    whole = F.col("chunk_index").isNotNull() & F.col("text").isNotNull()
    part = F.struct((~whole).cast("int").alias("late"), F.when(whole, F.col("chunk_index").cast("long")).alias("i"), F.col("point_id").alias("chunk_id"), "section", F.when(whole, F.col("text")).alias("text"))
    fields = F.struct("doi_original", "doi", "doi_normalized", "authors", "journal", "year", "disease", "source_type", "title")
    found = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("l"), F.min_by(fields, "point_id").alias("p"), F.max(iso(first_nonblank(F.col("updated_at"), F.col("created_at")))).alias("at"))
    rows = asked.join(found, "doc_id", "left")
    status = F.when(F.col("_n") == "", "validation_error").when(F.col("p").isNull(), "not_found").otherwise("found")
    known = lambda c, values: F.when(F.col(f"p.{c}").isin(*values), F.col(f"p.{c}")).alias(c)
    filled = lambda c: F.nullif(F.col(f"p.{c}"), F.lit(""))
    there = F.col("p").isNotNull()
    return rows.select(
        "request_id", status.alias("status"), "doc_id", F.when(there, F.coalesce(filled("doi_original"), filled("doi"), filled("doi_normalized"), F.lit(""))).alias("doi"),
        F.transform("l", lambda x: x["chunk_id"]).alias("chunk_ids"), F.transform("l", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["section"].alias("section"))).alias("sections"),
        F.when(there, F.size("l")).alias("chunk_total"), "p.authors", "p.journal", "p.year", known("disease", TOPICS), known("source_type", KINDS), "p.title",
        F.array_join(F.transform(F.filter("l", lambda x: x["late"] == 0), lambda x: x["text"]), "\n").alias("content_text"),
        F.when(there, F.coalesce("at", F.current_timestamp() if now is None else now)).alias("updated_at"),
    )


def fetched_responses(fetched: DataFrame) -> DataFrame:
    """One row per fetch: its columns, status (ok, not_found), resolved_doi, resolved_pmid, content_text, source_type, content_text_source, full_text_available.

    fetched: requested_doi, requested_pmid, found (boolean: the source knows it), doi, pmid, full_text, abstract, others. The full text comes before the
    abstract if it isn't empty; a text that is blank then counts as none, and has no response.
    """
    full = F.coalesce("full_text", F.lit("")) != ""
    text = F.when(full, F.col("full_text")).otherwise(F.coalesce("abstract", F.lit("")))
    ok = F.coalesce("found", F.lit(False)) & (strip(text) != "")
    given = lambda a, b: F.when(ok, F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b)))
    return fetched.select(
        *fetched.columns, F.when(ok, "ok").otherwise("not_found").alias("status"), given("doi", "requested_doi").alias("resolved_doi"), given("pmid", "requested_pmid").alias("resolved_pmid"), F.when(ok, text).alias("content_text"),
        F.when(ok, F.when(full, "full_text").otherwise("pubmed_abstract")).alias("source_type"), F.when(ok, F.when(full, "pmc").otherwise("abstract")).alias("content_text_source"), F.when(ok, full).alias("full_text_available"),
    )


def fetched_items(responses: DataFrame) -> DataFrame:
    """Items to ingest from fetched_responses(); what has no response goes. Without a DOI the PubMed id stands in for it.

    The topic is found in title, abstract and text. responses: also title, journal, year, authors.
    """
    doi = F.coalesce("resolved_doi", F.lit(""))
    normal = canonical_doi(doi)
    stand_in = F.when((normal == "") & (doi == ""), F.concat(F.lit("pmid:"), F.coalesce("pmid", F.lit("")))).otherwise(doi)
    rows = responses.where("status = 'ok'").withColumn("doi_original", stand_in).withColumn("doi_normalized", F.when(normal != "", normal).otherwise(F.lower(stand_in)))
    topic = disease(*(F.coalesce(c, F.lit("")) for c in ("title", "abstract", "full_text")))
    none = F.expr("cast(array() as array<string>)")
    return rows.select("doi_original", "doi_normalized", document_id(F.col("doi_normalized")).alias("doc_id"), topic.alias("disease"), "source_type", "content_text", "year", "title", "journal", F.coalesce("authors", none).alias("authors"))


def document_index(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doi, doc_id of each DOI of an index file (line, doi, doc_id), the last line counts; and the DOIs that it gives several documents. Blank ones go."""
    rows = index.select("line", nonblank(F.lower(F.col("doi"))).alias("doi"), nonblank(F.col("doc_id")).alias("doc_id")).where("doi IS NOT NULL AND doc_id IS NOT NULL")
    grouped = rows.groupBy("doi").agg(F.max_by("doc_id", "line").alias("doc_id"), F.count_distinct("doc_id").alias("n"))
    return grouped.select("doi", "doc_id"), grouped.where("n > 1").select("doi", "n")
