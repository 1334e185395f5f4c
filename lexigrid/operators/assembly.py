"""Documents from their chunks, and contexts under a budget. Orders that matter are folded inside the JVM, per document or query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso
from ..functions.text import first_nonblank, strip, truncated


def overlap_text(parts: str) -> Column:
    """One text of a column of parts (array of start, end, index, text): what an earlier part covers is left out. An end under 0 means start + length."""
    fold = """aggregate(array_sort({0}), named_struct('text', '', 'at', 0L),
      (acc, p) -> named_struct(
        'text', concat(acc.text, CASE WHEN length(p.text) = 0 OR IF(p.end >= 0, p.end, p.start + length(p.text)) <= acc.at THEN ''
                                      WHEN p.start < acc.at THEN substring(p.text, cast(acc.at - p.start + 1 as int)) ELSE p.text END),
        'at', CASE WHEN length(p.text) = 0 THEN acc.at
                   WHEN IF(p.end >= 0, p.end, p.start + length(p.text)) <= acc.at THEN acc.at
                   WHEN p.start < acc.at AND acc.at - p.start >= length(p.text) THEN acc.at
                   ELSE IF(p.end >= 0, p.end, p.start + length(p.text)) END),
      acc -> acc.text)"""
    return F.expr(fold.format(parts))


def assemble(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks (chunk_id, chunk_index, start, end, section, chunk_text) of each key as one document: text, chunk_ids and sections in order."""
    part = F.struct(F.coalesce(F.col("start").cast("long"), F.lit(0)).alias("start"), F.coalesce(F.col("end").cast("long"), F.lit(-1)).alias("end"), F.coalesce(F.col("chunk_index").cast("long"), F.lit(0)).alias("index"), F.coalesce("chunk_text", F.lit("")).alias("text"))
    listed = F.struct(F.coalesce(F.col("chunk_index").cast("long"), F.lit(0)).alias("index"), "chunk_id", "section")
    grouped = chunks.groupBy(*keys).agg(F.collect_list(part).alias("parts"), F.array_sort(F.collect_list(listed)).alias("listed"))
    return grouped.withColumn("text", overlap_text("parts")).select(*keys, "text", F.transform("listed", lambda x: x["chunk_id"]).alias("chunk_ids"), F.array_distinct(F.filter(F.transform("listed", lambda x: x["section"]), lambda x: x.isNotNull())).alias("sections"))


def lookup_documents(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of each key joined by line breaks in order of their index, their sections, and the latest of updated_at or created_at."""
    at = iso(first_nonblank(F.col("updated_at"), F.col("created_at")))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("chunk_index").cast("long"), F.lit(0)).alias("i"), "chunk_id", "chunk_text", "section")))
    out = chunks.groupBy(*keys).agg(listed.alias("l"), F.max(at).alias("updated_at"), F.count("*").alias("n_chunks"))
    return out.select(*keys, F.array_join(F.transform("l", lambda x: x["chunk_text"]), "\n").alias("text"), F.array_distinct(F.transform("l", lambda x: x["section"])).alias("sections"), F.coalesce("updated_at", F.current_timestamp()).alias("updated_at"), "n_chunks")


def distinct_dois(chunks: DataFrame) -> DataFrame:
    return chunks.select(first_nonblank(F.col("doi_original"), F.col("doi_normalized"), F.col("doi")).alias("doi")).where("doi IS NOT NULL").distinct()


#: What stands around a chunk in a context; the chunk's id and section go between.
HEAD, SECTION, FOOT = "\nCHUNK ", " | SECTION: ", "\nENDCHUNK\n"


def pack_context(ranked: DataFrame, max_chars: int = 60_000, max_chunks: int = 6) -> DataFrame:
    """For each query, chunks in order of rank that fit the budget: query_id, chunk_ids, context, n_chars.

    A chunk takes its text and the lines around it. The last one is shortened if at least its lines fit; one that
    doesn't fit is passed over, and later ones may still fit. Blank chunks don't count. This is a fold, not a
    running sum: what is taken depends on what was.
    """
    chunk = F.struct("rank", strip(F.coalesce("chunk_id", F.lit(""))).alias("id"), strip(F.coalesce("section", F.lit(""))).alias("section"), strip(F.coalesce("chunk_text", F.lit(""))).alias("text"))
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    limit = max_chars if max_chars > 0 else 60_000

    def step(acc: Column, c: Column) -> Column:
        head = F.concat(F.lit(HEAD), c["id"], F.when(c["section"] != "", F.concat(F.lit(SECTION), c["section"])).otherwise(F.lit("")), F.lit("\n"))
        room = F.lit(limit) - acc["used"] - F.length(head) - len(FOOT)
        body = truncated(c["text"], room)
        fits = (c["id"] != "") & (c["text"] != "") & (room > 0) & (F.length(body) > 0) & (F.size(acc["ids"]) < max_chunks)
        return F.struct(
            F.when(fits, F.concat(acc["text"], head, body, F.lit(FOOT))).otherwise(acc["text"]).alias("text"),
            F.when(fits, acc["used"] + F.length(head) + F.length(body) + len(FOOT)).otherwise(acc["used"]).cast("int").alias("used"),
            F.when(fits, F.array_append(acc["ids"], c["id"])).otherwise(acc["ids"]).alias("ids"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.expr("cast(array() as array<string>)").alias("ids"))
    return listed.select("query_id", F.aggregate("chunks", start, step).alias("c")).select("query_id", F.col("c.ids").alias("chunk_ids"), strip(F.col("c.text")).alias("context"), F.col("c.used").alias("n_chars"))


def cap_texts(texts: Column, most: int, each: int, total: int) -> Column:
    """The first `most` nonblank texts, each cut to `each` characters, together to `total` (0: no limit)."""
    kept = F.slice(F.filter(F.transform(texts, strip), lambda x: x.isNotNull() & (x != "")), 1, most)

    def step(acc: Column, x: Column) -> Column:
        cut = F.when((F.lit(each) > 0) & (F.length(x) > each), F.regexp_replace(F.left(x, F.lit(each)), r"(?U)\s+$", "")).otherwise(x)
        room = F.lit(total) - acc["n"]
        over = (F.lit(total) > 0) & (acc["n"] + F.length(cut) > total)
        text = F.when(over, F.regexp_replace(F.left(cut, F.greatest(room, F.lit(0))), r"(?U)\s+$", "")).otherwise(cut)
        done = acc["done"] | (over & (room <= 0))
        return F.struct(F.when(done, acc["out"]).otherwise(F.array_append(acc["out"], text)).alias("out"), F.when(done, acc["n"]).otherwise(acc["n"] + F.length(text)).cast("int").alias("n"), done.alias("done"))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(kept, start, step, lambda acc: acc["out"])


def order_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
