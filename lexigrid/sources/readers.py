"""Readers with fixed schemas. Lines that don't fit raise, and say which line."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import doi_without_prefixes, strip, truthy

#: The columns of the files.
RANKING = "query_id string, question string, retrieval_mode string, rank int, doc_id string, chunk_id string, doi string, pmid string, title string, score double, candidate_origin string, selected_for_context boolean, corpus_version string, run_id string"
TASKS = "data struct<doi:string,title:string,abstract:string,year:int,journal:string,authors:array<string>,source:string,source_id:string>, annotations array<struct<result:array<struct<from_name:string,type:string,value:struct<choices:array<string>,rating:int,labels:array<string>,text:string>>>>>"
ANNOTATIONS = ("query_id", "question", "resolved_doc_id", "doc_id", "chunk_id", "doi", "pmid", "title", "relevance", "rationale", "annotator", "adjudication_status")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of every line. Files are read in blocks; a block's lines come after those of the blocks before it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    numbered = rows.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"])
    return numbered.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank lines are passed over, other text raises with its line's number. Adds line."""
    rows = read_lines(spark, path).where(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull() | ~strip(F.col("value")).startswith("{")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("line "), F.col("line"), F.lit(": not a JSON object"))).cast("string")).otherwise(F.col("value"))
    return rows.withColumn("_j", F.from_json(checked, schema)).select("_j.*", "line")


def read_json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A .jsonl file by lines, any other as one JSON value or array."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not path.endswith(".jsonl")).json(path)


def read_qrels(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Judgements from a file separated by tabs: query_id, doc_id, relevance. Another grade than 0, 1 and 2, and a pair given twice, raise."""
    out = spark.read.csv(path, sep="\t", header=header, schema="query_id string, doc_id string, relevance int", mode="FAILFAST", enforceSchema=not header)
    graded = F.when(F.col("relevance").isin(0, 1, 2), F.col("relevance")).otherwise(F.raise_error(F.lit("relevance must be 0, 1 or 2")).cast("int"))
    once = F.when(F.col("n") == 1, F.col("relevance")).otherwise(F.raise_error(F.lit("a pair is judged twice")).cast("int"))
    return out.withColumn("relevance", graded).groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"), F.count("*").alias("n")).select("query_id", "doc_id", once.alias("relevance"))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, RANKING)
    needed = F.when(F.col("query_id").isNull() | F.col("rank").isNull() | F.col("doi").isNull(), F.raise_error(F.concat(F.lit("line "), F.col("line"), F.lit(": query_id, rank and doi are required"))).cast("string")).otherwise(F.col("query_id"))
    return rows.withColumn("query_id", needed).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("doi_norm", doi_without_prefixes(F.col("doi")))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed texts; missing ones raise. Adds row, the number of the record in the file (the header is 1)."""
    raw = spark.read.csv(path, header=True, multiLine=True)
    if lacking := [c for c in ANNOTATIONS if c not in raw.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    trimmed = raw.select(*(strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ANNOTATIONS), F.monotonically_increasing_id().alias("at"))
    # rows before each partition, from one count per partition
    part = F.shiftrightunsigned("at", 33)
    counts = trimmed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = trimmed.withColumn("part", part).join(before, "part")
    return numbered.select(*ANNOTATIONS, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 2).alias("row"))


def read_sheet(spark: SparkSession, path: str, required: list[str], truths: list[str] = ()) -> DataFrame:
    """A screening sheet saved as CSV; an empty one, or one without a required column, raises."""
    out = spark.read.csv(path, header=True, multiLine=True)
    if lacking := [c for c in required if c not in out.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    if out.isEmpty():
        raise ValueError("the sheet has no rows")
    for c in truths:
        if c in out.columns:
            out = out.withColumn(c, truthy(F.col(f"`{c}`")))
    return out


def discover_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all CSV files under a folder, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    return files.select("path", "length").orderBy("path")


def task_labels(tasks: DataFrame, position: str = "position") -> DataFrame:
    """Labels of each DOI from the first annotation of its last task: doi, from_name, type, value."""
    known = tasks.withColumn("doi", doi_without_prefixes(F.col("data.doi"))).where("doi <> '' AND size(annotations) > 0")
    last = known.groupBy("doi").agg(F.max_by(F.col("annotations")[0]["result"], position).alias("result"))
    value = F.coalesce(F.array_join("r.value.choices", "|"), F.col("r.value.rating").cast("string"), F.array_join("r.value.labels", "|"), F.col("r.value.text"))
    return last.select("doi", F.explode("result").alias("r")).select("doi", "r.from_name", "r.type", value.alias("value"))


def xml_text(text: Column) -> Column:
    """A text as it stands between the tags of an XML element. Control characters, which XML cannot hold, stay."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def article_records(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Literature records of XML texts (one article each): pmid, doi, title, journal, year, abstract, authors, mesh.

    A text that is no XML gives nulls, whatever stands beside it. Trees are read in Arrow batches; markup inside a title is dropped, its words stay.
    """
    kind = "pmid string, doi string, title string, journal string, year int, abstract string, authors array<string>, mesh array<string>"

    def record(text: str | None) -> dict:
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return {}
        words = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else None
        first = lambda path: words(root.find(f".//{path}"))
        people = [" ".join(x for x in (words(a.find("ForeName")), words(a.find("LastName"))) if x) or words(a.find("CollectiveName")) for a in root.iterfind(".//Author")]
        parts = [(f"{e.get('Label')}: " if e.get("Label") else "") + (words(e) or "") for e in root.iterfind(".//AbstractText")]
        date = first("PubDate") or ""
        year = next((int(w[:4]) for w in date.split() if w[:4].isdigit() and len(w) >= 4), None)
        doi = next((words(e) for e in root.iterfind(".//ArticleId") if e.get("IdType") == "doi"), None)
        return {"pmid": first("PMID"), "doi": doi, "title": first("ArticleTitle"), "journal": first("Journal/Title"), "year": year, "abstract": "\n\n".join(parts) or None, "authors": [p for p in people if p], "mesh": [words(e) for e in root.iterfind(".//DescriptorName")]}

    @F.pandas_udf(kind)
    def parse(texts: pd.Series) -> pd.DataFrame:
        # columns of objects: else pandas puts NaN, which is no list, where a record is lacking
        records = [record(t) for t in texts]
        return pd.DataFrame({name: pd.Series([r.get(name) for r in records], dtype=object) for name in (c.split()[0] for c in kind.split(", "))})

    return xml.withColumn("_r", parse(column)).select(*(c for c in xml.columns if c != column), "_r.*")


def body_text(column: Column) -> Column:
    """Text of the first body of full-text XML: titles and paragraphs of its sections, nested ones after their own, between blank
    lines; without sections all of its text. '' without a body, null for what is no XML."""

    def plain(e) -> str:
        return " ".join("".join(e.itertext()).split())

    def name(e) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def blocks(section) -> list[str]:
        out = [plain(e) for e in section if name(e) == "title"]
        for e in section:
            out += blocks(e) if name(e) == "sec" else [plain(e)] if name(e) != "title" else []
        return [b for b in out if b]

    def read(text: str | None) -> str | None:
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return None
        body = next((e for e in root.iter() if name(e) == "body"), None)
        if body is None:
            return ""
        found = [b for s in body if name(s) == "sec" for b in blocks(s)]
        return "\n\n".join(found) or plain(body)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(read)

    return run(column)


#: The elements of bulk literature files that are read.
BULK = (
    "MedlineCitation struct<PMID:string, Article:struct<Journal:struct<Title:string, JournalIssue:struct<PubDate:struct<Year:string>>>, ArticleDate:array<struct<Year:string>>, "
    "AuthorList:struct<Author:array<struct<LastName:string, Initials:string, CollectiveName:string>>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string, _IdType:string>>>>"
)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Records of bulk literature files: pmid, doi, journal, year, authors (family name and initials, or the group's name), one row per pmid.

    Files are read in parts by Spark's own XML source, one article element at a time. Articles without a pmid, or with nothing else, go; of several
    of one pmid the last of the last file counts. A year of other than digits is none, and an issue's year comes before an article's.
    """
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(BULK).load(path).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    text = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    article = "MedlineCitation.Article"
    dois = F.filter("PubmedData.ArticleIdList.ArticleId", lambda a: (F.lower(a["_IdType"]) == "doi") & (strip(a["_VALUE"]) != ""))
    year = F.coalesce(strip(F.col(f"{article}.Journal.JournalIssue.PubDate.Year")), strip(F.get(F.filter(F.col(f"{article}.ArticleDate.Year"), lambda y: y.isNotNull()), F.lit(0))))
    filled = lambda c: F.nullif(c, F.lit(""))
    name = lambda a: F.when(filled(a["LastName"]).isNotNull(), F.concat_ws(" ", a["LastName"], filled(a["Initials"]))).otherwise(filled(a["CollectiveName"]))
    people = F.filter(F.transform(f"{article}.AuthorList.Author", name), lambda n: n.isNotNull())
    rows = raw.select(text("MedlineCitation.PMID").alias("pmid"), strip(F.get(dois, F.lit(0))["_VALUE"]).alias("doi"), text(f"{article}.Journal.Title").alias("journal"), F.when(year.rlike(r"^\d+$"), year).try_cast("int").alias("year"), F.when(F.size(people) > 0, people).alias("authors"), "_file", "_at")
    kept = rows.where("pmid IS NOT NULL AND (doi IS NOT NULL OR journal IS NOT NULL OR year IS NOT NULL OR authors IS NOT NULL)")
    return kept.groupBy("pmid").agg(F.max_by(F.struct("doi", "journal", "year", "authors"), F.struct("_file", "_at")).alias("r")).select("pmid", "r.*")


def read_id_table(spark: SparkSession, path: str) -> DataFrame:
    """pmid, doi, pmcid from tables of ids separated by tabs, whose columns stand in any order and case under the first line of each file.

    Lines are trimmed first, blank ones are passed over. Files without a pmid column give nothing, rows without a pmid, or without either
    other id, go; of several rows of one pmid the last line of the last file counts.
    """
    lines = read_lines(spark, path).withColumn("value", strip(F.col("value"))).where("value <> ''")
    heads = lines.groupBy("file").agg(F.min("line").alias("first"), F.min_by("value", "line").alias("head"))
    names = F.transform(F.split("head", "\t"), lambda h: F.lower(strip(h)))
    # of two columns of one name the later one counts
    place = lambda name: F.when(F.array_contains(names, name), F.size(names) - F.array_position(F.reverse(names), name))
    heads = heads.select("file", "first", *(place(n).cast("int").alias(f"_{n}") for n in ("pmid", "doi", "pmcid"))).where("_pmid IS NOT NULL")
    cell = lambda name: F.nullif(strip(F.get(F.split("value", "\t"), F.col(f"_{name}"))), F.lit("")).alias(name)
    rows = lines.join(heads, "file").where("line > first").select("file", "line", cell("pmid"), cell("doi"), cell("pmcid"))
    kept = rows.where("pmid IS NOT NULL AND (doi IS NOT NULL OR pmcid IS NOT NULL)")
    return kept.groupBy("pmid").agg(F.max_by(F.struct("doi", "pmcid"), F.struct("file", "line")).alias("r")).select("pmid", "r.*")
