"""Gold sets out of labelled tasks, and what is held against them: factors by DOI, audits of answers, metadata of a pool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..functions.text import digits_to_int, doi_from_plain, nonblank, plain, plain_spaced, squeeze, strip
from .evaluation import alias_hits

RESULT = "array<struct<from_name:string,type:string,value:struct<choices:array<string>,rating:string,labels:array<string>,text:array<string>>>>"


def first_choice(results: Column, field: str) -> Column:
    """The first choice of the first answer to the field that has one; '' without."""
    own = F.filter(results, lambda r: (r["from_name"] == field) & (r["type"] == "choices") & (F.size(r["value"]["choices"]) > 0))
    return F.coalesce(strip(F.get(F.get(own, F.lit(0))["value"]["choices"], F.lit(0))), F.lit(""))


def first_rating(results: Column, field: str) -> Column:
    """The rating of the first answer to the field, null if it is no whole number."""
    own = F.filter(results, lambda r: (r["from_name"] == field) & (r["type"] == "rating") & r["value"].isNotNull())
    return digits_to_int(F.get(own, F.lit(0))["value"]["rating"])


def reason_texts(results: Column, field: str) -> Column:
    """All texts of the answers to the field, trimmed, blank ones left out."""
    own = F.flatten(F.transform(F.filter(results, lambda r: (r["from_name"] == field) & r["value"]["text"].isNotNull()), lambda r: r["value"]["text"]))
    return F.filter(F.transform(F.coalesce(own, F.expr("cast(array() as array<string>)")), strip), lambda t: t.isNotNull() & (t != ""))


def gold_factors(tasks: DataFrame, aliases: DataFrame, field: str, positive: str, confidence: str, reasons: str, least: int = 3, missing: bool = True, abstracts: bool = True) -> DataFrame:
    """doi, factors: the canonical names that positive tasks of enough confidence give as reasons.

    tasks: task (a unique id), doi, abstract, result (the first annotation's, RESULT); aliases: canonical, alias. With `abstracts` the
    abstract stands in where there are no reasons, or none of them names a factor. Without a rating a task counts if `missing`. Sets
    of tasks of one DOI are joined; a kept DOI without factors has an empty set. Tasks without a DOI or a result go.
    """
    choice, rating = first_choice(F.col("result"), field), first_rating(F.col("result"), confidence)
    kept = tasks.withColumn("doi", doi_from_plain(F.col("doi"))).where((F.col("doi") != "") & F.col("result").isNotNull())
    kept = kept.where(plain_spaced(choice) == plain_spaced(F.lit(positive))).where(F.coalesce(rating >= least, F.lit(missing)))
    kept = kept.select("task", "doi", nonblank(F.col("abstract")).alias("abstract"), reason_texts(F.col("result"), reasons).alias("r"))
    texts = [("r", F.array_join("r", "\n"))] + ([("a", F.coalesce("abstract", F.lit("")))] if abstracts else [])
    long = kept.select("task", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in texts))).alias("x"))
    hits = alias_hits(long.select(F.struct("task", "x.kind").alias("key"), plain_spaced(F.col("x.text")).alias("text")), aliases)
    found = hits.groupBy("key.task").agg(F.min_by("names", F.when(F.col("key.kind") == "r", 0).otherwise(1)).alias("names"))
    none = F.expr("cast(array() as array<string>)")
    return kept.join(found, "task", "left").groupBy("doi").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("names", none))))).alias("factors"))


def cited_gold(citations: DataFrame, gold: DataFrame) -> DataFrame:
    """key, gold: the union of the factor sets of the DOIs that an answer cites (key, doi); answers without any known DOI have none."""
    known = citations.withColumn("doi", doi_from_plain(F.col("doi"))).join(gold.withColumn("_in", F.lit(True)), "doi", "left").where("_in")
    return known.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("factors")))).alias("gold"))


def canonical_factor(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, canonical: by its alias; else the first canonical (by place) with an alias that stands in the name; else the name's plain form.

    aliases: canonical, alias, place (of the canonical). Blank names become ''.
    """
    norm = names.withColumn("_n", plain_spaced(F.col("name")))
    direct = aliases.groupBy(F.col("alias").alias("_n")).agg(F.max_by("canonical", "place").alias("_direct"))
    hits = alias_hits(norm.select(F.col("_n").alias("key"), F.col("_n").alias("text")).distinct(), aliases)
    within = hits.select(F.col("key").alias("_n"), F.explode("names").alias("canonical")).join(aliases.select("canonical", "place").distinct(), "canonical").groupBy("_n").agg(F.min_by("canonical", "place").alias("_within"))
    out = norm.join(direct, "_n", "left").join(within, "_n", "left")
    return out.withColumn("canonical", F.coalesce("_direct", "_within", "_n")).drop("_n", "_direct", "_within")


def last_of(rows: DataFrame, key: str, line: str = "line") -> DataFrame:
    """The last row of each key, by line."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), line).alias("_r")).select(key, "_r.*")


def audit_rows(plain_answers: DataFrame, hyde: DataFrame, alone: DataFrame) -> DataFrame:
    """The queries that all three sets answer: query_id, question and contexts of the first set, and each set's answer.

    Sets: query_id, line, question, contexts, answer. Of several answers in a set the last line counts.
    """
    a, b, c = (last_of(x.select("query_id", "line", "question", "contexts", "answer"), "query_id") for x in (plain_answers, hyde, alone))
    both = a.join(b.select("query_id", F.col("answer").alias("rag_hyde")), "query_id").join(c.select("query_id", F.col("answer").alias("llm_only")), "query_id")
    return both.select("query_id", "question", F.coalesce("contexts", F.expr("cast(array() as array<string>)")).alias("contexts"), F.col("answer").alias("rag_no_hyde"), "rag_hyde", "llm_only")


def metadata_matches(pool: DataFrame, tasks: DataFrame, least: float = 0.9) -> DataFrame:
    """What the best ranked pool row of each DOI and the task of that DOI say alike.

    pool: doi, rank, title, year, journal; tasks: doi (unique), title, year, journal. Ties of rank go to the smaller title.
    """
    first = pool.where(nonblank(F.col("doi")).isNotNull()).groupBy("doi").agg(F.min(F.struct("rank", "title", "year", "journal")).alias("p"))
    both = first.join(tasks.select("doi", F.struct("title", "year", "journal").alias("t")), "doi")
    alike = ratio(plain(F.coalesce("p.title", F.lit(""))), plain(F.coalesce("t.title", F.lit(""))))
    out = both.select("doi", alike.alias("title_similarity"), F.coalesce((F.col("p.year") == F.col("t.year")).cast("int"), F.lit(0)).alias("year_match"), (F.coalesce(plain(F.col("p.journal")) == plain(F.col("t.journal")), F.lit(False)) & nonblank(F.col("p.journal")).isNotNull() & nonblank(F.col("t.journal")).isNotNull()).cast("int").alias("journal_match"))
    return out.withColumn("title_sim_ok", (F.col("title_similarity") >= least).cast("int"))


def weak_unique(pool: DataFrame, positive: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per query over its distinct DOIs in ranked order (blank ones dropped first): mrr, retrieved, relevant and precision@k.

    pool: query_id, doi, rank; positive: doi. A query whose DOIs are all blank comes with zeros.
    """
    marked = pool.withColumn("doi", nonblank(F.col("doi"))).groupBy("query_id", "doi").agg(F.min("rank").alias("rank"))
    known = marked.join(positive.select("doi").distinct().withColumn("_yes", F.lit(1)), "doi", "left")
    at = F.when(F.col("doi").isNotNull(), F.row_number().over(Window.partitionBy("query_id", F.col("doi").isNull()).orderBy("rank", "doi")))
    rows = known.withColumn("at", at).withColumn("rel", F.coalesce("_yes", F.lit(0)))
    hits = [(F.coalesce(F.sum(F.when(F.col("at") <= k, F.col("rel"))), F.lit(0)) / k).alias(f"precision@{k}") for k in ks]
    return rows.groupBy("query_id").agg(F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("at"))), F.lit(0.0)).alias("mrr"), F.count("at").alias("retrieved"), F.coalesce(F.sum(F.when(F.col("at").isNotNull(), F.col("rel"))), F.lit(0)).alias("relevant"), *hits)


def weak_summary(rows: DataFrame) -> DataFrame:
    """metric, value: means of mrr and precision@k, and the share of queries with anything relevant, in that order (place)."""
    names = ["mrr", *sorted((c for c in rows.columns if c.startswith("precision@")), key=lambda c: int(c.split("@")[1]))]
    means = rows.agg(*(F.avg(f"`{c}`").alias(c) for c in names), F.avg((F.col("relevant") > 0).cast("int")).alias("queries_with_any_relevant_rate"))
    each = [F.struct(F.lit(k).alias("place"), F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for k, c in enumerate(means.columns)]
    return means.select(F.inline(F.array(*each)))


def label_fields(results: DataFrame) -> DataFrame:
    """field, types: the distinct types of answers to each field, of rows with result (RESULT)."""
    return results.select(F.explode("result").alias("r")).where(nonblank(F.col("r.from_name")).isNotNull()).groupBy(F.col("r.from_name").alias("field")).agg(F.array_join(F.array_sort(F.collect_set("r.type")), "|").alias("types"))


def in_id_order(ids: DataFrame, summaries: DataFrame, key: str = "pmid") -> DataFrame:
    """ids (key, place) with their summaries, in order; ids without one stay, with nulls."""
    return ids.join(summaries, key, "left").orderBy("place")


def missing_ids(ids: DataFrame, known: DataFrame, key: str = "pmid") -> DataFrame:
    """The ids that are not known, each once; blank ones go."""
    return ids.select(nonblank(F.col(key)).alias(key)).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Tables of the same columns, one after the other: for each key the row of the first table that has it (the least, if it has several)."""
    marked = reduce(DataFrame.unionByName, (p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)))
    rest = [c for c in parts[0].columns if c != key]
    return marked.groupBy(key).agg(F.min(F.struct("_part", *rest)).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in rest))


def pmid_of(source: Column, source_id: Column, pmid: Column) -> Column:
    """The id in the source if that is PubMed, else the one given; null without."""
    return F.coalesce(F.when(F.lower(strip(source)) == "pubmed", nonblank(source_id)), nonblank(pmid))


def one_identifier(doi: Column, pmid: Column) -> Column:
    """Null if exactly one of both is given, else what is wrong."""
    a, b = nonblank(doi).isNotNull(), nonblank(pmid).isNotNull()
    return F.when(a & b, "both doi and pmid").when(~a & ~b, "neither doi nor pmid")


def question_problem(question: Column, most: int) -> Column:
    """Null for a question that can be asked, else what is wrong."""
    n = F.length(squeeze(F.coalesce(question, F.lit(""))))
    return F.when(n == 0, "blank").when(n > most, "too long")


def clamped_chars(n: Column, low: int = 128, high: int = 2000) -> Column:
    return F.least(F.greatest(n, F.lit(low)), F.lit(high))


def answer_text(answer_text_: Column, summary: Column, answer: Column) -> Column:
    """The first of the three that isn't blank, trimmed; ''."""
    return F.coalesce(nonblank(answer_text_), nonblank(summary), nonblank(answer), F.lit(""))


def metric_place(metric: Column) -> Column:
    """Sort key of metric names: mrr, P@k, R@k, nDCG@k, each by k, then others."""
    head = F.lower(F.regexp_extract(metric, "^([A-Za-z]+)", 1))
    group = F.when(head == "mrr", 0).when(head.isin("p", "precision"), 1).when(head.isin("r", "recall"), 2).when(head == "ndcg", 3).otherwise(4)
    return F.struct(group, F.coalesce(F.try_to_number(nonblank(F.regexp_extract(metric, "@(\\d+)$", 1)), F.lit("999999")).cast("int"), F.lit(0)), metric)
