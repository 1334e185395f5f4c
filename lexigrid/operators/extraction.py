"""Extraction of factors from answers, held against what the cited documents are labelled with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import precision_recall_f1
from ..functions.storage import computed_once
from ..functions.text import doi_from_plain, nonblank, plain_spaced
from ..functions.variants import members, texts, words
from .evaluation import alias_hits
from .gold import canonical_factor

EMPTY = "cast(array() as array<string>)"


@dataclass(frozen=True)
class Policy:
    """What counts as predicted, and what becomes of answers whose citations have no gold: left out (skip) or kept with an empty set."""

    no_gold: str = "skip"
    closed_set: bool = False
    aliases: bool = True
    summary: bool = False
    snippets: bool = False

    def __post_init__(self):
        if self.no_gold not in ("skip", "empty"):
            raise ValueError("no_gold must be skip or empty")


def factor_names(raw: Column, aliases: bool = True) -> Column:
    """Names of the factors of an answer, each followed by its aliases."""
    none = F.expr(EMPTY)
    own = lambda f: F.array_compact(F.array(words(f, "$.normalized_name")))
    return F.flatten(F.transform(members(raw, "$.answer.risk_factors"), lambda f: F.concat(own(f), texts(f, "$.aliases") if aliases else none)))


def citation_snippets(raw: Column) -> Column:
    """Of each citation its first text that isn't blank: snippet, text or content."""
    return F.array_compact(F.transform(members(raw, "$.citations"), lambda c: F.coalesce(*(words(c, f"$.{k}") for k in ("snippet", "text", "content")))))


def cited_dois(raw: Column) -> Column:
    """Normalised DOIs of the citations, each once, in order."""
    dois = F.transform(members(raw, "$.citations"), lambda c: doi_from_plain(F.variant_get(c, "$.doi", "string")))
    return F.array_distinct(F.filter(dois, lambda d: d != ""))


def evaluate(answers: DataFrame, gold: DataFrame, aliases: DataFrame, policy: Policy = Policy(), mode: str = "unknown") -> DataFrame:
    """One row per answer: query_id, mode, excluded, tp, fp, fn, precision, recall, f1, counts of factors and of DOIs, and the factors as lists joined by bars.

    answers: line (unique), query_id, mode, raw (VARIANT); gold: doi (normalised), factors; aliases: canonical, alias (plain_spaced), place.
    A blank query_id becomes row_<line>, a blank mode the one given. Predicted are the canonical forms of the answer's names (in a closed set only
    known ones), and by the policy also the factors in its summary and in its citations' snippets. Gold is the union over cited DOIs that are known.
    With no_gold 'skip', answers without gold factors are excluded. The answers are read once, before this returns.
    """
    raw = F.col("raw")
    # read several times below, and small beside the answers: these are parsed once
    parts = computed_once(answers.select(
        F.col("line").cast("long").alias("key"), F.coalesce(nonblank(F.col("query_id").cast("string")), F.concat(F.lit("row_"), "line")).alias("query_id"), F.coalesce(nonblank(F.col("mode")), F.lit(mode)).alias("mode"),
        factor_names(raw, policy.aliases).alias("names"), words(raw, "$.answer.summary").alias("summary"), citation_snippets(raw).alias("snippets"), cited_dois(raw).alias("cited"),
    ))
    names = parts.select("key", F.explode(F.array_distinct("names")).alias("name"))
    known = canonical_factor(names.select("name").distinct(), aliases).where("canonical <> ''")
    if policy.closed_set:
        known = known.join(aliases.select("canonical").distinct(), "canonical", "left_semi")
    predicted = names.join(known, "name").select("key", F.col("canonical").alias("factor"))
    read = [F.array_compact(F.array("summary"))] * policy.summary + [F.col("snippets")] * policy.snippets
    if read:
        found = parts.select("key", F.posexplode(F.concat(*read)).alias("n", "text"))
        hits = alias_hits(found.select(F.struct("key", "n").alias("key"), plain_spaced(F.col("text")).alias("text")), aliases.select("canonical", "alias"))
        predicted = predicted.unionByName(hits.select("key.key", F.explode("names").alias("factor")))
    predicted = predicted.groupBy("key").agg(F.array_sort(F.collect_set("factor")).alias("pred"))
    cites = parts.select("key", F.explode("cited").alias("doi")).join(gold, "doi")
    truth = cites.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("factors")))).alias("gold"), F.count("*").alias("gold_doi_count"))
    rows = parts.drop("names", "summary", "snippets").join(predicted, "key", "left").join(truth, "key", "left")
    rows = rows.withColumn("pred", F.coalesce("pred", F.expr(EMPTY))).withColumn("gold", F.coalesce("gold", F.expr(EMPTY)))
    hit = F.array_intersect("pred", "gold")
    rows = rows.withColumn("tp", F.size(hit)).withColumn("fp", F.size("pred") - F.size(hit)).withColumn("fn", F.size("gold") - F.size(hit))
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    excluded = (F.size("gold") == 0) if policy.no_gold == "skip" else F.lit(False)
    listed = lambda c: F.array_join(F.array_sort(c), "|")
    return rows.select(
        F.col("key").alias("line"), "query_id", "mode", excluded.alias("excluded"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), F.size("pred").alias("pred_factor_count"), F.size("gold").alias("gold_factor_count"),
        F.size("cited").alias("cited_doi_count"), F.coalesce("gold_doi_count", F.lit(0)).alias("gold_doi_count"), listed(F.col("pred")).alias("pred_factors"), listed(F.col("gold")).alias("gold_factors"), listed(hit).alias("matched_factors"),
    )


def summarised(rows: DataFrame) -> DataFrame:
    """One row: micro measures (of the sums), macro ones (means of answers), evaluated_queries, skipped_no_gold, query_coverage_rate; zeros without answers."""
    own = ~F.col("excluded")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = rows.agg(*(F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), *(zero(F.avg(F.when(own, F.col(c)))).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), F.count_if(own).alias("evaluated_queries"), F.count_if(~own).alias("skipped_no_gold"))
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    total = F.col("evaluated_queries") + F.col("skipped_no_gold")
    return sums.select("tp", "fp", "fn", p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1", "evaluated_queries", "skipped_no_gold", F.when(total > 0, F.col("evaluated_queries") / total).otherwise(0.0).alias("query_coverage_rate"))


def closed_aliases(names: DataFrame) -> DataFrame:
    """Aliases as evaluate() takes them: canonical names and aliases plain, blank ones left out, and each canonical name an alias of itself. names: canonical, alias, place."""
    plain = names.select(plain_spaced(F.col("canonical")).alias("canonical"), plain_spaced(F.col("alias")).alias("alias"), "place").where("canonical <> ''")
    return plain.unionByName(plain.withColumn("alias", F.col("canonical"))).where("alias <> ''").distinct()
