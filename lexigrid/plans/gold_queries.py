"""Queries over labelled tasks, their gold sets and audits. Labels, reasons and citations are stand-ins made of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gold
from .record_queries import FACTORS
from .search_queries import table


def _aliases(spark):
    places = {name: k for k, name in enumerate(dict.fromkeys(n for n, _ in FACTORS))}
    return spark.createDataFrame([(n, a, places[n]) for n, a in FACTORS], "canonical string, alias string, place int")


def _tasks(spark, sf_dir):
    """Labelled documents as tasks: toxic ones are positive, of which every other has its text as a reason."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    none, some = F.expr("cast(null as array<string>)"), lambda *c: F.array(*c)
    value = lambda choices, rating, text: F.struct(choices.alias("choices"), rating.alias("rating"), none.alias("labels"), text.alias("text"))
    entry = lambda name, kind, v: F.struct(F.lit(name).alias("from_name"), F.lit(kind).alias("type"), v.alias("value"))
    null = F.lit(None).cast("string")
    result = F.array(
        entry("note", "textarea", value(none, null, some(F.lit("the")))),
        entry("risk", "choices", value(some(F.when(F.col("toxic") == 1, " Yes ").otherwise("no")), null, none)),
        entry("sure", "rating", value(none, F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 6).cast("string")), none)),
        entry("why", "textarea", value(none, null, F.when(F.col("doc_id") % 2 == 0, some(F.lit("  "), F.col("text"))))),
    )
    return docs.select(F.col("doc_id").alias("task"), F.concat(F.lit("https://doi.org/10.5/"), (F.col("doc_id") % 50).cast("string")).alias("doi"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("abstract"), result.alias("result"))


def _gold(spark, sf_dir):
    return gold.gold_factors(_tasks(spark, sf_dir), _aliases(spark), "risk", "yes", "sure", "why", least=2)


def gold_factors(spark, sf_dir):
    return _gold(spark, sf_dir).select("doi", F.array_join("factors", "|").alias("factors"))


def cited_gold(spark, sf_dir):
    cites = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("key"), F.concat(F.lit("doi:10.5/"), (F.col("doc_id") % 70).cast("string")).alias("doi"))
    return gold.cited_gold(cites, _gold(spark, sf_dir)).select("key", F.array_join("gold", "|").alias("gold"))


def canonical_factors(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.col("text").alias("name")).unionByName(spark.createDataFrame([("In  the",), (" ",), ("quite other",)], "name string"))
    return gold.canonical_factor(names, _aliases(spark)).select(F.md5("name").alias("name"), F.when(F.length("canonical") > 20, F.md5("canonical")).otherwise(F.col("canonical")).alias("canonical"))


def _answers(spark, sf_dir, keep):
    turns = table(spark, sf_dir, "conversations").where(keep)
    return turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("line"), F.col("role").alias("question"), F.array("role").alias("contexts"), F.col("text").alias("answer"))


def audit_rows(spark, sf_dir):
    out = gold.audit_rows(*(_answers(spark, sf_dir, k) for k in ("role = 'user'", "role = 'assistant'", "length(text) > 60")))
    return out.select("query_id", "question", F.array_join("contexts", "|").alias("contexts"), *(F.md5(c).alias(c) for c in ("rag_no_hyde", "rag_hyde", "llm_only")))


def _pair():
    """Two documents share a DOI."""
    return (F.col("doc_id") - F.col("doc_id") % 2).cast("string")


def _weak(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select((F.col("doc_id") % 9).alias("query_id"), F.when(F.col("doc_id") % 7 != 0, _pair()).otherwise(" ").alias("doi"), F.col("doc_id").alias("rank"))
    return gold.weak_unique(pool, table(spark, sf_dir, "labels").where("quality = 1").select(_pair().alias("doi")))


def weak_unique_metrics(spark, sf_dir):
    return _weak(spark, sf_dir).select("query_id", F.round("mrr", 6).alias("mrr"), "retrieved", "relevant", F.round("`precision@5`", 6).alias("p5"), F.round("`precision@10`", 6).alias("p10"))


def weak_label_summary(spark, sf_dir):
    return gold.weak_summary(_weak(spark, sf_dir)).select("place", "metric", F.round("value", 6).alias("value"))


def label_field_types(spark, sf_dir):
    """Events of each user as answers: the kind of event is the field, its value decides the type."""
    kind = F.when(F.col("value") < 2, "rating").when((F.col("value") > 30) & (F.col("event_type") != "view"), "textarea").otherwise("choices")
    name = F.when(F.col("user_id") % 10 == 0, " ").otherwise(F.col("event_type"))
    entry = F.struct(name.alias("from_name"), kind.alias("type"), F.lit(None).cast(gold.RESULT[: -1].split("value:", 1)[1][:-1]).alias("value"))
    return gold.label_fields(table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(entry).alias("result")))


def metadata_matches(spark, sf_dir):
    """Documents as a pool of DOIs, and vectors as the tasks of these DOIs."""
    pool = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 700).cast("string")).alias("doi"), F.col("doc_id").alias("rank"), F.when(F.col("doc_id") % 3 == 0, "123").otherwise("A b.C").alias("title"), (F.col("doc_id") % 30 + 1990).cast("int").alias("year"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("journal"))
    tasks = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("doi"), F.when(F.col("vec_id") % 4 != 0, "a  bc").alias("title"), F.when(F.col("vec_id") % 7 != 0, F.col("vec_id") % 30 + 1990).cast("int").alias("year"), F.lit(" EN ").alias("journal"))
    return gold.metadata_matches(pool, tasks)


def missing_id_list(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("doc_id").cast("string")).alias("pmid"))
    return gold.missing_ids(ids, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("pmid")))


def first_source_wins(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).cast("long").alias("id"), F.lit(t).alias("source")) for t, c in (("labels", "doc_id"), ("embeddings", "vec_id"), ("documents", "doc_id"))]
    return gold.first_wins(parts, "id")


def record_checks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    even = F.when(k % 2 == 0, k.cast("string")).otherwise(" ")
    third = F.when(k % 3 == 0, k.cast("string"))
    return c.select("c_custkey", gold.one_identifier(even, third).alias("identifier"), gold.question_problem(F.when(k % 5 == 0, "  ").otherwise(F.col("c_name")), 17).alias("question"), gold.clamped_chars(k).alias("chars"), gold.pmid_of(F.when(k % 2 == 0, "PubMed").otherwise("other"), even, third).alias("pmid"), gold.answer_text(third, even, F.col("c_name")).alias("answer"))


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _hits(text: str) -> str:
    """SQL list of the canonical names in a text, in order."""
    names = sorted({n for n, _ in FACTORS})
    each = ", ".join(f"CASE WHEN regexp_matches({text}, '(^| )({'|'.join(a for m, a in FACTORS if m == n)})( |$)') THEN '{n}' END" for n in names)
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


_GOLD_SQL = f"""
  l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
  t AS (SELECT d.doc_id, '10 5 ' || (d.doc_id % 50) AS doi, {_NORM.format("d.text")} AS text FROM documents d JOIN l USING (doc_id) WHERE toxic = 1 AND (d.doc_id % 11 = 0 OR d.doc_id % 6 >= 2)),
  h AS (SELECT doi, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 <> 0 THEN {_hits("coalesce(text, '')")} ELSE [] END AS f FROM t),
  g AS (SELECT doi, list_sort(list_distinct(flatten(list(f)))) AS f FROM h GROUP BY doi)"""

GOLD = {
    "gold_factors": (gold_factors, f"WITH {_GOLD_SQL} SELECT doi, array_to_string(f, '|') AS factors FROM g"),
    "cited_gold": (cited_gold, f"WITH {_GOLD_SQL}, c AS (SELECT DISTINCT doc_id % 20 AS key, '10 5 ' || (doc_id % 70) AS doi FROM documents) SELECT key, array_to_string(list_sort(list_distinct(flatten(list(f)))), '|') AS gold FROM c JOIN g USING (doi) GROUP BY key"),
    "canonical_factors": (canonical_factors, f"""
      WITH n AS (SELECT text AS name FROM benchmark UNION ALL VALUES ('In  the'), (' '), ('quite other')),
      m AS (SELECT name, {_NORM.format("name")} AS n FROM n),
      c AS (SELECT name, CASE {" ".join(f"WHEN n = '{a}' THEN '{c}'" for c, a in FACTORS)} {" ".join(f"WHEN regexp_matches(n, '(^| )({'|'.join(a for m, a in FACTORS if m == c)})( |$)') THEN '{c}'" for c in dict.fromkeys(n for n, _ in FACTORS))} ELSE n END AS canonical FROM m)
      SELECT md5(name) AS name, CASE WHEN length(canonical) > 20 THEN md5(canonical) ELSE canonical END AS canonical FROM c"""),
    "audit_rows": (audit_rows, """
      WITH a AS (SELECT * FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
      b AS (SELECT * FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
      c AS (SELECT * FROM conversations WHERE length(text) > 60 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
      SELECT conv_id AS query_id, a.role AS question, a.role AS contexts, md5(a.text) AS rag_no_hyde, md5(b.text) AS rag_hyde, md5(c.text) AS llm_only FROM a JOIN b USING (conv_id) JOIN c USING (conv_id)"""),
    "weak_unique_metrics": (weak_unique_metrics, """
      WITH p AS (SELECT doc_id % 9 AS query_id, (doc_id - doc_id % 2)::VARCHAR AS doi, min(doc_id) AS rank FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1, 2),
      y AS (SELECT DISTINCT (doc_id - doc_id % 2)::VARCHAR AS doi FROM labels WHERE quality = 1),
      r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doi) AS k, doi IN (SELECT doi FROM y) AS yes FROM p)
      SELECT query_id, round(coalesce(1.0 / min(k) FILTER (yes), 0), 6)::DOUBLE AS mrr, count(*) AS retrieved, count(*) FILTER (yes) AS relevant, round(count(*) FILTER (yes AND k <= 5) / 5.0, 6)::DOUBLE AS p5, round(count(*) FILTER (yes AND k <= 10) / 10.0, 6)::DOUBLE AS p10 FROM r GROUP BY query_id"""),
    "weak_label_summary": (weak_label_summary, """
      WITH p AS (SELECT doc_id % 9 AS query_id, (doc_id - doc_id % 2)::VARCHAR AS doi, min(doc_id) AS rank FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1, 2),
      y AS (SELECT DISTINCT (doc_id - doc_id % 2)::VARCHAR AS doi FROM labels WHERE quality = 1),
      r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doi) AS k, doi IN (SELECT doi FROM y) AS yes FROM p),
      q AS (SELECT coalesce(1.0 / min(k) FILTER (yes), 0) AS m, count(*) FILTER (yes AND k <= 5) / 5.0 AS p5, count(*) FILTER (yes AND k <= 10) / 10.0 AS p10, (count(*) FILTER (yes) > 0)::INTEGER AS hit FROM r GROUP BY query_id)
      SELECT 0::INTEGER AS place, 'mrr' AS metric, round(avg(m), 6)::DOUBLE AS value FROM q UNION ALL SELECT 1::INTEGER, 'precision@5', round(avg(p5), 6)::DOUBLE FROM q
      UNION ALL SELECT 2::INTEGER, 'precision@10', round(avg(p10), 6)::DOUBLE FROM q UNION ALL SELECT 3::INTEGER, 'queries_with_any_relevant_rate', round(avg(hit), 6)::DOUBLE FROM q"""),
    "label_field_types": (label_field_types, """
      WITH e AS (SELECT event_type AS field, CASE WHEN value < 2 THEN 'rating' WHEN value > 30 AND event_type <> 'view' THEN 'textarea' ELSE 'choices' END AS type FROM events WHERE user_id % 10 <> 0)
      SELECT field, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM e GROUP BY field"""),
    "metadata_matches": (metadata_matches, """
      WITH p AS (SELECT doc_id % 700 AS k, min(doc_id) AS d FROM documents GROUP BY 1),
      r AS (SELECT 'd' || k AS doi, d % 3 <> 0 AS t, d % 30 + 1990 AS y, CASE WHEN d % 5 <> 0 THEN lang END AS j FROM p JOIN documents ON doc_id = d)
      SELECT DISTINCT doi, CASE WHEN t AND vec_id % 4 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS title_similarity, (coalesce(vec_id % 7 <> 0 AND y = vec_id % 30 + 1990, FALSE))::INTEGER AS year_match,
        coalesce(j = 'en', FALSE)::INTEGER AS journal_match, (t AND vec_id % 4 <> 0)::INTEGER AS title_sim_ok FROM r JOIN embeddings ON doi = 'd' || vec_id"""),
    "missing_id_list": (missing_id_list, "SELECT DISTINCT doc_id::VARCHAR AS pmid FROM documents WHERE doc_id % 10 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"),
    "first_source_wins": (first_source_wins, """
      SELECT id, CASE min(p) WHEN 0 THEN 'labels' WHEN 1 THEN 'embeddings' ELSE 'documents' END AS source
      FROM (SELECT doc_id AS id, 0 AS p FROM labels UNION ALL SELECT vec_id, 1 FROM embeddings UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY id"""),
    "record_checks": (record_checks, """
      SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'both doi and pmid' WHEN c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 THEN 'neither doi nor pmid' END AS identifier,
        CASE WHEN c_custkey % 5 = 0 THEN 'blank' WHEN length(c_name) > 17 THEN 'too long' END AS question, least(greatest(c_custkey, 128), 2000) AS chars,
        CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN c_custkey::VARCHAR END AS pmid, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS answer FROM customer"""),
}
