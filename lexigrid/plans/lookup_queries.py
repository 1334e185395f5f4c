"""Queries over lookups, fetches, extraction by policy, and small operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, similarity, text
from ..operators import answers, documents, evaluation, extraction, ingest, ranking, retrieval, schedules
from ..sources import readers
from . import gold_queries, record_queries
from . import search_queries as search
from .record_queries import _M, _NAMES, FACTORS
from .search_queries import _sql_windows, table


def document_lookup(spark, sf_dir):
    """Every document asked for by its DOI, as it is written in different ways; one in seven with something that is none, and numbers that nobody has."""
    doi = lambda k: F.concat(F.lit("10.5555/x"), k.cast("string"))
    chunks = search._window_chunks(spark, sf_dir, 700, 0).select(
        F.concat_ws(":", "doc_id", F.lpad(F.col("index").cast("string"), 6, "0")).alias("point_id"), F.col("index").alias("chunk_index"), F.when(F.col("index") != 2, F.col("text")).alias("text"), F.col("source").alias("section"), doi(F.col("doc_id")).alias("doi_original"),
        F.lit(None).cast("string").alias("doi"), F.lit("").alias("doi_normalized"), F.array("source").alias("authors"), F.lit("J").alias("journal"), F.lit(2020).alias("year"), F.when(F.col("doc_id") % 2 == 0, "cancer").otherwise("flu").alias("disease"),
        F.lit("full_text").alias("source_type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("updated_at"), F.date_format(F.timestamp_seconds(F.col("index") * 60 + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), ids.document_id(doi(F.col("doc_id"))).alias("doc_id"),
    )
    k = F.col("doc_id")
    asked = F.when(k % 7 == 0, "10.5/").when(k % 3 == 0, F.concat(F.lit("https://doi.org/"), F.upper(doi(k)), F.lit("."))).otherwise(doi(F.when(k % 11 == 0, -k).otherwise(k)))
    out = documents.lookup_by_doi(table(spark, sf_dir, "documents").select(k.alias("request_id"), asked.alias("doi")), chunks)
    return out.select("request_id", "status", "doi", "chunk_total", F.md5("content_text").alias("digest"), F.element_at("chunk_ids", -1).alias("last_chunk"), "disease", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def fetched_documents(spark, sf_dir):
    """Documents as fetches by DOI or PubMed id, as responses and as items to ingest."""
    k = F.col("doc_id")
    fetched = table(spark, sf_dir, "documents").select(
        F.when(k % 2 == 0, F.concat(F.lit("10.5555/R"), k.cast("string"))).alias("requested_doi"), F.when(k % 2 == 1, k.cast("string")).alias("requested_pmid"), (k % 13 != 0).alias("found"), F.when(k % 3 == 0, F.concat(F.lit("10.5555/D"), k.cast("string"))).otherwise("").alias("doi"),
        F.when(k % 5 != 0, k.cast("string")).alias("pmid"), F.when(k % 4 == 0, F.col("text")).when(k % 4 == 1, " ").otherwise("").alias("full_text"), F.when(k % 6 != 0, F.concat(F.lit("A tumour. "), F.left("text", F.lit(30)))).alias("abstract"),
        F.lit("title").alias("title"), F.col("lang").alias("journal"), F.lit(2000).alias("year"), F.when(k % 2 == 0, F.array("source")).alias("authors"),
    )
    out = documents.fetched_items(documents.fetched_responses(fetched))
    return out.select("doi_original", "doi_normalized", "doc_id", "disease", "source_type", F.md5("content_text").alias("digest"), F.size("authors").alias("n_authors"))


def extraction_policies(spark, sf_dir):
    """Answers made of documents: their first two words as names, their beginnings as summaries, held against the gold of two cited DOIs."""
    docs = table(spark, sf_dir, "documents")
    # the words of text.plain_spaced(), of which the first two are read from the text's beginning
    low = F.lower(F.coalesce("text", F.lit("")))
    word = lambda before: F.regexp_extract(low, f"^{before}[^a-z0-9]*+([a-z0-9]++)", 1)
    factor = F.struct(word("").alias("normalized_name"), F.array(word("[^a-z0-9]*+[a-z0-9]++")).alias("aliases"))
    cite = lambda k: F.struct(F.concat(F.lit("https://doi.org/10.5/"), (k % 70).cast("string")).alias("doi"))
    raw = F.struct(F.struct(F.left("text", F.lit(60)).alias("summary"), F.array(factor).alias("risk_factors")).alias("answer"), F.array(cite(F.col("doc_id")), cite(F.col("doc_id") * 7)).alias("citations"))
    made = docs.select(F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("q"), "doc_id")).alias("query_id"), F.col("lang").alias("mode"), F.parse_json(F.to_json(raw)).alias("raw"))
    out = extraction.evaluate(made, gold_queries._gold(spark, sf_dir), gold_queries._aliases(spark), extraction.Policy(closed_set=True, summary=True))
    return out.select("line", "query_id", "mode", "excluded", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), "cited_doi_count", F.col("gold_doi_count").cast("int").alias("gold_doi_count"), "pred_factors", "gold_factors", "matched_factors")


def point_lookup(spark, sf_dir):
    """Chunks by their ids, some of which are wanted twice and some of which nobody has."""
    chunks = search._window_chunks(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("index")).alias("chunk_id"), F.md5("text").alias("digest"))
    wanted = table(spark, sf_dir, "labels").select((F.col("doc_id") * 1000 + F.col("doc_id") % 3).alias("chunk_id"))
    return retrieval.fetch_chunks(chunks, wanted.unionByName(wanted))


def task_screening(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    flags = d.select("doc_id", (F.col("doc_id") % 3 == 0).alias("out"), F.when(F.col("doc_id") % 5 != 0, F.col("lang") == "fr").alias("other"), (F.length("text") > 500).alias("reports"))
    return ingest.screening(flags, "out", "other", "reports").select("doc_id")


def task_items(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    authors = F.when(k % 3 == 0, F.array(F.lit("A"), F.lit(" "))).when(k % 3 == 1, F.array("source"))
    tasks = d.select(F.when(k % 7 != 0, F.concat(F.lit(" 10.1/"), k.cast("string"))).otherwise(" ").alias("doi"), F.col("source").alias("title"), F.col("lang").alias("journal"), F.when(k % 5 == 0, "x").otherwise((k % 100 + 1900).cast("string")).alias("year"), authors.alias("authors"), F.when(k % 11 != 0, F.col("text")).alias("abstract"))
    return ingest.ingest_items(tasks).select("doi", "title", "journal", "year", F.array_join("authors", "|").alias("authors"), F.md5("content_text").alias("digest"))


def title_choice(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ratio = F.least(F.col("value") / 20, F.lit(1.0))
    return e.select("event_id", F.round(similarity.best_title(ratio, F.col("event_id") % 5 + 2000, F.lit(2002)), 6).alias("score"))


def list_positions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.concat_ws(":", "conv_id", "turn")).alias("chunk_id"))
    return ranking.position_ranks(turns).select("query_id", "chunk_id", "rank")


def label_map(spark, sf_dir):
    """Labels of the last task of each DOI, from tasks made of events; a DOI is a user."""
    value = lambda kind: F.struct(F.when(kind == "c", F.array("event_type", F.lit("x"))).alias("choices"), F.when(kind == "r", F.col("event_id") % 5).cast("string").alias("rating"), F.lit(None).cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("text"))
    entry = lambda name, kind: F.struct(F.lit(name).alias("from_name"), F.lit(kind).alias("type"), value(F.lit(kind)).alias("value"))
    tasks = table(spark, sf_dir, "events").select(F.struct(F.concat(F.lit("DOI: 10.1/U"), F.col("user_id").cast("string")).alias("doi")).alias("data"), F.when(F.col("event_id") % 4 != 0, F.array(F.struct(F.array(entry("kind", "c"), entry("sure", "r")).alias("result")))).otherwise(F.array()).alias("annotations"), F.col("event_id").alias("position"))
    return readers.task_labels(tasks)


def weak_yes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    related = F.when(F.col("event_id") % 3 == 0, " YES ").when(F.col("event_id") % 3 == 1, "no")
    label = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    return e.select("event_id", evaluation.weak_relevance(related).alias("plain"), evaluation.weak_relevance(related, label, ("click", "view"), True).alias("labelled"))


def citation_rows(spark, sf_dir):
    """Citations of conversations: their turns, backwards, some of them unknown, with the chunks' fields."""
    turns = table(spark, sf_dir, "conversations")
    cites = turns.groupBy(F.col("conv_id").alias("request_id")).agg(F.sort_array(F.collect_list(F.col("turn")), asc=False).alias("t")).select("request_id", F.transform("t", lambda t: F.concat_ws(":", F.col("request_id").cast("string"), (t * 2).cast("string"))).alias("citations"))
    chunks = turns.select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), "role", F.length("text").alias("n_chars"))
    return answers.expand_citations(cites, chunks).select("request_id", "position", "chunk_id", "role", "n_chars")


def _measures(spark, sf_dir):
    return evaluation.query_metrics(record_queries.rankings(spark, sf_dir), record_queries.judgements(spark, sf_dir))


def depth_by_mode(spark, sf_dir):
    return evaluation.depth_by_mode(_measures(spark, sf_dir)).select("mode", "min_depth", "max_depth", F.round("mean_depth", 6).alias("mean_depth"))


def measure_rows(spark, sf_dir):
    return evaluation.metric_rows(_measures(spark, sf_dir)).select("mode", "query_id", F.replace("metric", F.lit("@"), F.lit("_at_")).alias("metric"), F.round("value", 6).alias("value"))


def enabled_first(spark, sf_dir):
    saved = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "O").alias("enabled"), F.col("o_orderdate").alias("created_at"))
    return schedules.enabled_queries(saved).select("o_orderkey")


def index_dois(spark, sf_dir):
    """DOIs that an index file gives, the last line's document each."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit(" 10.1/A"), (F.col("doc_id") % 300).cast("string"))).otherwise(" ").alias("doi"), F.concat(F.lit("d"), (F.col("doc_id") % 450).cast("string")).alias("doc_id"))
    known, twice = documents.document_index(rows)
    return known.join(twice, "doi", "left").select("doi", "doc_id", F.coalesce("n", F.lit(1)).alias("documents"))


def used_factors(spark, sf_dir):
    """Names in the texts of turns by a table of aliases, joined rather than planned: as many aliases as part has names."""
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("canonical"), text.plain_spaced(F.col("p_name")).alias("alias"))
    words = spark.createDataFrame(FACTORS, "canonical string, alias string")
    texts = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), text.plain_spaced(F.col("text")).alias("text"))
    hits = evaluation._joined_hits(texts, names.unionByName(words).where("alias <> '' AND canonical IS NOT NULL").distinct())
    return hits.select("key", F.array_join("names", "|").alias("names"))


LOOKUPS = {
    "document_lookup": (document_lookup, f"""
      WITH {_sql_windows(700, 0)},
      c AS (SELECT doc_id, count(*)::INTEGER AS n, md5(string_agg(piece, chr(10) ORDER BY chunk_index) FILTER (chunk_index <> 2)) AS digest,
          CASE WHEN count(*) > 2 THEN doc_id || ':000002' ELSE max(doc_id || ':' || lpad(chunk_index::VARCHAR, 6, '0')) END AS last, max(chunk_index) AS m FROM w GROUP BY doc_id),
      r AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 7 = 0 THEN 'validation_error' WHEN (doc_id % 3 <> 0 AND doc_id % 11 = 0 AND doc_id <> 0) OR n IS NULL THEN 'not_found' ELSE 'found' END AS status, * FROM documents LEFT JOIN c USING (doc_id))
      SELECT request_id, status, CASE WHEN status = 'found' THEN '10.5555/x' || request_id END AS doi, CASE WHEN status = 'found' THEN n END AS chunk_total, CASE WHEN status = 'found' THEN digest END AS digest, CASE WHEN status = 'found' THEN last END AS last_chunk,
        CASE WHEN status = 'found' AND request_id % 2 = 0 THEN 'cancer' END AS disease, CASE WHEN status = 'found' THEN strftime(TIMESTAMP '2023-11-14 22:13:20' + to_minutes(m), '%Y-%m-%d %H:%M:%S') END AS updated FROM r"""),
    "fetched_documents": (fetched_documents, """
      WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '10.5555/D' || doc_id WHEN doc_id % 2 = 0 THEN '10.5555/R' || doc_id ELSE '' END AS doi, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN ' ' ELSE '' END AS ft,
        CASE WHEN doc_id % 6 <> 0 THEN 'A tumour. ' || substr(text, 1, 30) END AS ab FROM documents),
      b AS (SELECT *, CASE WHEN coalesce(ft, '') <> '' THEN ft ELSE coalesce(ab, '') END AS body FROM d WHERE doc_id % 13 <> 0),
      o AS (SELECT *, CASE WHEN doi = '' THEN 'pmid:' || CASE WHEN doc_id % 5 <> 0 THEN doc_id::VARCHAR ELSE '' END ELSE doi END AS o, lower('title ' || coalesce(ab, '') || ' ' || coalesce(ft, '')) AS t FROM b WHERE regexp_replace(body, '\\s+', '', 'g') <> '')
      SELECT o AS doi_original, lower(o) AS doi_normalized, sha256(lower(o)) AS doc_id, CASE WHEN regexp_matches(t, 'thrombosis|thromboembolism|vte') THEN 'thrombosis' WHEN regexp_matches(t, 'cancer|carcinoma|neoplasm|tumou?r|malignancy') THEN 'cancer' ELSE 'unknown' END AS disease,
        CASE WHEN coalesce(ft, '') <> '' THEN 'full_text' ELSE 'pubmed_abstract' END AS source_type, md5(body) AS digest, (doc_id % 2 = 0)::INTEGER AS n_authors FROM o"""),
    "extraction_policies": (extraction_policies, f"""
      WITH {gold_queries._GOLD_SQL},
      d AS (SELECT doc_id, lang, {gold_queries._NORM.format("text")} AS n, {gold_queries._NORM.format("substr(text, 1, 60)")} AS s FROM documents),
      w AS (SELECT *, string_split(n, ' ') AS w, {gold_queries._hits("s")} AS h FROM d),
      p AS (SELECT doc_id, lang, list_sort(list_distinct(list_concat(h, list_filter([{", ".join(f"CASE w[{i}] " + " ".join(f"WHEN '{a}' THEN '{c}'" for c, a in FACTORS) + " END" for i in (1, 2))}], lambda x: x IS NOT NULL)))) AS pred FROM w),
      c AS (SELECT DISTINCT doc_id, unnest(['10 5 ' || (doc_id % 70), '10 5 ' || (doc_id * 7 % 70)]) AS doi FROM documents),
      k AS (SELECT doc_id, count(*)::INTEGER AS n_cited, count(g.doi)::INTEGER AS n_gold, list_sort(list_distinct(flatten(list(f) FILTER (g.doi IS NOT NULL)))) AS gold FROM c LEFT JOIN g USING (doi) GROUP BY doc_id),
      x AS (SELECT doc_id, lang, n_cited, n_gold, pred, coalesce(gold, []) AS gold FROM p JOIN k USING (doc_id)),
      y AS (SELECT *, list_sort(list_intersect(pred, gold)) AS hit FROM x)
      SELECT doc_id AS line, CASE WHEN doc_id % 10 <> 0 THEN 'q' || doc_id ELSE 'row_' || doc_id END AS query_id, lang AS mode, len(gold) = 0 AS excluded, len(hit)::INTEGER AS tp, (len(pred) - len(hit))::INTEGER AS fp, (len(gold) - len(hit))::INTEGER AS fn,
        CASE WHEN len(hit) = 0 THEN 0.0::DOUBLE ELSE round(2.0 * len(hit) / (len(pred) + len(gold)), 6)::DOUBLE END AS f1, n_cited AS cited_doi_count, n_gold AS gold_doi_count,
        array_to_string(pred, '|') AS pred_factors, array_to_string(gold, '|') AS gold_factors, array_to_string(hit, '|') AS matched_factors FROM y"""),
    "point_lookup": (point_lookup, f"WITH {_sql_windows(1200, 150)} SELECT doc_id * 1000 + chunk_index AS chunk_id, md5(piece) AS digest FROM w WHERE doc_id * 1000 + chunk_index IN (SELECT doc_id * 1000 + doc_id % 3 FROM labels)"),
    "task_screening": (task_screening, "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND NOT coalesce(doc_id % 5 <> 0 AND lang = 'fr', FALSE) AND length(text) > 500"),
    "task_items": (task_items, "SELECT '10.1/' || doc_id AS doi, trim(source) AS title, lang AS journal, (doc_id % 100 + 1900)::INTEGER AS year, source AS authors, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 = 1 AND doc_id % 11 <> 0 AND trim(text) <> ''"),
    "title_choice": (title_choice, "WITH r AS (SELECT event_id, least(value / 20, 1.0) * CASE WHEN abs(event_id % 5 - 2) > 1 THEN 0.92 ELSE 1.0 END AS s FROM events) SELECT event_id, CASE WHEN s >= 0.93 THEN round(s, 6) END AS score FROM r"),
    "list_positions": (list_positions, "SELECT query_id, chunk_id, rank FROM (SELECT conv_id AS query_id, conv_id || ':' || turn AS chunk_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS rank FROM conversations) WHERE turn % 3 <> 1"),
    "label_map": (label_map, """
      WITH l AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_id % 4 <> 0 GROUP BY user_id), r AS (SELECT * FROM l JOIN events ON event_id = e)
      SELECT '10.1/u' || r.user_id AS doi, 'kind' AS from_name, 'c' AS type, event_type || '|x' AS value FROM r UNION ALL SELECT '10.1/u' || r.user_id, 'sure', 'r', (e % 5)::VARCHAR FROM r"""),
    "weak_yes": (weak_yes, "SELECT event_id, (event_id % 3 = 0)::INTEGER AS plain, (event_id % 3 = 0 AND (event_id % 4 = 0 OR event_type IN ('click', 'view')))::INTEGER AS labelled FROM events"),
    "citation_rows": (citation_rows, """
      WITH c AS (SELECT conv_id, conv_id || ':' || turn * 2 AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position FROM conversations)
      SELECT c.conv_id AS request_id, position::INTEGER AS position, c.chunk_id, role, length(text)::INTEGER AS n_chars FROM c JOIN conversations t ON c.chunk_id = t.conv_id || ':' || t.turn"""),
    "depth_by_mode": (depth_by_mode, f"{_M} SELECT mode, min(depth) AS min_depth, max(depth) AS max_depth, round(avg(depth), 6) AS mean_depth FROM m GROUP BY mode"),
    "measure_rows": (measure_rows, f"{_M} " + " UNION ALL ".join(f"SELECT mode, query_id, '{c}' AS metric, round({c}, 6) AS value FROM m" for c in _NAMES)),
    "enabled_first": (enabled_first, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'"),
    "index_dois": (index_dois, """
      WITH r AS (SELECT doc_id AS line, '10.1/a' || (doc_id % 300) AS doi, 'd' || (doc_id % 450) AS doc_id FROM documents WHERE doc_id % 9 <> 0)
      SELECT doi, arg_max(doc_id, line) AS doc_id, count(DISTINCT doc_id) AS documents FROM r GROUP BY doi"""),
    "used_factors": (used_factors, f"""
      WITH t AS (SELECT conv_id || ':' || turn AS key, ' ' || {gold_queries._NORM.format("text")} || ' ' AS text FROM conversations),
      n AS (SELECT DISTINCT p_type AS canonical, {gold_queries._NORM.format("p_name")} AS alias FROM part UNION VALUES {", ".join(f"('{c}', '{a}')" for c, a in FACTORS)})
      SELECT key, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS names FROM t, n WHERE alias <> '' AND contains(text, ' ' || alias || ' ') GROUP BY key"""),
}
