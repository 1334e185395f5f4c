"""Queries over rankings, judgements, items, runs and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, status, text
from ..functions.similarity import ratio
from ..operators import answers, evaluation, ingest, ranking, schedules
from ..streaming import jobs
from . import search_queries as search
from .search_queries import _CAND, table


def rankings(spark, sf_dir):
    """Two modes: dense order and lexical order of the same candidates."""
    cand = search.candidates(spark, sf_dir)
    dense = ranking.ranked(cand, "score", "rank").select(F.lit("direct").alias("mode"), "query_id", F.col("chunk_id").alias("doc_id"), "rank")
    lexical = ranking.ranked(ranking.bm25(cand, search.questions(spark, sf_dir)), "bm25", "rank").select(F.lit("hyde").alias("mode"), "query_id", F.col("chunk_id").alias("doc_id"), "rank")
    return dense.unionByName(lexical).where("rank <= 20").withColumn("line", F.col("rank"))


def judgements(spark, sf_dir):
    """Grades from ids, for every candidate whose id a question's divides by 3."""
    cand = search.candidates(spark, sf_dir)
    return cand.where("(chunk_id + query_id) % 3 = 0").select("query_id", F.col("chunk_id").alias("doc_id"), ((F.col("chunk_id") + F.col("query_id")) % 2 + F.when(F.col("chunk_id") % 5 == 0, 1).otherwise(0)).cast("int").alias("relevance"))


def _rounded(df, keys):
    return df.select(*(F.col(f"`{c}`") if c in keys else F.round(F.col(f"`{c}`"), 6).alias(c.replace("@", "_at_")) for c in df.columns))


def retrieval_metrics(spark, sf_dir):
    return _rounded(evaluation.query_metrics(rankings(spark, sf_dir), judgements(spark, sf_dir)), ("mode", "query_id", "depth", "first_relevant"))


def metrics_by_mode(spark, sf_dir):
    out = evaluation.metrics_by_mode(evaluation.query_metrics(rankings(spark, sf_dir), judgements(spark, sf_dir)))
    return out.select("mode", "metric", F.round("mean", 6).alias("mean"), "queries", "excluded")


def beir_metrics(spark, sf_dir):
    pool = rankings(spark, sf_dir).where("mode = 'direct'").select("query_id", "doc_id", "rank")
    return _rounded(evaluation.graded_metrics(pool, judgements(spark, sf_dir), (5, 10)), ("query_id",))


def weak_label_metrics(spark, sf_dir):
    pool = rankings(spark, sf_dir).where("mode = 'direct'").select("query_id", F.col("doc_id").alias("doc_key"), "rank")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc_key"), "quality").groupBy("doc_key").agg(F.max("quality").alias("label"))
    return _rounded(evaluation.weak_metrics(pool, labels), ("query_id", "n_pool", "n_labelled"))


def pooled_candidates(spark, sf_dir):
    rows = rankings(spark, sf_dir).select("mode", "query_id", "rank", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("doc_id").cast("string")).alias("doc_id"), F.col("doc_id").cast("string").alias("pmid"), F.when((F.col("doc_id") % 2 == 0) & (F.col("mode") == "direct"), "").otherwise(F.concat("mode", F.lit(" t"))).alias("title"))
    out = evaluation.merge_pool(rows.where("mode = 'direct'").drop("mode"), rows.where("mode = 'hyde'").drop("mode"))
    return out.select("query_id", "resolved_doc_id", "doc_id", "pmid", "title")


def overlap_audit(spark, sf_dir):
    return evaluation.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("n_left", "n_right", "n_both", F.round("left_share", 6).alias("left_share"), F.round("right_share", 6).alias("right_share"))


FACTORS = [("weather", "the"), ("weather", "and"), ("bridge", "of"), ("bridge", "in the"), ("garden", "der"), ("river", "de la"), ("stone", "la")]
#: Names as a predictor knows them, that lacks some aliases and takes some for others.
GUESSES = [("weather", "the"), ("bridge", "in the"), ("garden", "in"), ("garden", "der"), ("river", "la"), ("stone", "by the")]


def _extraction(spark, sf_dir):
    """Names in whole texts by the table of factors against those by the predictor's table."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), text.plain_spaced(F.col("text")).alias("text"))
    known = lambda names: spark.createDataFrame(names, "canonical string, alias string")
    gold = evaluation.alias_hits(texts, known(FACTORS)).withColumnRenamed("names", "gold")
    predicted = evaluation.alias_hits(texts, known(GUESSES)).withColumnRenamed("names", "predicted")
    return evaluation.extraction_rows(predicted, gold)


def extraction_prf(spark, sf_dir):
    return _rounded(_extraction(spark, sf_dir).withColumnRenamed("key", "doc_id"), ("doc_id", "tp", "fp", "fn", "matched"))


def extraction_summary(spark, sf_dir):
    return _rounded(evaluation.extraction_summary(_extraction(spark, sf_dir)), ("n", "tp", "fp", "fn"))


def robustness_mean_std(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("v"))
    return evaluation.mean_std(rows, ["event_type"], "v").select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def numeric_field_means(spark, sf_dir):
    return _rounded(evaluation.numeric_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"]), ("l_returnflag",))


def missing_and_shallow(spark, sf_dir):
    r, j = rankings(spark, sf_dir).where("NOT (mode = 'hyde' AND query_id % 4 = 0)"), judgements(spark, sf_dir).where("query_id % 5 <> 0")
    return evaluation.missing_queries(r, j).unionByName(evaluation.too_shallow(r, 20).select("mode", "query_id", F.lit("shallow").alias("problem")))


def grade_histogram(spark, sf_dir):
    return evaluation.relevance_histogram(judgements(spark, sf_dir))


def annotation_errors(spark, sf_dir):
    """Customers as judged pairs: one in six lacks its judgement; some keys are empty or unknown, some grades, reasons and states wrong."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pool = c.select(F.col("c_nationkey").cast("string").alias("query_id"), k.cast("string").alias("resolved_doc_id"))
    rows = c.where("c_custkey % 6 <> 0").select((k + 2).alias("row"), F.when(k % 97 == 7, "").otherwise(F.col("c_nationkey").cast("string")).alias("query_id"), F.when(k % 89 == 9, "none").otherwise(k.cast("string")).alias("resolved_doc_id"), (k % 4).cast("string").alias("relevance"), F.when(k % 5 == 0, " ").otherwise("why").alias("rationale"), F.when(k % 83 == 4, "odd").otherwise("").alias("adjudication_status"))
    return evaluation.annotation_errors(rows, pool)


def _items(spark, sf_dir):
    """Documents as items: one in nine has no DOI; the DOIs of those with equal beginnings are the same."""
    doi = F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.concat(F.lit("https://doi.org/10.5555/X."), F.md5(F.left("text", F.lit(12)))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), doi.alias("doi"))


def ingest_split_dedupe(spark, sf_dir):
    items = _items(spark, sf_dir)
    indexed = ingest.split_valid(items.where("position % 10 = 1"))[0].select("doc_id")
    return ingest.build_job(items, indexed).select("position", "doi_normalized", "doc_id", "state", "message")


def job_status_rollup(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped_duplicate").when(F.col("event_type") == "signup", "queued").otherwise("succeeded")
    return ingest.job_counts(table(spark, sf_dir, "events").select((F.col("event_id") % 997).alias("job_id"), state.alias("state")))


def outcome_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doi = F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd HH")).alias("doi")
    queued = F.col("event_type").isin("view", "click")
    items = e.where(queued).select(doi).distinct().select("doi", F.lit("queued").alias("state"), F.lit(None).cast("string").alias("message"))
    done = e.where(~queued).select(doi, F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("state"), F.col("event_type").alias("message"), F.col("event_id").alias("position"))
    return ingest.apply_outcomes(items, done)


def run_status_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_execution_id"), F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_linestatus") == "O", "ENQUEUED").otherwise("SUCCEEDED").alias("status"))
    executions = schedules.execution_counts(lines).join(table(spark, sf_dir, "orders"), F.col("query_execution_id") == F.col("o_orderkey")).select(F.col("o_custkey").alias("run_id"), "status")
    return schedules.run_rollup(executions)


def query_execution_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_execution_id"), F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_returnflag") == "N", "SKIPPED_EXISTS").when(F.col("l_linestatus") == "O", "ENQUEUED").otherwise("SUCCEEDED").alias("status"))
    return schedules.execution_counts(lines)


def runs_nested(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    executions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_orderkey").cast("string").alias("query_id"), F.col("o_orderstatus").alias("status"))
    out = schedules.runs_with_executions(runs, executions)
    return out.select("run_id", F.size("executions").alias("n"), F.array_join(F.transform("executions", lambda x: x["query_id"]), ",").alias("ids"))


def runs_listed(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    return schedules.list_runs(runs, "F", "1996-01-01", "1996-06-30").select("o_orderkey", "status")


def incremental_since(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("published_at"))
    mark = F.when(F.col("event_id") % 2 == 0, F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))
    return schedules.newer_than(e, mark).select("event_id")


def unique_dois(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat("event_type", (F.col("user_id") % 30).cast("string"))).alias("doi"))
    return schedules.unique_dois(e).select("position", "doi")


def high_water_marks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("FAILED").alias("status"), F.col("o_orderdate").alias("started_at"))
    return schedules.high_water_marks(o).select("query_id", F.date_format("last_successful_run_at", "yyyy-MM-dd").alias("mark"))


def index_anti_join(spark, sf_dir):
    return schedules.split_known(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")[0]


def index_semi_join(spark, sf_dir):
    return schedules.split_known(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")[1]


def latest_wins_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("point_id"), "event_type", "value", F.col("event_id").alias("position"))
    stored = F.col("event_type").isin("view", "click")
    index = ingest.latest(e.where(stored), ["point_id"], [F.desc("position")])
    return ingest.upserted(index, e.where(~stored))


def delete_documents(spark, sf_dir):
    index = search._window_chunks(spark, sf_dir).select("doc_id", F.col("index").alias("chunk_index"))
    return ingest.without_documents(index, table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"))


def idempotency_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws(":", "user_id", "event_type").alias("key"))
    return jobs.once_within(e.withColumn("ts", F.col("ts").cast("timestamp")), "key").select("event_id", "key")


def idempotency_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("idempotency_key"), F.md5("event_type").alias("body_hash"))
    return jobs.conflicts(e)


def slot_fire_once(spark, sf_dir):
    return schedules.fired_slots(table(spark, sf_dir, "events")).select(F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"))


def hourly_counts(spark, sf_dir):
    out = jobs.counts_by_window(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark, sf_dir):
    out = jobs.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def audit_latency(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("rate", status.token_rate(F.col("event_id") % 100, F.col("value") * 1e7))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("rate"), 6).alias("rate"), F.round(F.max("value"), 6).alias("slowest"))


def json_flatten_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"run": {"a": ['), F.col("value").cast("string"), F.lit(', "x"]}, "props": '), "props", F.lit("}")).alias("j"))
    leaves = answers.flatten_json(e, "event_id", "j")
    return answers.harvest_metric(leaves, "event_id", r"props\.k$").select("event_id", "value")


def clean_reject_reasons(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.col("source"), F.when(F.col("doc_id") % 2 == 0, " ").otherwise("s").alias("source_id"), F.when(F.col("doc_id") % 3 == 0, None).otherwise("d").alias("doi"), (F.col("doc_id") + 1500).cast("int").alias("year"), F.col("lang").alias("journal"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("a"))).alias("authors"), F.lit("t").alias("title"), F.col("text").alias("abstract"))
    return rows.select("doc_id", F.array_join(ingest.reject_reasons(rows), "|").alias("reasons"))


def metadata_coalesce(spark, sf_dir):
    tasks = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("lang"), F.lit(None).cast("string").alias("mark"))
    one = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, "toxic")).alias("mark")).withColumn("lang", F.lit(None).cast("string"))
    two = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", 'lang="(..)"', 1).alias("lang"), F.lit("page").alias("mark"))
    return ingest.coalesce_sources(tasks, "doc_id", [one, two], ["lang", "mark"])


def literature_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    written = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy MMM d")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" Winter"))).otherwise("soon")
    return o.select("o_orderkey", F.date_format(dates.literature_date(written), "yyyy-MM-dd").alias("day"), text.year_in(written).alias("year"))


def next_runs(spark, sf_dir):
    o = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    return o.select("event_id", F.date_format(dates.next_run(F.col("t"), F.array(F.lit("06:00"), F.lit("18:30"))), "yyyy-MM-dd HH:mm").alias("next"))


def scalar_casts(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderkey").cast("string")).otherwise("x1")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.to_int(v).alias("i"), text.digits_to_int(v).alias("d"), F.round(text.to_float(v), 4).alias("f"), text.truthy(F.when(F.col("o_orderkey") % 2 == 0, " YES ").otherwise("no")).cast("int").alias("yes"), text.disease(F.concat(F.lit("a "), F.when(F.col("o_orderkey") % 5 == 0, "VTE and cancer").when(F.col("o_orderkey") % 5 == 1, "Tumour").otherwise("cold"))).alias("topic"))


def title_similarity_match(spark, sf_dir):
    """Pool rows meet tasks by their key, and whole texts are compared: a benchmark item with the document of its number."""
    left = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"))
    right = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("b"))
    return left.join(right, F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", F.round(ratio("a", "b"), 6).alias("ratio"))


_J = """j AS (SELECT query_id, chunk_id AS doc_id, ((chunk_id + query_id) % 2 + CASE WHEN chunk_id % 5 = 0 THEN 1 ELSE 0 END)::INTEGER AS relevance FROM cand WHERE (chunk_id + query_id) % 3 = 0)"""
_R = """r AS (SELECT 'direct' AS mode, query_id, chunk_id AS doc_id, dense_rank AS rank FROM dense WHERE dense_rank <= 20 UNION ALL SELECT 'hyde', query_id, chunk_id, lexical_rank FROM lex WHERE lexical_rank <= 20)"""
_M = f"""
WITH {_CAND}, {_J}, {_R},
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS p FROM j),
ideal AS (SELECT query_id, count(*) FILTER (relevance > 0) AS relevant, coalesce(sum((pow(2, relevance) - 1) / log2(p + 1)) FILTER (p <= 5), 0) AS i5, coalesce(sum((pow(2, relevance) - 1) / log2(p + 1)) FILTER (p <= 10), 0) AS i10 FROM g GROUP BY query_id),
h AS (SELECT mode, r.query_id, count(*) AS depth, min(rank) FILTER (relevance > 0) AS f, count(*) FILTER (relevance > 0 AND rank <= 5) AS h5, count(*) FILTER (relevance > 0 AND rank <= 10) AS h10,
  coalesce(sum((pow(2, coalesce(relevance, 0)) - 1) / log2(rank + 1)) FILTER (rank <= 5), 0) AS d5, coalesce(sum((pow(2, coalesce(relevance, 0)) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS d10
  FROM r LEFT JOIN j ON j.query_id = r.query_id AND j.doc_id = r.doc_id GROUP BY mode, r.query_id),
m AS (SELECT mode, query_id, coalesce(depth, 0) AS depth, f::INTEGER AS first_relevant, coalesce(1.0::DOUBLE / f, 0) AS mrr,
  coalesce(h5, 0) / 5.0::DOUBLE AS p_at_5, CASE WHEN relevant > 0 THEN coalesce(h5, 0) / relevant::DOUBLE END AS recall_at_5, CASE WHEN i5 > 0 THEN coalesce(d5, 0) / i5 END AS ndcg_at_5,
  coalesce(h10, 0) / 10.0::DOUBLE AS p_at_10, CASE WHEN relevant > 0 THEN coalesce(h10, 0) / relevant::DOUBLE END AS recall_at_10, CASE WHEN i10 > 0 THEN coalesce(d10, 0) / i10 END AS ndcg_at_10
  FROM ideal CROSS JOIN (SELECT DISTINCT mode FROM r) LEFT JOIN h USING (mode, query_id))"""
_NAMES = ("mrr", "p_at_5", "recall_at_5", "ndcg_at_5", "p_at_10", "recall_at_10", "ndcg_at_10")
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _NAMES)
_ITEMS = """it AS (SELECT doc_id AS position, CASE WHEN doc_id % 9 = 0 THEN '' ELSE '10.5555/x.' || md5(substr(text, 1, 12)) END AS d FROM documents)"""
_ALIAS = "(VALUES (0, 'weather', 'the'), (0, 'weather', 'and'), (0, 'bridge', 'of'), (0, 'bridge', 'in the'), (0, 'garden', 'der'), (0, 'river', 'de la'), (0, 'stone', 'la'), (1, 'weather', 'the'), (1, 'bridge', 'in the'), (1, 'garden', 'in'), (1, 'garden', 'der'), (1, 'river', 'la'), (1, 'stone', 'by the')) a(guess, canonical, alias)"
_X = f"""
WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS g FROM documents),
n AS (SELECT doc_id, list(DISTINCT canonical) FILTER (guess = 0 AND contains(g, ' ' || alias || ' ')) AS gold, list(DISTINCT canonical) FILTER (guess = 1 AND contains(g, ' ' || alias || ' ')) AS predicted FROM t, {_ALIAS} GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(gold, []) AS gold, coalesce(predicted, []) AS predicted FROM n WHERE gold IS NOT NULL OR predicted IS NOT NULL),
k AS (SELECT doc_id, list_sort(list_intersect(gold, predicted)) AS hit, len(gold) AS ng, len(predicted) AS np FROM c),
x AS (SELECT doc_id, len(hit) AS tp, np - len(hit) AS fp, ng - len(hit) AS fn, array_to_string(hit, '|') AS matched FROM k),
y AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM x),
z AS (SELECT doc_id, tp::INTEGER AS tp, fp::INTEGER AS fp, fn::INTEGER AS fn, matched, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM y)"""

RECORDS = {
    "retrieval_metrics": (retrieval_metrics, f"{_M} SELECT mode, query_id, depth, first_relevant, {_ROUND} FROM m"),
    "metrics_by_mode": (metrics_by_mode, _M + ", u AS (" + " UNION ALL ".join(f"SELECT mode, '{c.replace('_at_', '@')}' AS metric, {c} AS v FROM m" for c in _NAMES) + ") SELECT mode, metric, round(avg(v), 6) AS mean, count(*) AS queries, count(*) FILTER (v IS NULL) AS excluded FROM u GROUP BY mode, metric"),
    "beir_metrics": (beir_metrics, f"""
      WITH {_CAND}, {_J}, {_R}, t AS (SELECT query_id, sum(relevance) AS total FROM j GROUP BY query_id),
      b AS (SELECT r.query_id, min(rank) FILTER (relevance > 0) AS f, count(*) FILTER (relevance > 0 AND rank <= 5) AS h5, count(*) FILTER (relevance > 0 AND rank <= 10) AS h10 FROM r LEFT JOIN j ON j.query_id = r.query_id AND j.doc_id = r.doc_id WHERE mode = 'direct' GROUP BY r.query_id)
      SELECT query_id, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, round(h5 / 5.0::DOUBLE, 6) AS p_at_5, round(CASE WHEN coalesce(total, 0) > 0 THEN least(h5 / total::DOUBLE, 1) ELSE 0 END, 6) AS recall_at_5,
        round(h10 / 10.0::DOUBLE, 6) AS p_at_10, round(CASE WHEN coalesce(total, 0) > 0 THEN least(h10 / total::DOUBLE, 1) ELSE 0 END, 6) AS recall_at_10 FROM b LEFT JOIN t USING (query_id)"""),
    "weak_label_metrics": (weak_label_metrics, f"""
      WITH {_CAND}, l AS (SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id),
      p AS (SELECT query_id, dense_rank AS rank, label, coalesce(label, 0) AS rel FROM dense LEFT JOIN l ON doc_id = chunk_id WHERE dense_rank <= 20)
      SELECT query_id, count(*) AS n_pool, count(label) AS n_labelled, round(count(label) / count(*)::DOUBLE, 6) AS coverage, round(coalesce(sum(rel) FILTER (rank <= 10), 0) / 10.0::DOUBLE, 6) AS precision,
        round(CASE WHEN sum(rel) > 0 THEN coalesce(sum(rel) FILTER (rank <= 10), 0) / sum(rel)::DOUBLE ELSE 0 END, 6) AS pool_recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (rel > 0), 0), 6) AS mrr FROM p GROUP BY query_id"""),
    "pooled_candidates": (pooled_candidates, f"""
      WITH {_CAND}, {_R}, q AS (SELECT query_id, doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE doc_id::VARCHAR END AS d, CASE WHEN doc_id % 2 = 0 AND mode = 'direct' THEN '' ELSE mode || ' t' END AS title, (CASE WHEN mode = 'direct' THEN 0 ELSE 1000 END) + rank AS o FROM r)
      SELECT query_id, id AS resolved_doc_id, coalesce(arg_min(d, o) FILTER (d <> ''), '') AS doc_id, arg_min(id, o) AS pmid, coalesce(arg_min(title, o) FILTER (title <> ''), '') AS title FROM q GROUP BY query_id, id"""),
    "overlap_audit": (overlap_audit, """
      WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels), c AS (SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (doc_id)) AS n_both)
      SELECT *, round(n_both / n_left::DOUBLE, 6) AS left_share, round(n_both / n_right::DOUBLE, 6) AS right_share FROM c"""),
    "extraction_prf": (extraction_prf, f"{_X} SELECT doc_id, tp, fp, fn, matched, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM z"),
    "extraction_summary": (extraction_summary, f"""{_X}, s AS (SELECT count(*) AS n, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(precision) AS a, avg(recall) AS b, avg(f1) AS c FROM z), m AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM s)
      SELECT n, tp, fp, fn, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, round(2 * p * r / (p + r), 6) AS micro_f1, round(a, 6) AS macro_precision, round(b, 6) AS macro_recall, round(c, 6) AS macro_f1 FROM m"""),
    "robustness_mean_std": (robustness_mean_std, "WITH s AS (SELECT event_type, user_id % 5 AS seed, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, count(v) AS n FROM s GROUP BY event_type"),
    "numeric_field_means": (numeric_field_means, "SELECT l_returnflag, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem GROUP BY l_returnflag"),
    "missing_and_shallow": (missing_and_shallow, f"""
      WITH {_CAND}, {_J}, {_R}, r2 AS (SELECT * FROM r WHERE NOT (mode = 'hyde' AND query_id % 4 = 0)), j2 AS (SELECT * FROM j WHERE query_id % 5 <> 0), h AS (SELECT DISTINCT mode, query_id FROM r2), q AS (SELECT DISTINCT query_id FROM j2)
      SELECT m.mode, q.query_id, 'not retrieved' AS problem FROM (SELECT DISTINCT mode FROM r2) m CROSS JOIN q ANTI JOIN h ON h.mode = m.mode AND h.query_id = q.query_id
      UNION ALL SELECT mode, query_id, 'not judged' FROM h ANTI JOIN q USING (query_id)
      UNION ALL SELECT mode, query_id, 'shallow' FROM r2 GROUP BY mode, query_id HAVING count(*) < 20"""),
    "grade_histogram": (grade_histogram, f"WITH {_CAND}, {_J} SELECT g::INTEGER AS relevance, (SELECT count(*) FROM j WHERE relevance = g) AS n FROM (VALUES (0), (1), (2)) v(g)"),
    "annotation_errors": (annotation_errors, """
      WITH pool AS (SELECT c_nationkey::VARCHAR AS q, c_custkey::VARCHAR AS d FROM customer),
      a AS (SELECT c_custkey + 2 AS row, CASE WHEN c_custkey % 97 = 7 THEN '' ELSE c_nationkey::VARCHAR END AS q, CASE WHEN c_custkey % 89 = 9 THEN 'none' ELSE c_custkey::VARCHAR END AS d, c_custkey % 4 AS g, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'why' END AS why, CASE WHEN c_custkey % 83 = 4 THEN 'odd' ELSE '' END AS s FROM customer WHERE c_custkey % 6 <> 0),
      e AS (SELECT row, q, d, 'empty key' AS error FROM a WHERE q = '' OR d = '' UNION ALL SELECT row, q, d, 'not in the pool' FROM a ANTI JOIN pool USING (q, d) UNION ALL SELECT NULL, q, d, 'missing' FROM pool ANTI JOIN a USING (q, d)
        UNION ALL SELECT row, q, d, 'duplicate' FROM (SELECT *, row_number() OVER (PARTITION BY q, d ORDER BY row) AS n FROM a) WHERE n > 1
        UNION ALL SELECT row, q, d, 'relevance must be 0, 1 or 2' FROM a WHERE g > 2 UNION ALL SELECT row, q, d, 'a rationale is required' FROM a WHERE g IN (1, 2) AND why = '' UNION ALL SELECT row, q, d, 'unknown status' FROM a WHERE s = 'odd')
      SELECT row, q AS query_id, d AS resolved_doc_id, error FROM e"""),
    "ingest_split_dedupe": (ingest_split_dedupe, f"""
      WITH {_ITEMS}, x AS (SELECT DISTINCT sha256(d) AS s FROM it WHERE position % 10 = 1 AND d <> ''), n AS (SELECT position, d, CASE WHEN d <> '' THEN sha256(d) END AS s, row_number() OVER (PARTITION BY d ORDER BY position) AS k FROM it)
      SELECT position, d AS doi_normalized, s AS doc_id, CASE WHEN d = '' THEN 'failed' WHEN s IN (FROM x) OR k > 1 THEN 'skipped_duplicate' ELSE 'queued' END AS state,
        CASE WHEN d = '' THEN 'invalid_doi' WHEN s IN (FROM x) THEN 'already_indexed' WHEN k > 1 THEN 'duplicate_doi' END AS message FROM n"""),
    "job_status_rollup": (job_status_rollup, """
      WITH c AS (SELECT event_id % 997 AS job_id, count(*) AS total, count(*) FILTER (event_type IN ('click', 'purchase')) AS succeeded, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped_duplicate FROM events GROUP BY 1)
      SELECT *, CASE WHEN failed > 0 AND succeeded > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'succeeded' END AS state FROM c"""),
    "outcome_merge": (outcome_merge, """
      WITH e AS (SELECT *, 'd' || user_id || '/' || strftime(ts, '%Y-%m-%d %H') AS doi, event_type IN ('view', 'click') AS queued FROM events), i AS (SELECT DISTINCT doi FROM e WHERE queued),
      d AS (SELECT doi, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS state, event_type AS message FROM e WHERE NOT queued QUALIFY row_number() OVER (PARTITION BY doi ORDER BY event_id DESC) = 1)
      SELECT coalesce(i.doi, d.doi) AS doi, CASE WHEN i.doi IS NULL THEN 'failed' ELSE coalesce(d.state, 'queued') END AS state, CASE WHEN i.doi IS NULL THEN 'unexpected_doi' ELSE d.message END AS message FROM i FULL JOIN d ON i.doi = d.doi"""),
    "run_status_rollup": (run_status_rollup, """
      WITH q AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1), s AS (SELECT o_custkey AS run_id, CASE WHEN f = 0 THEN 'SUCCESS' WHEN f >= n THEN 'FAILED' ELSE 'PARTIAL' END AS s FROM q JOIN orders ON o_orderkey = l_orderkey),
      r AS (SELECT run_id, count(*) AS total, count(*) FILTER (s = 'SUCCESS') AS succeeded, count(*) FILTER (s = 'FAILED') AS failed FROM s GROUP BY 1)
      SELECT *, CASE WHEN total = succeeded THEN 'SUCCESS' WHEN total = failed THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM r"""),
    "query_execution_counts": (query_execution_counts, """
      WITH s AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'N' THEN 'SKIPPED' WHEN l_linestatus = 'O' THEN 'ENQUEUED' ELSE 'OK' END AS s FROM lineitem),
      c AS (SELECT l_orderkey AS query_execution_id, count(*) AS resolved, count(*) FILTER (s = 'SKIPPED') AS skipped_exists, count(*) FILTER (s = 'ENQUEUED') AS enqueued, count(*) FILTER (s = 'OK') AS succeeded, count(*) FILTER (s = 'FAILED') AS failed FROM s GROUP BY 1)
      SELECT *, CASE WHEN failed = 0 THEN 'SUCCESS' WHEN failed >= resolved THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM c"""),
    "runs_nested": (runs_nested, "SELECT c_custkey AS run_id, count(o_orderkey)::INTEGER AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey::VARCHAR), '') AS ids FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "runs_listed": (runs_listed, "SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN '1996-01-01' AND '1996-06-30'"),
    "incremental_since": (incremental_since, "SELECT event_id FROM events WHERE event_id % 2 = 1 OR ts > TIMESTAMP '2024-01-02 12:00:00'"),
    "unique_dois": (unique_dois, "WITH d AS (SELECT event_id AS position, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type || (user_id % 30) END AS doi FROM events) SELECT position, doi FROM d QUALIFY row_number() OVER (PARTITION BY lower(doi) ORDER BY position) = 1"),
    "high_water_marks": (high_water_marks, "SELECT o_custkey AS query_id, strftime(max(o_orderdate), '%Y-%m-%d') AS mark FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1"),
    "index_anti_join": (index_anti_join, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    "index_semi_join": (index_semi_join, "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)"),
    "latest_wins_upsert": (latest_wins_upsert, """
      WITH e AS (SELECT user_id AS point_id, event_type, value, event_id AS position FROM events) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY event_type IN ('view', 'click'), e.position DESC) = 1"""),
    "delete_documents": (delete_documents, f"WITH {search._sql_windows(1200, 150)} SELECT doc_id, chunk_index FROM w WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"),
    "idempotency_keys": (idempotency_keys, """
      WITH RECURSIVE k AS (SELECT event_id, user_id || ':' || event_type AS key, ts FROM events),
      r AS (
        SELECT key, min(ts) AS ts FROM k GROUP BY key
        UNION ALL
        SELECT r.key, min(k.ts) AS ts FROM r JOIN k ON k.key = r.key AND epoch_us(k.ts) - epoch_us(r.ts) > 86400000000 GROUP BY r.key, r.ts)
      SELECT event_id, key FROM k JOIN r USING (key, ts)"""),
    "idempotency_conflicts": (idempotency_conflicts, "SELECT user_id AS idempotency_key, count(DISTINCT event_type) AS bodies FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1"),
    "slot_fire_once": (slot_fire_once, "SELECT DISTINCT strftime(ts, '%Y-%m-%d %H:%M') AS slot FROM events"),
    "hourly_counts": (hourly_counts, "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "user_sessions": (user_sessions, """
      WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s"""),
    "audit_latency": (audit_latency, "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value * 1e7 > 0 THEN (event_id % 100) / (value * 1e7 / 1e9) END), 6) AS rate, round(max(value), 6) AS slowest FROM events GROUP BY 1"),
    "json_flatten_metrics": (json_flatten_metrics, "SELECT event_id, json_extract(props, '$.k')::DOUBLE AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL"),
    "clean_reject_reasons": (clean_reject_reasons, """
      SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'missing source_id' END, CASE WHEN doc_id % 3 = 0 THEN 'missing doi' END, CASE WHEN doc_id + 1500 NOT BETWEEN 1800 AND 2100 THEN 'missing or invalid year' END, CASE WHEN doc_id % 5 = 0 THEN 'missing authors' END, CASE WHEN trim(text) = '' THEN 'missing abstract' END], lambda x: x IS NOT NULL), '|') AS reasons FROM documents"""),
    "metadata_coalesce": (metadata_coalesce, """
      WITH a AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'toxic' END) AS mark FROM labels GROUP BY 1), b AS (SELECT page_id AS doc_id, regexp_extract(html, 'lang="(..)"', 1) AS lang, 'page' AS mark FROM pages)
      SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 4 = 0 THEN d.lang END, b.lang) AS lang, coalesce(a.mark, b.mark) AS mark FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)"""),
    "literature_dates": (literature_dates, """
      SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-01-01') END AS day, CASE WHEN o_orderkey % 4 < 3 THEN year(o_orderdate)::INTEGER END AS year FROM orders"""),
    "next_runs": (next_runs, """
      SELECT event_id, strftime(CASE WHEN ts::TIME < TIME '06:00' THEN date_trunc('day', ts) + INTERVAL 6 HOUR WHEN ts::TIME < TIME '18:30' THEN date_trunc('day', ts) + INTERVAL '18:30' HOUR_MINUTE ELSE date_trunc('day', ts) + INTERVAL 30 HOUR END, '%Y-%m-%d %H:%M') AS next FROM events""".replace("INTERVAL '18:30' HOUR_MINUTE", "INTERVAL 1110 MINUTE")),
    "scalar_casts": (scalar_casts, """
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN trunc(o_totalprice)::BIGINT WHEN o_orderkey % 3 = 1 THEN o_orderkey END AS i, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END AS d, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice, 4) WHEN o_orderkey % 3 = 1 THEN o_orderkey::DOUBLE END AS f,
        (o_orderkey % 2 = 0)::INTEGER AS yes, CASE WHEN o_orderkey % 5 = 0 THEN 'thrombosis' WHEN o_orderkey % 5 = 1 THEN 'cancer' ELSE 'unknown' END AS topic FROM orders"""),
    "title_similarity_match": (title_similarity_match, None),
}
