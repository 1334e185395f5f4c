"""Queries over workflows: exports, batches of ids, ingestion, schedules, tables of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import computed_once
from ..operators import answers, batches, chunking, export, ingest, ranking, schedules, tables
from ..streaming import capture, enqueue
from . import search_queries as search
from . import workflows
from .search_queries import _BOTH, _sql_windows, table


def retrieval_export(spark, sf_dir):
    """Three ranked artifacts of two nearest-neighbour searches, by way of the service's traces."""
    first, second = (computed_once(x) for x in search._both(spark, sf_dir))
    of = lambda df, mode, key, order: ranking.ranked(df, order, "place").withColumn("mode", F.lit(mode)).withColumn("key", F.lit(key))
    ranks = ranking.ranked(first, "score", "dense").select("query_id", "chunk_id", "dense").join(ranking.ranked(second, "score", "hyde").select("query_id", "chunk_id", "hyde"), ["query_id", "chunk_id"], "full_outer")
    merged = ranking.union_candidates(first, second).join(ranks, ["query_id", "chunk_id"]).withColumn("fused", ranking.rrf(dense=F.col("dense"), hyde=F.col("hyde"))).drop("dense", "hyde")
    asked, imagined = first.withColumn("origin", F.lit("question")), second.withColumn("origin", F.lit("hyde"))
    parts = [of(asked, "direct", "question_candidates", "score"), of(asked, "direct", "selected_candidates", "score").where("place <= 6"), of(imagined, "hyde", "hyde_candidates", "score"), of(merged, "hyde", "selected_candidates", "fused").where("place <= 6").drop("fused")]
    pool = reduce(DataFrame.unionByName, parts).withColumn("doc_id", F.concat(F.lit(" d"), "chunk_id")).withColumn("doi", F.lit(None).cast("string")).withColumn("title", F.lit(None).cast("string"))
    modes = search.probes(spark, sf_dir).select("query_id", F.concat(F.lit("Question "), "query_id").alias("question"), F.explode(F.array(F.lit("direct"), F.lit("hyde"))).alias("mode"))
    responses = computed_once(export.debug_traces(modes, pool))
    rows = [df.withColumn("artifact", F.lit(name)) for name, df in export.export_artifacts(responses, "run").items()]
    out = reduce(DataFrame.unionByName, rows)
    return out.select("artifact", "query_id", "question", "retrieval_mode", "rank", "chunk_id", "doc_id", "doi", F.round("score", 6).alias("score"), "candidate_origin", "selected_for_context")


def id_batches(spark, sf_dir):
    """All documents' ids as one list, and the ids of each source, in batches."""
    docs = table(spark, sf_dir, "documents").select(F.explode(F.array(F.lit("all"), "source")).alias("key"), F.col("doc_id").alias("position"), F.concat(F.lit("PMC"), "doc_id").alias("id"))
    out = batches.batch_table(batches.id_batches(docs, most=40, chars=250))
    return out.select("key", "batch", "n_ids", F.length("ids").alias("n_chars"), F.md5("ids").alias("digest"))


def job_outcomes(spark, sf_dir):
    """Jobs of users and days: reservations, payloads, refused and finished work, from a replay of the events."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("reserve", "reserve", "reserve", "store", "enqueue", "enqueue_failed", "work"))), (F.col("event_id") % 7 + 1).cast("int"))
    events = e.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("action"), F.concat(F.lit("d"), F.col("event_id") % 400).alias("doc_id"))
    indexed = table(spark, sf_dir, "embeddings").where("label = 1").select(F.concat(F.lit("d"), "vec_id").alias("doc_id"))
    return enqueue.replay(events, indexed, enqueue.Rules(patience=4 * 3_600_000, payload=12 * 3_600_000, give_up=24 * 3_600_000))


def request_capture(spark, sf_dir):
    """Views and clicks of a user as requests, purchases and errors as the responses that close them."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    requests = e.where("event_type IN ('view', 'click')").select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("request_id"), F.col("at").alias("received_at"))
    responses = e.where("event_type IN ('purchase', 'error')").select(F.col("event_id").alias("response_id"), F.col("user_id").alias("request_id"), F.col("at").alias("completed_at"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("response_status"))
    out = capture.captured(requests, responses, 12)
    return out.select("audit_id", "request_id", F.unix_micros("received_at").alias("received"), F.unix_micros("completed_at").alias("completed"), "response_status", "duration_ms", "status")


def schedule_status(spark, sf_dir):
    """What the schedule of each customer says at the times of that user's events, moved back to the years of the orders."""
    asked = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("schedule"), (F.col("ts").cast("timestamp") - F.make_dt_interval(days=(8000 + F.col("event_id") * 37 % 3000).cast("int"))).alias("asked_at"), F.array(F.lit("06:00"), F.lit("18:30")).alias("times"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("schedule"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_orderstatus").alias("status"))
    out = schedules.schedule_status(asked, runs)
    minute = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return out.select("event_id", "schedule", minute("next_run_at"), minute("last_run_at"), "last_run_status")


def run_results(spark, sf_dir):
    """Line items as the DOIs of orders, asked for by every order and by numbers that no order has."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    dois = table(spark, sf_dir, "lineitem").where("l_linenumber <= 5").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("10.1/"), F.col("l_partkey")).alias("doi"), F.col("l_returnflag").alias("status"), F.lit(None).cast("string").alias("error_message"), F.timestamp_seconds(F.col("l_linenumber")).alias("created_at"))
    asked = runs.select(F.explode(F.array("run_id", -F.col("run_id") - 1)).alias("run_id"))
    return schedules.run_results(asked, runs, dois).select("run_id", F.size("results").alias("n"), F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["doi"], r["status"])), ",").alias("listed"))


def _picky(texts):
    """An embedder that leaves out texts with a dollar sign, and can't read one with an ampersand."""
    if any("&" in t for t in texts):
        raise ValueError("cannot read &")
    return [[float(len(t)), 1.0] for t in texts if "$" not in t]


def ingest_documents(spark, sf_dir):
    """Documents through chunks and vectors into points; every item has one status, and only whole ones have points."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("text")).alias("content_text"), F.col("source").alias("journal"))
    indexed = table(spark, sf_dir, "embeddings").where("label = 1").select(F.col("vec_id").cast("string").alias("doc_id"))
    done = computed_once(ingest.ingest_documents(docs, indexed, lambda t: chunking.fixed_windows(t, 500, 100), lambda: _picky))
    points = ingest.item_points(done, F.lit("2024-01-01T00:00:00Z")).groupBy("doc_id").agg(F.min("point_id").alias("first_point"), F.sum("chunk_end").alias("ends"), F.sum(F.element_at("vector", 1)).cast("long").alias("chars"))
    return ingest.item_statuses(done).join(points, "doc_id", "left")


def _commands(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    command = F.element_at(F.array(*map(F.lit, ("update", "create", "enable", "disable", "create", "remove"))), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.col("user_id").alias("query_id"), F.col("ts").cast("timestamp").alias("at"), command.alias("command"), F.when(F.col("event_id") % 11 != 0, F.concat(F.lit(" "), "props")).alias("pubmed_query"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).otherwise(" ").alias("description"), (F.col("value") > 5).alias("enabled"))


def saved_query_outcomes(spark, sf_dir):
    told, _ = tables.saved_query_changes(_commands(spark, sf_dir))
    return told.groupBy("query_id", "command", "outcome").agg(F.count("*").alias("n"), F.max(F.unix_micros("at")).alias("last"))


def saved_queries(spark, sf_dir):
    _, queries = tables.saved_query_changes(_commands(spark, sf_dir))
    return queries.select("query_id", "pubmed_query", "description", "enabled", F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"))


def benchmark_table(spark, sf_dir):
    """Values of events by kind as measures, of four groups of users as configurations; one kind lacks a configuration, and one configuration has no value."""
    configuration = F.element_at(F.array(*map(F.lit, ("rag_hyde", "rag_no_hyde", "llm_only", "other"))), (F.col("user_id") % 4 + 1).cast("int"))
    value = F.when(~((F.col("user_id") % 4 == 2) & (F.col("event_type") == "view")), F.col("value"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("run/"), F.col("user_id") % 7).alias("file"), configuration.alias("configuration"), F.col("event_type").alias("metric"), value.alias("value"))
    out = workflows.configuration_table(workflows.configuration_means(rows), workflows.CONFIGURATIONS | {"absent": "Absent"})
    return out.select("metric", *(F.round(f"`{c}`", 6).alias(c.replace(" ", "_")) for c in out.columns if c != "metric"))


def benchmark_summary(spark, sf_dir):
    """Measures found in JSON summaries made of events, of a shape that the reader doesn't know."""
    number = F.col("value").cast("string")
    text = F.concat(F.lit('{"b": {"nDCG@10": '), number, F.lit(', "x": ["no", {"Recall@5": 1}]}, "a": {"ndcg@10": '), F.col("event_id").cast("string"), F.lit(', "F1": "0.5", "accuracy": true, "z_recall@5": 2, "MRR": null, "props": '), F.col("props"), F.lit("}}"))
    out = answers.summary_metrics(table(spark, sf_dir, "events").select("event_id", text.alias("j")), "event_id", "j")
    return out.select("event_id", "metric", F.round("value", 6).alias("value"))


def sentence_chunks(spark, sf_dir):
    """Whole documents in packed sentences with tails."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.sentence_chunks(F.col("text"), chunking.Sentences(400, 60))).alias("place", "chunk"))
    return docs.select("doc_id", "place", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


_COMMANDS = """
c AS (SELECT user_id AS query_id, ts, event_id, (['update', 'create', 'enable', 'disable', 'create', 'remove'])[event_id % 6 + 1] AS command, CASE WHEN event_id % 11 <> 0 THEN trim(props) END AS q,
  CASE WHEN event_id % 13 <> 0 THEN event_type END AS d, value > 5 AS enabled FROM events),
b AS (SELECT *, CASE WHEN command IN ('create', 'update') AND q IS NULL THEN 'invalid: pubmed_query' WHEN command IN ('create', 'update') AND d IS NULL THEN 'invalid: description' WHEN command = 'remove' THEN 'invalid: command' END AS bad FROM c),
t AS (SELECT *, min(ts) FILTER (command = 'create' AND bad IS NULL) OVER (PARTITION BY query_id) AS t0 FROM b),
o AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN command = 'create' AND ts = t0 THEN 'created' WHEN t0 IS NULL OR ts < t0 THEN 'not_found' WHEN command = 'create' THEN 'exists' ELSE command || 'd' END AS outcome FROM t)"""

WORKFLOWS = {
    "retrieval_export": (retrieval_export, f"""
      WITH {_BOTH},
      q AS (SELECT query_id, chunk_id, score, rank FROM top WHERE src = 0), h AS (SELECT query_id, chunk_id, score, rank FROM top WHERE src = 1),
      m AS (SELECT query_id, chunk_id, greatest(q.score, h.score) AS score, CASE WHEN h.rank IS NULL THEN 'question' WHEN q.rank IS NULL THEN 'hyde' ELSE 'both' END AS origin,
          round(coalesce(1.0::DOUBLE / (60 + q.rank), 0) + coalesce(0.6::DOUBLE / (60 + h.rank), 0), 9) AS fused FROM q FULL JOIN h USING (query_id, chunk_id)),
      s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS place FROM m QUALIFY place <= 6),
      r AS (
        SELECT 'direct' AS artifact, query_id, 'direct' AS retrieval_mode, rank, chunk_id, score, 'question' AS candidate_origin, rank <= 6 AS selected_for_context FROM q
        UNION ALL SELECT 'hyde', query_id, 'hyde', rank, chunk_id, h.score, 'hyde', s.place IS NOT NULL FROM h LEFT JOIN s USING (query_id, chunk_id)
        UNION ALL SELECT 'final_context', query_id, 'direct', rank, chunk_id, score, 'question', TRUE FROM q WHERE rank <= 6
        UNION ALL SELECT 'final_context', query_id, 'hyde', place, chunk_id, score, origin, TRUE FROM s)
      SELECT artifact, query_id::VARCHAR AS query_id, 'Question ' || query_id AS question, retrieval_mode, rank::INTEGER AS rank, chunk_id::VARCHAR AS chunk_id, 'd' || chunk_id AS doc_id, '' AS doi,
        round(score, 6) AS score, candidate_origin, selected_for_context FROM r"""),
    "id_batches": (id_batches, """
      WITH RECURSIVE k AS (SELECT 'all' AS key, doc_id FROM documents UNION ALL SELECT source, doc_id FROM documents),
      d AS (SELECT key, doc_id AS position, 'PMC' || doc_id AS id, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS i FROM k),
      w AS (
        SELECT key, position, id, i, 0::BIGINT AS batch, 1 AS n, length(id) AS chars FROM d WHERE i = 1
        UNION ALL
        SELECT d.key, d.position, d.id, d.i, CASE WHEN new THEN batch + 1 ELSE batch END, CASE WHEN new THEN 1 ELSE n + 1 END, CASE WHEN new THEN length(d.id) ELSE chars + 1 + length(d.id) END
        FROM w JOIN d ON d.key = w.key AND d.i = w.i + 1, LATERAL (SELECT n + 1 > 40 OR chars + 1 + length(d.id) > 250 AS new))
      SELECT key, batch, count(*)::INTEGER AS n_ids, length(string_agg(id, ',' ORDER BY position))::INTEGER AS n_chars, md5(string_agg(id, ',' ORDER BY position)) AS digest FROM w GROUP BY key, batch"""),
    "job_outcomes": (job_outcomes, None),  # a state machine with deadlines: tests/core/test_enqueue.py holds it against the stream
    "request_capture": (request_capture, """
      WITH q AS (SELECT event_id AS audit_id, user_id AS request_id, ts FROM events WHERE event_type IN ('view', 'click')),
      r AS (SELECT event_id AS response_id, user_id AS request_id, ts, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS code FROM events WHERE event_type IN ('purchase', 'error')),
      n AS (SELECT r.*, q.audit_id, q.ts AS received FROM r ASOF JOIN q ON r.request_id = q.request_id AND r.ts >= q.ts),
      c AS (SELECT * FROM n WHERE ts <= received + INTERVAL 12 HOUR QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY ts DESC, response_id DESC) = 1)
      SELECT q.audit_id, q.request_id, epoch_us(q.ts) AS received, epoch_us(c.ts) AS completed, code AS response_status, ((epoch_us(c.ts) - epoch_us(q.ts)) // 1000)::BIGINT AS duration_ms,
        CASE WHEN code >= 400 THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM q LEFT JOIN c USING (audit_id)"""),
    "schedule_status": (schedule_status, """
      WITH a AS (SELECT event_id, user_id AS schedule, ts - to_days((8000 + event_id * 37 % 3000)::INTEGER) AS t FROM events),
      r AS (SELECT o_custkey AS schedule, o_orderdate AS started, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2)
      SELECT event_id, a.schedule,
        strftime(CASE WHEN t::TIME < TIME '06:00' THEN date_trunc('day', t) + INTERVAL 6 HOUR WHEN t::TIME < TIME '18:30' THEN date_trunc('day', t) + INTERVAL 1110 MINUTE ELSE date_trunc('day', t) + INTERVAL 30 HOUR END, '%Y-%m-%d %H:%M') AS next_run_at,
        strftime(started, '%Y-%m-%d %H:%M') AS last_run_at, status AS last_run_status
      FROM a ASOF LEFT JOIN r ON a.schedule = r.schedule AND a.t >= r.started"""),
    "run_results": (run_results, """
      WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg('10.1/' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, '10.1/' || l_partkey, l_returnflag) AS listed FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1)
      SELECT DISTINCT o_orderkey AS run_id, coalesce(n, 0)::INTEGER AS n, coalesce(listed, '') AS listed FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
      UNION ALL SELECT DISTINCT -o_orderkey - 1, NULL, NULL FROM orders"""),
    "ingest_documents": (ingest_documents, f"""
      WITH {_sql_windows(500, 100)},
      c AS (SELECT doc_id, count(*) AS n, bool_or(contains(piece, '&')) AS bad, bool_or(contains(piece, '$')) AS short, sum(stop)::BIGINT AS ends, sum(length(piece))::BIGINT AS chars FROM w GROUP BY doc_id),
      p AS (SELECT doc_id, sha1(unhex('b2c2df407a1b4f9a9e1c0e7c8a7f6c1a') || (doc_id || ':' || chunk_index)::BLOB) AS h FROM w),
      u AS (SELECT doc_id, min(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(h, 17, 2))::INTEGER & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12)) AS first_point FROM p GROUP BY doc_id),
      s AS (
        SELECT doc_id, CASE WHEN doc_id % 50 = 0 OR n IS NULL THEN 'empty_document_text' WHEN bad THEN 'embedding_failed' WHEN short THEN 'embedding_count_mismatch'
            WHEN doc_id IN (SELECT vec_id FROM embeddings WHERE label = 1) THEN 'duplicate_doc' END AS message, n, ends, chars, first_point
        FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN u USING (doc_id))
      SELECT doc_id::VARCHAR AS doc_id, CASE WHEN message IS NULL THEN 'succeeded' WHEN message = 'duplicate_doc' THEN 'skipped_duplicate' ELSE 'failed' END AS state, message, (CASE WHEN message IS NULL THEN n ELSE 0 END)::INTEGER AS n_points,
        CASE WHEN message IS NULL THEN first_point END AS first_point, CASE WHEN message IS NULL THEN ends END AS ends, CASE WHEN message IS NULL THEN chars END AS chars FROM s"""),
    "saved_query_outcomes": (saved_query_outcomes, f"""
      WITH {_COMMANDS}
      SELECT query_id, command, outcome, count(*) AS n, max(epoch_us(ts)) AS last FROM o GROUP BY ALL"""),
    "saved_queries": (saved_queries, f"""
      WITH {_COMMANDS}
      SELECT query_id, arg_max(q, ts) FILTER (outcome IN ('created', 'updated')) AS pubmed_query, arg_max(d, ts) FILTER (outcome IN ('created', 'updated')) AS description,
        arg_max(CASE outcome WHEN 'created' THEN enabled ELSE outcome = 'enabled' END, ts) FILTER (outcome <> 'updated') AS enabled, epoch_us(any_value(t0)) AS created, max(epoch_us(ts)) AS updated
      FROM o WHERE outcome IN ('created', 'updated', 'enabled', 'disabled') GROUP BY query_id"""),
    "benchmark_table": (benchmark_table, """
      WITH r AS (SELECT event_type AS metric, user_id % 4 AS c, user_id % 7 AS file, avg(CASE WHEN NOT (user_id % 4 = 2 AND event_type = 'view') THEN value END) AS v FROM events GROUP BY ALL),
      g AS (SELECT metric, c, avg(v) AS mean, grouping(c) AS over FROM r GROUP BY GROUPING SETS ((metric, c), (metric)))
      SELECT metric, round(max(CASE WHEN c = 2 THEN mean END), 6) AS LLM_only, round(max(CASE WHEN c = 1 THEN mean END), 6) AS RAG_no_HyDE, round(max(CASE WHEN c = 0 THEN mean END), 6) AS RAG_HyDE,
        round(max(CASE WHEN over = 1 THEN mean END), 6) AS "All" FROM g GROUP BY metric"""),
    "benchmark_summary": (benchmark_summary, """
      SELECT event_id, 'ndcg@10' AS metric, event_id::DOUBLE AS value FROM events UNION ALL SELECT event_id, 'nDCG@10', value FROM events UNION ALL SELECT event_id, 'Recall@5', 1 FROM events
      UNION ALL SELECT event_id, 'recall@5', 2 FROM events UNION ALL SELECT event_id, 'accuracy', 1 FROM events"""),
    "sentence_chunks": (sentence_chunks, None),  # a fold with carried tails: tests/core/test_results_and_readers.py holds it against a plain loop
}
