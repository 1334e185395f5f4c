"""Queries of this subpackage, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored
from .cover_search import topk_search
from .fill_in_middle import digest_outputs
from .filter_audit import audit_filters
from .hmm_scoring import score_documents as score_language
from .ngram_join import jaccard_links
from .quality_rules import rate_documents
from .sentencepiece_codec import digest_documents
from .source_mix import mix_documents
from .suffix_dedup import dedup_substrings
from .token_counts import count_lengths, length_table
from .toxicity import score_documents as score_toxicity
from .warc import archive_pages
from .window_dedup import dedup_windows


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(stored(count_lengths(read(spark, sf_dir, "documents")), "lengths"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(read(spark, sf_dir, "documents"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read(spark, sf_dir, "documents"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(read(spark, sf_dir, "embeddings"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mix_documents(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "block", "round", "slot", "release", "deadline", "place")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(read(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_outputs(read(spark, sf_dir, "documents"))


QUERIES = (op1_hmm, op2_token_counts, op3_toxicity, op4_ngram_join, op5_suffix_array, op6_window_dedup, op7_sentencepiece, op8_cover_tree, op9_source_mix, op10_quality_rules, op11_warc, op12_filter_audit, op13_fill_in_middle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM m
"""

OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, FALSE)] AS fails FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
e AS (
  SELECT part, filter_order, step, n, good, toxic, fails[ascii(filter_order[step]) - 64] AS failed, len(list_filter(fails, lambda y: y)) AS n_failed,
    len(list_filter(range(1, step), lambda k: fails[ascii(filter_order[k]) - 64])) > 0 AS gone FROM g, s),
a AS (
  SELECT part, filter_order, step,
    sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND failed THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed AND n_failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM e GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM a
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_cover_tree": OP8_SQL, "op11_warc": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
