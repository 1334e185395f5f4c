"""Queries over vectors, chunks and texts. Each is a plan over the operators; SQL holds the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import assembly, chunking, ranking, retrieval
from ..sources import readers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probes(spark, sf_dir, remainder: int = 0) -> DataFrame:
    """Every 25th vector asks."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 25 == remainder).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")


def _knn(distance: str):
    def query(spark, sf_dir):
        return retrieval.knn(probes(spark, sf_dir), points(spark, sf_dir), 10, distance).select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")

    return query


def knn_filtered_topk(spark, sf_dir):
    where = retrieval.compile_filters({"year": 3}, {"year": "label"})
    return retrieval.knn(probes(spark, sf_dir), points(spark, sf_dir), 10, "cosine", where).select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")


def knn_year_range_topk(spark, sf_dir):
    where = retrieval.compile_filters({"year_min": 2, "year_max": 5, "disease": " "}, {"year": "label"})
    return retrieval.knn(probes(spark, sf_dir), points(spark, sf_dir), 5, "dot", where).select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")


def _both(spark, sf_dir):
    first = retrieval.knn(probes(spark, sf_dir), points(spark, sf_dir), 20)
    moved = probes(spark, sf_dir, 1).withColumn("query_id", F.col("query_id") - 1)
    second = retrieval.knn(moved, points(spark, sf_dir), 20)
    named = lambda df: df.select("query_id", F.col("point_id").alias("chunk_id"), "score")
    return named(first), named(second)


def hyde_union_dedupe(spark, sf_dir):
    first, second = _both(spark, sf_dir)
    return ranking.union_candidates(first, second).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "origin")


def candidates(spark, sf_dir, k: int = 40) -> DataFrame:
    """Texts of the nearest vectors of each benchmark item that has one: query_id, chunk_id, score, chunk_text, section."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(table(spark, sf_dir, "embeddings"), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = retrieval.knn(asked, points(spark, sf_dir), k).select("query_id", F.col("point_id").alias("chunk_id"), "score")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), "source")
    section = F.when(F.col("chunk_id") % 4 == 0, "Results").when(F.col("chunk_id") % 4 == 1, "Methods").when(F.col("chunk_id") % 4 == 2, "Discussion").otherwise(F.lit(None))
    return near.join(docs, "chunk_id").withColumn("section", section)


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def bm25_rank(spark, sf_dir):
    scored = ranking.bm25(candidates(spark, sf_dir), questions(spark, sf_dir))
    return ranking.ranked(scored, "bm25", "rank").select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "rank")


def hybrid_search_docs(spark, sf_dir):
    out = ranking.rerank(candidates(spark, sf_dir).withColumn("section", F.lit(None).cast("string")), questions(spark, sf_dir))
    return out.where("rank <= 10").select("query_id", "chunk_id", "dense_rank", "lexical_rank", F.round("fused", 9).alias("fused"), "rank")


def section_boost_rerank(spark, sf_dir):
    out = ranking.rerank(candidates(spark, sf_dir), questions(spark, sf_dir), {"lexical": 0.1})
    return out.where("rank <= 10").select("query_id", "chunk_id", F.round("boosted", 9).alias("boosted"), "rank")


def rrf_fusion(spark, sf_dir):
    first, second = _both(spark, sf_dir)
    ranks = ranking.ranked(first, "score", "dense").select("query_id", "chunk_id", "dense").join(ranking.ranked(second, "score", "hyde").select("query_id", "chunk_id", "hyde"), ["query_id", "chunk_id"], "full_outer")
    return ranks.select("query_id", "chunk_id", F.round(ranking.rrf(dense=F.col("dense"), hyde=F.col("hyde")), 9).alias("fused"))


def _window_chunks(spark, sf_dir, size=1200, overlap=150):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.inline(chunking.fixed_windows(F.col("text"), size, overlap)))


def fixed_window_chunks(spark, sf_dir):
    return _window_chunks(spark, sf_dir).select("doc_id", F.col("index").alias("chunk_index"), "start", F.col("end").alias("stop"), F.md5("text").alias("digest"))


def section_chunks(spark, sf_dir):
    return chunking.chunk_table(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "index", "start", "end", "section", "subsection", F.length("text").alias("n_chars"))


def best_chunk_per_doc(spark, sf_dir):
    hits = _window_chunks(spark, sf_dir).select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") * 1000 + F.col("index")).alias("point_id"), (F.length(F.regexp_replace("text", "[^e]", "")) / F.length("text")).alias("score"))
    best = retrieval.top_documents(retrieval.best_per_document(hits), 20)
    return best.select("query_id", "doc_id", "point_id", F.round("score", 6).alias("score"), "doc_rank")


def assemble_overlap(spark, sf_dir):
    chunks = _window_chunks(spark, sf_dir, 500, 100).select("doc_id", F.col("index").alias("chunk_index"), "start", "end", (F.col("doc_id") * 1000 + F.col("index")).alias("chunk_id"), F.lit("s").alias("section"), F.col("text").alias("chunk_text"))
    out = assembly.assemble(chunks, ["doc_id"])
    return out.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"), F.size("chunk_ids").alias("n_chunks"), F.array_join("sections", "|").alias("sections"))


def assemble_document(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("text").alias("chunk_text"), F.col("role").alias("section"), F.lit("2024-01-01T00:00:00Z").alias("updated_at"), F.lit(None).cast("string").alias("created_at"))
    out = assembly.lookup_documents(turns, ["conv_id"])
    return out.select("conv_id", F.md5("text").alias("digest"), F.array_join("sections", "|").alias("sections"), "n_chunks")


def context_pack(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("role").alias("section"), F.col("text").alias("chunk_text"))
    out = assembly.pack_context(turns, max_chars=600, max_chunks=6)
    return out.select("query_id", F.array_join("chunk_ids", "|").alias("chunk_ids"), F.md5("context").alias("digest"), "n_chars")


def cap_contexts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    out = turns.select("conv_id", assembly.cap_texts(F.transform("l", lambda x: x["text"]), 4, 120, 300).alias("t"))
    return out.select("conv_id", F.size("t").alias("n"), F.aggregate("t", F.lit(0), lambda s, x: s + F.length(x)).alias("n_chars"), F.md5(F.array_join("t", "|")).alias("digest"))


def doc_ids_uuid5(spark, sf_dir):
    key = F.concat(F.lit("10.1000/é."), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.document_id(key).alias("sha"), ids.point_id(ids.document_id(key), F.lit(3)).alias("uuid"))


def canonical_url_ids(spark, sf_dir):
    """DOIs whose suffix is the path of a page's address."""
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    made = lambda before, after="": F.concat(F.lit(before), path, F.lit(after))
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.canonical_doi(made("see https://doi.org/10.1234/AB.", "). ")).alias("canonical"), text.canonical_doi(F.col("url")).alias("none"), text.doi_without_prefixes(made(" DOI: 10.1/")).alias("b"), text.doi_without_addresses(made("https://doi.org/10.1/A")).alias("c"), text.doi_from_plain(made("https://doi.org/10.1/A")).alias("d"))


def norm_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.plain(F.col("text"))).alias("plain"), F.md5(text.plain_spaced(F.col("text"))).alias("spaced"), text.capped(F.col("text"), 40).alias("capped"))


def tokenize_stats(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def section_keys(spark, sf_dir):
    titles = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit(" & "), F.when(F.col("p_partkey") % 3 == 0, "Results").otherwise("Materials and Methods")).alias("t"), F.when(F.col("p_partkey") % 3 == 0, " Results ").when(F.col("p_partkey") % 3 == 1, "Materials and METHODS").alias("s"))
    return titles.select("p_partkey", text.section_key(F.col("t")).alias("key"), text.section_weight(F.col("s")).alias("weight"), text.truncated(F.col("t"), 12).alias("short"))


def index_exists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return retrieval.exists(docs, index).select("doc_id", F.col("exists").cast("int").alias("found"))


def fetch_by_doc_ids(spark, sf_dir):
    chunks = _window_chunks(spark, sf_dir).withColumnRenamed("index", "chunk_index")
    wanted = table(spark, sf_dir, "embeddings").where("label = 1").select(F.col("vec_id").alias("doc_id"))
    return retrieval.fetch_by_documents(chunks, wanted, F.col("source") != "src3").select("doc_id", "chunk_index")


def page_records(spark, sf_dir):
    """Literature records made of pages: the page's title, with markup inside, its language as the author's family name."""
    title = readers.xml_text(F.regexp_replace(F.regexp_extract("html", "<title>(.*?)</title>", 1), "&[a-z]+;", " and "))
    xml = F.concat(F.lit("<A><PMID>"), "page_id", F.lit("</PMID><ArticleTitle>\n<i>"), title, F.lit("</i> end</ArticleTitle><PubDate>"), (F.col("page_id") % 150 + 1900).cast("string"), F.lit(" May</PubDate><Author><ForeName>"), F.length("html"), F.lit("</ForeName><LastName>"), readers.xml_text(F.regexp_extract("html", 'lang="(..)"', 1)), F.lit("</LastName></Author></A>"))
    return readers.article_records(table(spark, sf_dir, "pages").select("page_id", xml.alias("xml"))).select("page_id", "pmid", "title", "year", F.array_join("authors", "|").alias("authors"))


def search_flagship(spark, sf_dir):
    """Hybrid search, best first: chunks near each question, fused with their lexical ranks, one per document, with their texts' beginnings."""
    out = ranking.rerank(candidates(spark, sf_dir), questions(spark, sf_dir)).withColumn("doc_id", F.col("chunk_id").cast("string")).withColumn("point_id", F.col("chunk_id"))
    best = retrieval.top_documents(retrieval.best_per_document(out.withColumn("score", F.round("boosted", 9))), 10)
    return best.select("query_id", "doc_id", "doc_rank", "score", text.truncated(F.col("chunk_text"), 80).alias("snippet"))


COS = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


def _sql_knn(score: str, k: int = 10, where: str = "TRUE") -> str:
    return f"""
    WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS point_id, round({score}, 9) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 25 = 0 AND {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, point_id) AS rank FROM s)
    SELECT query_id, point_id, round(s, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= {k}"""


_BOTH = f"""
both_ AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({COS}, 9) AS score, 0 AS src FROM embeddings q, embeddings c WHERE q.vec_id % 25 = 0
          UNION ALL SELECT q.vec_id - 1, c.vec_id, round({COS}, 9), 1 FROM embeddings q, embeddings c WHERE q.vec_id % 25 = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY score DESC, chunk_id) AS rank FROM both_ QUALIFY rank <= 20)"""

_CAND = f"""
near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({COS}, 9) AS score FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings c),
near40 AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40),
cand AS (SELECT n.*, d.text, list_transform(list_filter(regexp_extract_all(d.text, '[A-Za-z0-9]+'), lambda x: len(x) >= 2), lambda x: lower(x)) AS toks,
  CASE WHEN chunk_id % 4 = 0 THEN 1.35 WHEN chunk_id % 4 = 1 THEN 0.85 WHEN chunk_id % 4 = 2 THEN 1.2 ELSE 1.0 END::DOUBLE AS weight
  FROM near40 n JOIN documents d ON d.doc_id = n.chunk_id),
stats AS (SELECT query_id, count(*) AS n, avg(len(toks)) AS avgdl FROM cand GROUP BY query_id),
terms AS (SELECT item_id AS query_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: len(x) >= 2), lambda x: lower(x)))) AS term FROM benchmark),
tok AS (SELECT query_id, chunk_id, len(toks) AS dl, unnest(toks) AS term FROM cand),
tf AS (SELECT query_id, chunk_id, any_value(dl) AS dl, term, count(*) AS tf FROM tok SEMI JOIN terms USING (query_id, term) GROUP BY query_id, chunk_id, term),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY query_id, term),
bm AS (SELECT query_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) ORDER BY term) AS bm25
  FROM tf JOIN df USING (query_id, term) JOIN stats USING (query_id) GROUP BY query_id, chunk_id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id)::INTEGER AS lexical_rank FROM bm),
dense AS (SELECT query_id, chunk_id, weight, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS dense_rank FROM cand)"""


def _sql_windows(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""d AS (SELECT doc_id, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents),
      w AS (SELECT doc_id, source, text, i::INTEGER AS chunk_index, (i * {step})::INTEGER AS start, least(i * {step} + {size}, length(text))::INTEGER AS stop, substr(text, i * {step} + 1, {size}) AS piece
      FROM d, LATERAL (SELECT unnest(generate_series(0, greatest(ceil((length(text) - {size}) / {step}.0), 0)::BIGINT)) AS i) WHERE length(text) > 0)"""


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'))"

SEARCH = {
    "knn_cosine_topk": (_knn("cosine"), _sql_knn(COS)),
    "knn_dot_topk": (_knn("dot"), _sql_knn("list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])")),
    "knn_euclid_topk": (_knn("euclid"), _sql_knn("(0 - list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]))")),
    "knn_filtered_topk": (knn_filtered_topk, _sql_knn(COS, where="c.label = 3")),
    "knn_year_range_topk": (knn_year_range_topk, _sql_knn("list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", 5, "c.label BETWEEN 2 AND 5")),
    "hyde_union_dedupe": (hyde_union_dedupe, f"""
      WITH {_BOTH}
      SELECT query_id, chunk_id, round(score, 6) AS score, CASE WHEN count(*) OVER (PARTITION BY query_id, chunk_id) > 1 THEN 'both' WHEN src = 0 THEN 'question' ELSE 'hyde' END AS origin
      FROM top QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY top.score DESC, src) = 1"""),
    "rrf_fusion": (rrf_fusion, f"""
      WITH {_BOTH}
      SELECT query_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + max(CASE WHEN src = 0 THEN rank END)), 0) + coalesce(0.6::DOUBLE / (60 + max(CASE WHEN src = 1 THEN rank END)), 0), 9) AS fused
      FROM top GROUP BY query_id, chunk_id"""),
    "bm25_rank": (bm25_rank, f"WITH {_CAND} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, lexical_rank AS rank FROM lex"),
    "hybrid_search_docs": (hybrid_search_docs, f"""
      WITH {_CAND},
      f AS (SELECT *, 1.0::DOUBLE / (60 + dense_rank) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS fused FROM dense LEFT JOIN lex USING (query_id, chunk_id))
      SELECT query_id, chunk_id, dense_rank, lexical_rank, round(fused, 9) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(f.fused, 9) DESC, chunk_id)::INTEGER AS rank FROM f QUALIFY rank <= 10"""),
    "section_boost_rerank": (section_boost_rerank, f"""
      WITH {_CAND},
      f AS (SELECT query_id, chunk_id, (1.0::DOUBLE / (60 + dense_rank) + coalesce(0.1::DOUBLE / (60 + lexical_rank), 0)) * weight AS b FROM dense LEFT JOIN lex USING (query_id, chunk_id))
      SELECT query_id, chunk_id, round(b, 9) AS boosted, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9) DESC, chunk_id)::INTEGER AS rank FROM f QUALIFY rank <= 10"""),
    "search_flagship": (search_flagship, f"""
      WITH {_CAND},
      f AS (SELECT query_id, chunk_id, text, round((1.0::DOUBLE / (60 + dense_rank) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0)) * weight, 9) AS score FROM dense LEFT JOIN lex USING (query_id, chunk_id)),
      t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM f)
      SELECT query_id, chunk_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS doc_rank, score,
        CASE WHEN length(s) <= 80 THEN s ELSE regexp_replace(substr(s, 1, 77), '\\s+$', '') || '...' END AS snippet FROM t QUALIFY doc_rank <= 10"""),
    "fixed_window_chunks": (fixed_window_chunks, f"WITH {_sql_windows(1200, 150)} SELECT doc_id, chunk_index, start, stop, md5(piece) AS digest FROM w"),
    "section_chunks": (section_chunks, None),
    "best_chunk_per_doc": (best_chunk_per_doc, f"""
      WITH {_sql_windows(1200, 150)},
      h AS (SELECT doc_id % 7 AS query_id, doc_id, doc_id * 1000 + chunk_index AS point_id, length(regexp_replace(piece, '[^e]', '', 'g')) / length(piece)::DOUBLE AS score FROM w),
      b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, point_id) = 1)
      SELECT query_id, doc_id::VARCHAR AS doc_id, point_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY b.score DESC, point_id)::INTEGER AS doc_rank FROM b QUALIFY doc_rank <= 20"""),
    "assemble_overlap": (assemble_overlap, f"""
      WITH {_sql_windows(500, 100)}
      SELECT doc_id, md5(any_value(text)) AS digest, any_value(length(text))::INTEGER AS n_chars, count(*)::INTEGER AS n_chunks, 's' AS sections FROM w GROUP BY doc_id"""),
    "assemble_document": (assemble_document, """
      WITH f AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role), s AS (SELECT conv_id, string_agg(role, '|' ORDER BY first_turn) AS sections FROM f GROUP BY conv_id)
      SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, any_value(sections) AS sections, count(*) AS n_chunks FROM conversations JOIN s USING (conv_id) GROUP BY conv_id"""),
    "context_pack": (context_pack, """
      WITH RECURSIVE t AS (SELECT conv_id, conv_id || ':' || turn AS id, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
      h AS (SELECT *, chr(10) || 'CHUNK ' || id || ' | SECTION: ' || role || chr(10) AS head FROM t),
      p AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, '' AS ids, '' AS ctx, 0::BIGINT AS used, 0 AS k FROM t
        UNION ALL
        SELECT p.conv_id, h.n,
          CASE WHEN ok THEN ids || CASE WHEN ids = '' THEN '' ELSE '|' END || id ELSE ids END,
          CASE WHEN ok THEN ctx || head || body || chr(10) || 'ENDCHUNK' || chr(10) ELSE ctx END,
          CASE WHEN ok THEN used + length(head) + length(body) + 10 ELSE used END, CASE WHEN ok THEN k + 1 ELSE k END
        FROM p JOIN h ON h.conv_id = p.conv_id AND h.n = p.n + 1,
        LATERAL (SELECT 600 - used - length(head) - 10 AS room),
        LATERAL (SELECT CASE WHEN room <= 0 THEN '' WHEN length(h.text) <= room THEN h.text WHEN room <= 3 THEN substr(h.text, 1, room) ELSE regexp_replace(substr(h.text, 1, room - 3), '\\s+$', '') || '...' END AS body),
        LATERAL (SELECT room > 0 AND length(body) > 0 AND k < 6 AS ok))
      SELECT conv_id AS query_id, ids AS chunk_ids, md5(regexp_replace(ctx, '^\\s+|\\s+$', '', 'g')) AS digest, used::INTEGER AS n_chars FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1"""),
    "cap_contexts": (cap_contexts, """
      WITH RECURSIVE t AS (SELECT conv_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations QUALIFY n <= 4),
      c AS (SELECT conv_id, n, CASE WHEN length(s) > 120 THEN regexp_replace(substr(s, 1, 120), '\\s+$', '') ELSE s END AS c FROM t),
      p AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, []::VARCHAR[] AS out, 0::BIGINT AS total FROM t
        UNION ALL SELECT p.conv_id, c.n, CASE WHEN piece IS NULL THEN out ELSE list_append(out, piece) END, total + coalesce(length(piece), 0)
        FROM p JOIN c ON c.conv_id = p.conv_id AND c.n = p.n + 1,
        LATERAL (SELECT CASE WHEN total + length(c.c) <= 300 THEN c.c WHEN 300 - total <= 0 THEN NULL ELSE regexp_replace(substr(c.c, 1, 300 - total), '\\s+$', '') END AS piece))
      SELECT conv_id, len(out)::INTEGER AS n, total::INTEGER AS n_chars, md5(array_to_string(out, '|')) AS digest FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1"""),
    "doc_ids_uuid5": (doc_ids_uuid5, """
      WITH s AS (SELECT doc_id, sha256('10.1000/é.' || doc_id) AS sha FROM documents),
      h AS (SELECT *, sha1(unhex('b2c2df407a1b4f9a9e1c0e7c8a7f6c1a') || (sha || ':3')::BLOB) AS h FROM s)
      SELECT doc_id, sha, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(h, 17, 2))::INTEGER & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS uuid FROM h"""),
    "canonical_url_ids": (canonical_url_ids, """
      WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)) AS path FROM pages)
      SELECT page_id, regexp_replace('10.1234/ab.' || path, '[).,;\\]}>"'']+$', '') AS canonical, CASE WHEN regexp_matches(url, '10\\.[0-9]{4,9}/') THEN url ELSE '' END AS "none", '10.1/' || path AS b, '10.1/a' || path AS c,
        trim(regexp_replace('10 1 a' || path, '[^a-z0-9]+', ' ', 'g')) AS d FROM p"""),
    "norm_text": (norm_text, f"""
      SELECT doc_id, md5({_PLAIN.removeprefix('trim(').removesuffix(')')}) AS plain, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS spaced,
        CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) <= 40 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 40), '\\s+$', '') END AS capped FROM documents"""),
    "tokenize_stats": (tokenize_stats, """
      WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: len(x) >= 2), lambda x: lower(x)) AS t FROM documents)
      SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct FROM t"""),
    "section_keys": (section_keys, """
      WITH t AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' & ' || CASE WHEN p_partkey % 3 = 0 THEN 'Results' ELSE 'Materials and Methods' END AS t FROM part)
      SELECT p_partkey, replace(trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' ', '_') AS key,
        CASE p_partkey % 3 WHEN 0 THEN 1.35::DOUBLE WHEN 1 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        CASE WHEN length(trim(t)) > 12 THEN rtrim(substr(trim(t), 1, 9)) || '...' ELSE trim(t) END AS short FROM t"""),
    "index_exists": (index_exists, "SELECT doc_id, (doc_id IN (SELECT vec_id FROM embeddings))::INTEGER AS found FROM documents"),
    "fetch_by_doc_ids": (fetch_by_doc_ids, f"WITH {_sql_windows(1200, 150)} SELECT doc_id, chunk_index FROM w WHERE source <> 'src3' AND doc_id IN (SELECT vec_id FROM embeddings WHERE label = 1)"),
    "page_records": (page_records, """
      SELECT page_id, page_id::VARCHAR AS pmid, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&[a-z]+;', ' and ', 'g') || ' end', '\\s+', ' ', 'g')) AS title,
        (page_id % 150 + 1900)::INTEGER AS year, length(html) || ' ' || regexp_extract(html, 'lang="(..)"', 1) AS authors FROM pages"""),
}
