"""Lexical scores over the candidates of each query, fusion of ranks, and section weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import section_weight, tokens

#: Constants of BM25 and of reciprocal-rank fusion.
K1, B, RRF_K = 1.5, 0.75, 60
RRF_WEIGHTS = {"dense": 1.0, "hyde": 0.6, "lexical": 1.0}


def bm25(candidates: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk_text", query_col: str = "question") -> DataFrame:
    """query_id, id_col, bm25 (over 0 only) of candidates: query_id, id_col, text_col. Statistics are those of each query's candidates.

    Scores add up the query's terms in order, so they are the same however rows are dealt.
    """
    text = candidates.select("query_id", id_col, tokens(F.col(text_col)).alias("_t"))
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(query_col)))).alias("_term"))
    size = text.groupBy("query_id").agg(F.count("*").alias("_n"), F.avg(F.size("_t")).alias("_avg"))
    words = text.select("query_id", id_col, F.size("_t").alias("_dl"), F.explode("_t").alias("_term"))
    counted = words.join(terms, ["query_id", "_term"], "left_semi").groupBy("query_id", id_col, "_dl", "_term").agg(F.count("*").alias("_tf"))
    df = counted.groupBy("query_id", "_term").agg(F.count("*").alias("_df"))
    idf = F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1.0)
    weight = idf * (F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_dl") / F.greatest(F.col("_avg"), F.lit(1.0)))))
    scored = counted.join(df, ["query_id", "_term"]).join(size, "query_id").withColumn("_w", weight)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_term", "_w"))), lambda x: x["_w"])
    total = F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x)
    return scored.groupBy("query_id", id_col).agg(total.alias("bm25")).where("bm25 > 0")


def ranked(scores: DataFrame, score_col: str, rank_col: str, id_col: str = "chunk_id") -> DataFrame:
    """1-based ranks within each query; scores are compared to nine places, ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score_col, 9)), id_col)
    return scores.withColumn(rank_col, F.row_number().over(w))


def position_ranks(ids: DataFrame, id_col: str = "chunk_id", position_col: str = "position") -> DataFrame:
    """Ranks by place in a list: a blank id takes a place but gets no rank."""
    w = Window.partitionBy("query_id").orderBy(position_col)
    return ids.withColumn("rank", F.row_number().over(w)).where(F.trim(F.col(id_col)) != "")


def rrf(weights: dict[str, float] | None = None, k: int = RRF_K, **ranks: Column) -> Column:
    """Sum of weight / (k + rank); a list that lacks the candidate adds nothing."""
    use = RRF_WEIGHTS | (weights or {})
    return sum((F.coalesce(F.lit(float(use[name])) / (F.lit(float(k)) + rank), F.lit(0.0)) for name, rank in ranks.items()), F.lit(0.0))


def rerank(candidates: DataFrame, queries: DataFrame, weights: dict[str, float] | None = None, sections: dict[str, float] | None = None) -> DataFrame:
    """Order candidates (query_id, chunk_id, chunk_text, score, section; hyde_score where there is a second query) by fused rank
    times section weight: adds fused, boosted and rank (by boosted, then chunk_id)."""
    out = ranked(candidates, "score", "dense_rank").withColumn("dense_rank", F.when(F.col("score").isNotNull(), F.col("dense_rank")))
    lexical = ranked(bm25(candidates, queries), "bm25", "lexical_rank").select("query_id", "chunk_id", "bm25", "lexical_rank")
    out = out.join(lexical, ["query_id", "chunk_id"], "left")
    parts = {"dense": F.col("dense_rank"), "lexical": F.col("lexical_rank")}
    if "hyde_score" in candidates.columns:
        w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("hyde_score", 9)), "chunk_id")
        out = out.withColumn("hyde_rank", F.when(F.col("hyde_score").isNotNull(), F.row_number().over(w)))
        parts["hyde"] = F.col("hyde_rank")
    out = out.withColumn("fused", rrf(weights, **parts)).withColumn("boosted", F.col("fused") * section_weight(F.col("section"), sections))
    return ranked(out, "boosted", "rank")


def union_candidates(question: DataFrame, hyde: DataFrame) -> DataFrame:
    """Candidates of both queries, one row per query_id and chunk_id: the better score keeps its fields (ties: the question's);
    origin is question, hyde or both."""
    both = question.withColumn("_src", F.lit(0)).unionByName(hyde.withColumn("_src", F.lit(1)))
    w = Window.partitionBy("query_id", "chunk_id")
    origin = F.when(F.size(F.collect_set("_src").over(w)) > 1, "both").when(F.col("_src") == 0, "question").otherwise("hyde")
    first = F.row_number().over(w.orderBy(F.desc("score"), "_src"))
    return both.withColumn("origin", origin).withColumn("_r", first).where("_r = 1").drop("_r", "_src")
