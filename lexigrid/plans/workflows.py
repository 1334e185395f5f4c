"""Composites: search and ask in batch, the evaluation before and after judging, and tables over many runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ports
from ..functions.text import run_mode, squeeze
from ..operators import answers, assembly, evaluation, ranking, retrieval


def search(queries: DataFrame, chunks: DataFrame, top_k: int = 20, where: Column | None = None, embedder: Callable = ports.hashing_embedder) -> DataFrame:
    """queries: query_id, question; chunks: chunk_id, doc_id, vector, chunk_text, section, chunk_index, start, end, title ...

    Near chunks (more than asked for, so documents are left after grouping) are reranked, the best chunk stands for its
    document, and the whole documents of the best are put together. One row per query and document.
    """
    asked = queries.withColumn("vector", ports.embed(squeeze(F.col("question")), embedder))
    fetched = min(retrieval.MOST_CHUNKS, retrieval.OVERFETCH * top_k)
    near = retrieval.knn(asked, chunks.withColumnRenamed("chunk_id", "point_id"), fetched, where=where).drop("rank").withColumnRenamed("point_id", "chunk_id")
    hits = ranking.rerank(near.join(chunks.drop("vector"), "chunk_id"), queries)
    best = retrieval.top_documents(retrieval.best_per_document(hits.withColumn("point_id", F.col("chunk_id")).withColumn("score", F.col("boosted"))), top_k)
    texts = assembly.assemble(retrieval.fetch_by_documents(chunks, best.select("doc_id")), ["doc_id"])
    return best.select("query_id", "doc_id", "doc_rank", "score").join(texts, "doc_id")


def ask_contexts(queries: DataFrame, chunks: DataFrame, second: DataFrame | None = None, candidates: int = 30, final: int = 6, max_chars: int = 60_000, embedder: Callable = ports.hashing_embedder) -> DataFrame:
    """The retrieval half of an answer: candidates of the question (and of a second text per question: query_id, text), fused,
    reranked, and packed under the budget. query_id, chunk_ids, context, n_chars."""

    def near(rows: DataFrame) -> DataFrame:
        found = retrieval.knn(rows, chunks.withColumnRenamed("chunk_id", "point_id"), candidates).drop("rank").withColumnRenamed("point_id", "chunk_id")
        return found.join(chunks.drop("vector"), "chunk_id").where(F.trim("chunk_text") != "")

    first = near(queries.withColumn("vector", ports.embed(F.col("question"), embedder)))
    pool = first
    if second is not None:
        other = near(second.withColumn("vector", ports.embed(F.col("text"), embedder)))
        scores = other.select("query_id", "chunk_id", F.col("score").alias("hyde_score"))
        pool = ranking.union_candidates(first, other).join(scores, ["query_id", "chunk_id"], "left")
    return assembly.pack_context(ranking.rerank(pool, queries), max_chars, final)


def answer(contexts: DataFrame, questions: DataFrame, model: Callable, chunks: DataFrame) -> DataFrame:
    """Ask the model with each context, and ground what it says: see operators.answers.ground; citations follow as a list of chunks."""
    prompt = F.concat(F.lit("QUESTION: "), "question", F.lit("\nALLOWED: "), F.array_join(F.array_sort("chunk_ids"), ","), F.lit("\n"), "context")
    raw = ports.generate(contexts.join(questions, "query_id").withColumn("prompt", prompt), model)
    return answers.ground(raw.select(F.col("query_id").alias("request_id"), "raw", F.col("chunk_ids").alias("allowed")))


def prepare_judging(direct: DataFrame, hyde: DataFrame, k: int) -> DataFrame:
    """The template to judge: the merged pool of both rankings, if every query is deep enough in each."""
    both = direct.withColumn("mode", F.lit("direct")).unionByName(hyde.withColumn("mode", F.lit("hyde")))
    placed = both.withColumn("doc_id", evaluation.resolved_id(*(c for c in evaluation.IDENTITY if c in both.columns))).withColumn("line", F.row_number().over(Window.partitionBy("mode", "query_id").orderBy("rank")))
    if not (shallow := evaluation.too_shallow(placed.select("mode", "query_id", "doc_id", "rank", "line"), k)).isEmpty():
        first = shallow.first()
        raise ValueError(f"query {first['query_id']} has {first['depth']} documents in mode {first['mode']}, not {k}")
    return evaluation.annotation_template(evaluation.merge_pool(direct, hyde))


def finish_judging(annotations: DataFrame, pool: DataFrame, ranking_rows: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Measures per query and mode from what was judged, if nothing is wrong with it; all that is wrong is in the error."""
    problems = evaluation.annotation_errors(annotations, pool).orderBy("row").limit(50).collect()
    if problems:
        raise ValueError("; ".join(f"row {p['row']}: {p['error']}" for p in problems))
    qrels = evaluation.to_qrels(annotations)
    if not (missing := evaluation.missing_queries(ranking_rows, qrels)).isEmpty():
        first = missing.first()
        raise ValueError(f"query {first['query_id']}: {first['problem']} in mode {first['mode']}")
    return evaluation.query_metrics(ranking_rows, qrels, ks)


def seed_table(per_seed: DataFrame) -> DataFrame:
    """mode, metric, mean, std, n over seeds. per_seed: mode, seed, metric, value."""
    return evaluation.mean_std(per_seed, ["mode", "metric"], "value")


def means_by_configuration(rows: DataFrame, file_col: str = "file") -> DataFrame:
    """Mean of every numeric column by the configuration in the file's name; runs under a folder of primary results stand for all if there are any."""
    primary = rows.where(F.col(file_col).contains("primary_deterministic"))
    chosen = rows if primary.isEmpty() else primary
    named = chosen.withColumn("configuration", run_mode(F.element_at(F.split(file_col, "/"), -1)))
    return evaluation.numeric_means(named.drop(file_col), ["configuration"])


#: Configurations in the order of tables, as tables name them.
CONFIGURATIONS = {"llm_only": "LLM only", "rag_no_hyde": "RAG no HyDE", "rag_hyde": "RAG HyDE"}


def configuration_means(rows: DataFrame, primary_only: bool = False) -> DataFrame:
    """metric, configuration (null: over all of them), mean, files. rows: file, configuration, metric, value.

    First the mean of each file, then the mean of the files, so a long file counts no more than a short one. With primary_only, files of a primary
    deterministic run stand for all if there are any. Null and NaN values don't count; a measure without any has a null mean.
    """
    if primary_only:
        primary = rows.where(F.col("file").contains("primary_deterministic"))
        rows = rows if primary.isEmpty() else primary
    value = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    files = rows.groupBy("metric", "configuration", "file").agg(F.avg(value).alias("value"))
    sets = files.groupingSets([[F.col("metric"), F.col("configuration")], [F.col("metric")]], F.col("metric"), F.col("configuration"))
    # a configuration without a name is none, so null stands for all alone
    out = sets.agg(F.avg("value").alias("mean"), F.count("value").alias("files"), F.grouping("configuration").alias("_all"))
    return out.where("_all = 1 OR configuration IS NOT NULL").drop("_all")


def configuration_table(means: DataFrame, order: dict[str, str] = CONFIGURATIONS, overall: str = "All") -> DataFrame:
    """A table of means: a row for each measure, a column for each configuration in the order given, under its label, then `overall`. Configurations without any value are dropped."""
    named = means.withColumn("column", F.coalesce("configuration", F.lit("*")))
    wide = named.groupBy("metric").pivot("column", [*order, "*"]).agg(F.first("mean"))
    counts = wide.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in order)).first()
    return wide.select("metric", *(F.col(f"`{c}`").alias(label) for c, label in order.items() if counts[c]), F.col("`*`").alias(overall))
