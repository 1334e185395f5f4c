"""Retrieval traces as VARIANT values, and the ranked artifacts that evaluation begins with.

A response of the service carries what it did under `debug`: lists of candidates by the step that found them. Here such traces are
written from tables of candidates, and read back into three artifacts: what the question found, what the hypothetical
answer found, and what went into the context.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Lists of a trace, and which of them each mode must have for each artifact.
KEYS = ("question_candidates", "hyde_candidates", "selected_candidates")
ARTIFACTS = {"direct": {"direct": "question_candidates"}, "hyde": {"hyde": "hyde_candidates"}, "final_context": {"direct": "selected_candidates", "hyde": "selected_candidates"}}
ROW = "query_id string, question string, retrieval_mode string, rank int, doc_id string, chunk_id string, doi string, pmid string, title string, score double, candidate_origin string, selected_for_context boolean, corpus_version string, run_id string"


def debug_candidate(selected: Column) -> Column:
    """A candidate as a trace shows it, from the columns chunk_id, doc_id, doi, title, score and origin. It has no PubMed id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.struct(
        text("chunk_id").alias("chunk_id"), text("doc_id").alias("doc_id"), text("doi").alias("doi"), F.lit("").alias("pmid"), F.col("title").cast("string").alias("title"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.col("origin").alias("origin"), selected.alias("selected_for_context"),
    )


def debug_traces(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, question, mode, raw: the responses' traces. queries: query_id, question, mode; candidates: query_id, mode, key (one of
    KEYS), place (rank in its list), and the columns of debug_candidate().

    A candidate is selected for the context if the list of selected ones of its query and mode has its chunk. Lists without
    candidates are empty; the lists of one query are as long as the pool is deep.
    """
    chosen = candidates.where("key = 'selected_candidates'").select("query_id", "mode", "chunk_id").distinct().withColumn("_s", F.lit(True))
    marked = candidates.join(chosen, ["query_id", "mode", "chunk_id"], "left").withColumn("c", debug_candidate(F.coalesce("_s", F.lit(False))))
    lists = marked.groupBy("query_id", "mode").agg(F.array_sort(F.collect_list(F.struct("key", "place", "c"))).alias("l"))
    of = lambda key: F.transform(F.filter("l", lambda x: x["key"] == key), lambda x: x["c"]).alias(key)
    ids = F.transform(F.filter("l", lambda x: x["key"] == "selected_candidates"), lambda x: x["c"]["chunk_id"]).alias("selected_chunk_ids")
    debug = lists.select("query_id", "mode", F.to_json(F.struct(F.struct(*(of(k) for k in KEYS), ids).alias("debug")), {"ignoreNullFields": "false"}).alias("json"))
    return queries.join(debug, ["query_id", "mode"], "left").select("query_id", "question", "mode", F.parse_json(F.coalesce("json", F.lit('{"debug": {}}'))).alias("raw"))


def debug_rows(responses: DataFrame, key: str) -> DataFrame:
    """query_id, question, mode, rank (from 1), c (VARIANT) of the objects in a list of the trace; other members of it don't count.

    A response whose trace has no such list, or a list without objects, raises: the service must be asked for traces.
    """
    listed = F.try_variant_get("raw", f"$.debug.{key}", "array<variant>")
    objects = F.filter(F.coalesce(listed, F.expr("cast(array() as array<variant>)")), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    lacking = F.raise_error(F.concat(F.lit(f"the trace has no {key} in mode "), F.col("mode"), F.lit(" for the question: "), F.coalesce("question", F.lit(""))))
    found = responses.select("query_id", "question", "mode", objects.alias("_l"))
    whole = F.when(F.size("_l") > 0, F.col("_l")).otherwise(lacking.cast("array<variant>"))
    return found.select("query_id", "question", "mode", F.posexplode(whole).alias("rank", "c")).withColumn("rank", F.col("rank") + 1)


def _text(path: str) -> Column:
    return F.coalesce(strip(F.variant_get("c", path, "string")), F.lit(""))


def _truth(path: str) -> Column:
    """As scripting languages have it: zero, an empty text and nothing are false."""
    kind = F.schema_of_variant(F.variant_get("c", path, "variant"))
    text = F.variant_get("c", path, "string")
    return F.coalesce(F.when(kind.isNull() | (kind == "VOID"), False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").otherwise(F.coalesce(F.try_variant_get("c", path, "double") != 0, F.lit(True))), F.lit(False))


def artifact_rows(rows: DataFrame, run_id: str) -> DataFrame:
    """Rows of a ranking file (ROW) from debug_rows(): texts trimmed, a missing score 0. A score that is no number raises."""
    number = F.variant_get("c", "$.score", "string")
    score = F.when(F.coalesce(number, F.lit("")) == "", F.lit(0.0)).when(number.isin("true", "false"), (number == "true").cast("double")).otherwise(number.cast("double"))
    named = [
        F.col("query_id").cast("string").alias("query_id"), "question", F.col("mode").alias("retrieval_mode"), "rank", *(_text(f"$.{c}").alias(c) for c in ("doc_id", "chunk_id", "doi", "pmid", "title")),
        score.alias("score"), _text("$.origin").alias("candidate_origin"), _truth("$.selected_for_context").alias("selected_for_context"), F.lit("").alias("corpus_version"), F.lit(run_id).alias("run_id"),
    ]
    return rows.select(*named)


def export_artifacts(responses: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """The artifacts direct, hyde and final_context from one table of responses (query_id, question, mode, raw): one row per mode of a query.

    Modes are direct and hyde; others give nothing. What a trace lacks raises when the artifact is read.
    """
    of = lambda mode: responses.where(F.col("mode") == mode)
    parts = {name: [debug_rows(of(mode), key) for mode, key in keys.items()] for name, keys in ARTIFACTS.items()}
    return {name: artifact_rows(reduce(DataFrame.unionByName, rows), run_id) for name, rows in parts.items()}


def write_artifacts(responses: DataFrame, run_id: str, folder: str) -> dict[str, str]:
    """Write the artifacts as sorted JSON lines under a folder; returns their paths. The responses should be stored, as each artifact reads them."""
    from ..sources.writers import write_rankings

    paths = {name: f"{folder.rstrip('/')}/retrieval_{name}.jsonl" for name in ARTIFACTS}
    for name, rows in export_artifacts(responses, run_id).items():
        write_rankings(rows, paths[name])
    return paths
