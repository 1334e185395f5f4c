"""Generated answers: JSON out of noisy text, normalised, and grounded on the chunks that were shown.

Parsing runs in Arrow batches (raw model text may hold NaN or repeated keys, which SQL's JSON functions reject);
everything after it is column expressions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NAME_SYNONYMS, strip, truncated
from ..functions.variants import words

#: How much of an answer is kept.
FACTORS, CITATIONS, BACKFILL, FEW, SUMMARY, RATIONALE = 8, 4, 2, 3, 900, 260
BACKFILLED = "Some risk factor citations were assigned from the overall cited evidence."
UNGROUNDED = "No citations were produced by the model, answer is not evidence grounded."
NO_SUMMARY = "No evidence grounded answer could be produced."

FACTOR = "struct<rank:int,normalized_name:string,aliases:array<string>,confidence:double,rationale:string,citations:array<string>>"
ANSWER = f"struct<code:string,summary:string,factors:array<{FACTOR}>,limitations:array<string>,citations:array<string>>"


def json_slice(c: Column) -> Column:
    """From the first brace to the last one, null without."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def looks_cut_off(c: Column) -> Column:
    text = strip(c)
    return text.startswith("{") & ~text.endswith("}")


def _text(x) -> str:
    return x.strip() if isinstance(x, str) else ""


def _texts(x) -> list[str]:
    items = x if isinstance(x, list) else [x]
    found = [_text(i.get("chunk_id")) if isinstance(i, dict) else _text(i) for i in items]
    return [t for t in found if t]


def _number(x, kind):
    try:
        return None if isinstance(x, bool) else kind(float(x))
    except (TypeError, ValueError, OverflowError):
        return None


def _name(x) -> str:
    raw = _text(x)
    return NAME_SYNONYMS.get(" ".join(raw.lower().split()), raw)


def read_answer(raw: str | None) -> dict:
    """The fields of one answer, or the code of what is wrong with it."""
    nothing = {"summary": None, "factors": None, "limitations": None, "citations": None}
    text = (raw or "").strip()
    if not text:
        return {"code": "llm_empty_output", **nothing}
    if text.startswith("{") and not text.endswith("}"):
        return {"code": "truncated_json", **nothing}
    try:
        data = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return {"code": "invalid_json", **nothing}
    answer = data.get("answer") if isinstance(data.get("answer"), dict) else {}
    listed = answer.get("risk_factors") if isinstance(answer.get("risk_factors"), list) else []
    factors = [
        {
            "rank": _number(f.get("rank"), int) or 0,
            "normalized_name": _name(_text(f.get("normalized_name")) or f.get("name")),
            "aliases": list(dict.fromkeys(n for n in map(_name, _texts(f.get("aliases"))) if n)),
            "confidence": _number(f.get("confidence"), float) or 0.0,
            "rationale": _text(f.get("rationale")),
            "citations": _texts(f.get("citations")),
        }
        for f in listed
        if isinstance(f, dict)
    ]
    return {"code": "", "summary": _text(answer.get("summary")), "factors": factors[:FACTORS], "limitations": _texts(answer.get("limitations")), "citations": list(dict.fromkeys(_texts(data.get("citations"))))}


def parse_answer(raw: Column) -> Column:
    """read_answer() of a column, as a struct."""

    @F.pandas_udf(ANSWER)
    def parse(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_answer(x) for x in batch], columns=["code", "summary", "factors", "limitations", "citations"])

    return parse(raw)


def ground(answers: DataFrame) -> DataFrame:
    """answers: request_id, raw, allowed (array of chunk ids) -> code, grounded, summary, factors, limitations, citations.

    Citations outside `allowed` go; factors left without get the first cited ones (else the first allowed ones), which is
    said among the limitations, as are few citations and none.
    """
    known = lambda ids: F.array_distinct(F.filter(ids, lambda x: F.array_contains(F.col("allowed"), x)))
    out = answers.withColumn("a", parse_answer(F.col("raw"))).select("*", "a.*")
    out = out.withColumn("cited", F.slice(known(F.concat("citations", F.flatten(F.transform("factors", lambda f: f["citations"])))), 1, CITATIONS))
    out = out.withColumn("spare", F.slice(F.when(F.size("cited") > 0, F.col("cited")).otherwise(F.array_sort("allowed")), 1, BACKFILL))
    mended = F.transform("factors", lambda f: F.struct(f["rank"].alias("rank"), f["normalized_name"].alias("normalized_name"), f["aliases"].alias("aliases"), f["confidence"].alias("confidence"), truncated(f["rationale"], RATIONALE).alias("rationale"), F.when(F.size(known(f["citations"])) > 0, known(f["citations"])).otherwise(F.col("spare")).alias("citations")))
    filled = F.exists("factors", lambda f: F.size(known(f["citations"])) == 0) & (F.size("spare") > 0)
    out = out.withColumn("filled", filled).withColumn("factors", mended)
    out = out.withColumn("final", F.when(F.col("filled"), F.slice(known(F.concat("citations", F.flatten(F.transform("factors", lambda f: f["citations"])))), 1, CITATIONS)).otherwise(F.col("cited")))
    few = F.concat(F.lit("Evidence base is limited, only "), F.size("final").cast("string"), F.lit(" unique citations were available for the synthesis."))
    notes = F.array_compact(F.array(F.when(F.col("filled"), F.lit(BACKFILLED)), F.when((F.size("final") > 0) & (F.size("final") < FEW), few), F.when(F.size("final") == 0, F.lit(UNGROUNDED))))
    ok = F.col("code") == ""
    return out.select("request_id", "code", (ok & (F.size("final") > 0)).alias("grounded"), F.when(ok, truncated(F.when(F.col("summary") == "", F.lit(NO_SUMMARY)).otherwise(F.col("summary")), SUMMARY)).alias("summary"), "factors", F.when(ok, F.array_distinct(F.concat("limitations", notes))).alias("limitations"), F.when(ok, F.col("final")).alias("citations"))


def expand_citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations with their chunks' fields, in order: request_id, position, and the columns of chunks."""
    return answers.select("request_id", F.posexplode("citations").alias("position", "chunk_id")).join(chunks, "chunk_id")


def answer_contexts(*lists: Column) -> Column:
    """Texts of several lists one after the other, trimmed, each once."""
    joined = F.flatten(F.array_compact(F.array(*lists)))
    return F.array_distinct(F.filter(F.transform(joined, strip), lambda x: x.isNotNull() & (x != "")))


def predicted_names(factors: Column) -> Column:
    """Names of factors and their aliases, each once."""
    return F.array_distinct(F.flatten(F.transform(factors, lambda f: F.concat(F.array(f["normalized_name"]), f["aliases"]))))


def flatten_json(df: DataFrame, key: str, text: str, numeric: bool = False) -> DataFrame:
    """key, path, value: the leaves of JSON texts by paths like a.b[0], in Arrow batches. With `numeric`, only numbers and truths (1 and 0)."""

    def leaves(x, path=""):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from leaves(v, f"{path}.{k}" if path else str(k))
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from leaves(v, f"{path}[{i}]")
        elif numeric:
            if isinstance(x, int | float):
                yield path, str(float(x))
        else:
            yield path, None if x is None else json.dumps(x) if isinstance(x, bool) else str(x)

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                try:
                    rows += [(k, p, v) for p, v in leaves(json.loads(t or "null")) if p]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, path string, value string")


def harvest_metric(leaves: DataFrame, key: str, pattern: str) -> DataFrame:
    """The first numeric leaf, by path, whose path matches: key, value."""
    number = F.col("value").try_cast("double")
    return leaves.where(F.col("path").rlike(pattern) & number.isNotNull()).groupBy(key).agg(F.min_by(number, "path").alias("value"))


#: What names of measures look like in a summary, the first that fits counts.
MEASURES = (r"(ndcg(?:@?\d+)?)", r"(precision(?:@?\d+)?)", r"(recall(?:@?\d+)?)", r"(map(?:@?\d+)?)", r"(mrr(?:@?\d+)?)", r"(f1)", r"(accuracy)")


def summary_metrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, metric, value of JSON summaries of unknown shape: numbers whose paths look like a measure, under the name as it is written there.

    Of several numbers of one name the first path counts, in order of its characters. Texts that are no JSON, and summaries
    without measures, give nothing.
    """
    found = flatten_json(df, key, text, numeric=True)
    names = F.coalesce(*(F.nullif(F.regexp_extract("path", f"(?i){p}", 1), F.lit("")) for p in MEASURES))
    named = found.withColumn("metric", names).where("metric IS NOT NULL")
    return named.groupBy(key, "metric").agg(F.min_by(F.col("value").cast("double"), "path").alias("value"))


def fallback_answer(reason: Column) -> Column:
    """The answer that stands where none could be grounded, with the reason as its limitation: struct(summary, factors, limitations, citations)."""
    none = F.expr("cast(array() as array<string>)")
    return F.struct(F.lit(NO_SUMMARY).alias("summary"), F.expr(f"cast(array() as array<{FACTOR}>)").alias("factors"), F.array(reason).alias("limitations"), none.alias("citations"))


def supporting_texts(raw: Column) -> Column:
    """Texts that a response (VARIANT) says it was made of, each once, in order: of its citations, then of its evidence, chunks and contexts."""
    listed = lambda path: F.coalesce(F.try_variant_get(raw, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    # the first of these keys that holds anything is the one that counts, whatever it holds
    one = lambda x, keys: F.coalesce(*(F.when(F.coalesce(F.variant_get(x, f"$.{k}", "string"), F.lit("")) != "", F.coalesce(words(x, f"$.{k}"), F.lit(""))) for k in keys))
    kind = F.schema_of_variant
    cited = F.transform(listed("$.citations"), lambda c: F.when(kind(c).startswith("OBJECT"), one(c, ("snippet", "text", "content"))))
    others = [F.transform(listed(f"$.{key}"), lambda c: F.when(kind(c) == "STRING", words(c, "$")).when(kind(c).startswith("OBJECT"), one(c, ("snippet", "content_text", "text", "content")))) for key in ("evidence", "chunks", "retrieved_contexts", "contexts")]
    return F.array_distinct(F.filter(F.concat(cited, *others), lambda t: t.isNotNull() & (t != "")))


#: Ways to answer, in the order in which they are asked.
MODES = ("rag_no_hyde", "rag_hyde", "llm_only")


def answer_records(queries: DataFrame, responses: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Records of answers over several modes: query_id, question, mode, answer_raw (VARIANT; null for llm_only), answer_text (llm_only), contexts, contexts_source.

    responses: query_id, mode, raw (VARIANT), text, error. A query whose answer fails in one mode keeps what the modes before it gave, and
    nothing after. Unknown modes raise; see generation_failures() for queries that fail.
    """
    if unknown := sorted(set(modes) - set(MODES)):
        raise ValueError(f"unknown modes: {', '.join(unknown)}")
    if not modes:
        raise ValueError("no modes")
    order = [m for m in MODES if m in modes]
    place = F.array_position(F.array(*map(F.lit, order)), F.col("mode"))
    asked = queries.select("query_id", "question", F.explode(F.array(*map(F.lit, order))).alias("mode"))
    rows = asked.join(responses, ["query_id", "mode"], "left").withColumn("_p", place)
    failed = F.when(F.col("error").isNotNull() | (F.col("raw").isNull() & F.col("text").isNull()), F.col("_p"))
    stops = rows.groupBy("query_id").agg(F.min(failed).alias("_stop"))
    kept = rows.join(stops, "query_id").where("_stop IS NULL OR _p < _stop")
    alone = F.col("mode") == "llm_only"
    none = F.expr("cast(array() as array<string>)")
    return kept.select("query_id", "question", "mode", F.when(~alone, F.col("raw")).alias("answer_raw"), F.when(alone, F.col("text")).alias("answer_text"), F.when(alone, none).otherwise(supporting_texts(F.col("raw"))).alias("contexts"), F.when(alone, "none").otherwise("ask").alias("contexts_source"))


def generation_failures(queries: DataFrame, responses: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """One row: queries and how many of them fail in a mode. If all do, and there are any, reading it raises."""
    bad = responses.where(F.col("mode").isin(*modes)).groupBy("query_id").agg(F.count_if(F.col("error").isNull() & (F.col("raw").isNotNull() | F.col("text").isNotNull())).alias("good"))
    counts = queries.select("query_id").join(bad, "query_id", "left").agg(F.count("*").alias("queries"), F.count_if(F.coalesce("good", F.lit(0)) < len(set(modes))).alias("failures"))
    all_bad = (F.col("queries") > 0) & (F.col("failures") == F.col("queries"))
    return counts.select("queries", F.when(all_bad, F.raise_error(F.lit("answers failed for all queries")).cast("long")).otherwise(F.col("failures")).alias("failures"))
