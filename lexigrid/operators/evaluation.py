"""Pools, judgements, and measures of rankings and of extracted names, all over many queries and modes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import precision_recall_f1
from ..functions.text import first_nonblank, nonblank, strip

IDENTITY = ("doc_id", "pmid", "doi", "chunk_id")
POOL_FIELDS = ("question", "doc_id", "chunk_id", "doi", "pmid", "title", "corpus_version", "run_id")


def resolved_id(*columns: str) -> Column:
    """The first identifier that isn't blank; without one an error is raised where the row is read."""
    return F.coalesce(first_nonblank(*(F.col(c) for c in columns or IDENTITY)), F.raise_error(F.lit("a row has no identifier")).cast("string"))


def merge_pool(direct: DataFrame, hyde: DataFrame) -> DataFrame:
    """One row per query and resolved id; each field is the first that isn't blank, the direct list's rows (by rank) first."""
    rows = direct.withColumn("_o", F.struct(F.lit(0), "rank")).unionByName(hyde.withColumn("_o", F.struct(F.lit(1), "rank")), allowMissingColumns=True)
    fields = [c for c in POOL_FIELDS if c in rows.columns]
    rows = rows.withColumn("resolved_doc_id", resolved_id(*(c for c in IDENTITY if c in rows.columns)))
    first = [F.coalesce(F.expr(f"min_by(trim(`{c}`), _o) FILTER (WHERE trim(`{c}`) <> '')"), F.lit("")).alias(c) for c in fields]
    return rows.groupBy("query_id", "resolved_doc_id").agg(*first)


def annotation_template(pool: DataFrame) -> DataFrame:
    return pool.select("*", *(F.lit("").alias(c) for c in ("relevance", "rationale", "annotator", "adjudication_status")))


def annotation_errors(annotations: DataFrame, pool: DataFrame) -> DataFrame:
    """All violations, as row (from 2, null for missing ones), query_id, resolved_doc_id, error. annotations: with row, its place in the file."""
    key = ["query_id", "resolved_doc_id"]
    a = annotations.select("row", *(strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in (*key, "relevance", "rationale", "adjudication_status")))
    flag = lambda df, error: df.select("row", *key, F.lit(error).alias("error"))
    again = F.row_number().over(Window.partitionBy(*key).orderBy("row"))
    known = pool.select(*key).distinct()
    found = [
        flag(a.where("query_id = '' OR resolved_doc_id = ''"), "empty key"),
        flag(a.withColumn("_n", again).where("_n > 1"), "duplicate"),
        flag(a.join(known, key, "left_anti"), "not in the pool"),
        flag(known.join(a, key, "left_anti").withColumn("row", F.lit(None).cast("int")), "missing"),
        flag(a.where("relevance NOT IN ('0', '1', '2')"), "relevance must be 0, 1 or 2"),
        flag(a.where("relevance IN ('1', '2') AND rationale = ''"), "a rationale is required"),
        flag(a.where("adjudication_status NOT IN ('', 'pending', 'accepted', 'review_needed')"), "unknown status"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def to_qrels(annotations: DataFrame) -> DataFrame:
    return annotations.select(strip(F.col("query_id")).alias("query_id"), strip(F.col("resolved_doc_id")).alias("doc_id"), strip(F.col("relevance")).cast("int").alias("relevance"))


def qrels_errors(qrels: DataFrame) -> DataFrame:
    bad = qrels.where("relevance IS NULL OR relevance NOT IN (0, 1, 2)").select("query_id", "doc_id", F.lit("relevance must be 0, 1 or 2").alias("error"))
    twice = qrels.groupBy("query_id", "doc_id").count().where("count > 1").select("query_id", "doc_id", F.lit("duplicate").alias("error"))
    return bad.unionByName(twice)


def relevance_histogram(qrels: DataFrame) -> DataFrame:
    grades = qrels.sparkSession.range(3).select(F.col("id").cast("int").alias("relevance"))
    return grades.join(qrels.groupBy("relevance").count(), "relevance", "left").select("relevance", F.coalesce("count", F.lit(0)).alias("n"))


def deduped_positions(ranking: DataFrame) -> DataFrame:
    """mode, query_id, doc_id, position: each document once, where it ranks first; a missing rank is the line's number."""
    order = [F.coalesce("rank", "line"), F.col("line")]
    first = F.row_number().over(Window.partitionBy("mode", "query_id", "doc_id").orderBy(*order))
    rows = ranking.withColumn("_r", first).where("_r = 1")
    return rows.select("mode", "query_id", "doc_id", F.row_number().over(Window.partitionBy("mode", "query_id").orderBy(*order)).alias("position"))


def valid_ks(ks: Sequence[int]) -> list[int]:
    out = sorted(set(ks))
    if not out or out[0] <= 0:
        raise ValueError("every k must be positive")
    return out


def query_metrics(ranking: DataFrame, qrels: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """One row per mode and judged query: depth, first_relevant, mrr, p@k, recall@k and ndcg@k (null where nothing is relevant).

    ranking: mode, query_id, doc_id, rank, line. Documents without a judgement count as grade 0. P@k divides by k.
    """
    ks = valid_ks(ks)
    positions = deduped_positions(ranking)
    modes = ranking.select("mode").distinct()
    ideal_place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    gain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("position") + 1)
    graded = qrels.withColumn("position", ideal_place)
    totals = graded.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("relevant"), *(F.sum(F.when(F.col("position") <= k, gain).otherwise(0.0)).alias(f"idcg_{k}") for k in ks))
    judged = positions.join(qrels, ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    hits = judged.groupBy("mode", "query_id").agg(
        F.count("*").alias("depth"),
        F.min(F.when(F.col("relevance") > 0, F.col("position"))).alias("first_relevant"),
        *(F.count_if((F.col("position") <= k) & (F.col("relevance") > 0)).alias(f"hits_{k}") for k in ks),
        *(F.sum(F.when(F.col("position") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}") for k in ks),
    )
    out = totals.join(modes).join(hits, ["mode", "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    cols = [F.coalesce(1.0 / F.col("first_relevant"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        cols += [(zero(f"hits_{k}") / k).alias(f"p@{k}"), F.when(F.col("relevant") > 0, zero(f"hits_{k}") / F.col("relevant")).alias(f"recall@{k}"), F.when(F.col(f"idcg_{k}") > 0, F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"idcg_{k}")).alias(f"ndcg@{k}")]
    return out.select("mode", "query_id", zero("depth").alias("depth"), "first_relevant", *cols)


def metric_rows(per_query: DataFrame) -> DataFrame:
    """Measures as rows: mode, query_id, metric, value."""
    names = [c for c in per_query.columns if "@" in c or c == "mrr"]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in names))
    return per_query.select("mode", "query_id", F.inline(pairs))


def metrics_by_mode(per_query: DataFrame) -> DataFrame:
    """mode, metric, mean over queries that have it, queries and excluded ones."""
    return metric_rows(per_query).groupBy("mode", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("queries"), F.count_if(F.col("value").isNull()).alias("excluded"))


def depth_by_mode(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("mode").agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"))


def too_shallow(ranking: DataFrame, k: int) -> DataFrame:
    return deduped_positions(ranking).groupBy("mode", "query_id").agg(F.countDistinct("doc_id").alias("depth")).where(F.col("depth") < k)


def missing_queries(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged queries that a mode lacks, and retrieved ones without judgements."""
    have, judged = ranking.select("mode", "query_id").distinct(), qrels.select("query_id").distinct()
    lacking = ranking.select("mode").distinct().join(judged).join(have, ["mode", "query_id"], "left_anti").select("mode", "query_id", F.lit("not retrieved").alias("problem"))
    return lacking.unionByName(have.join(judged, "query_id", "left_anti").select("mode", "query_id", F.lit("not judged").alias("problem")))


def graded_metrics(pool: DataFrame, qrels: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """P@k, R@k and MRR per query of a pool (query_id, doc_id, rank), where the number of relevant documents is the sum of grades
    and recall is 0 without any and never over 1."""
    total = qrels.groupBy("query_id").agg(F.sum("relevance").alias("total"))
    binary = pool.join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", (F.coalesce("relevance", F.lit(0)) > 0).cast("int"))
    placed = binary.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))
    out = placed.groupBy("query_id").agg(F.min(F.when(F.col("rel") > 0, F.col("pos"))).alias("_f"), *(F.sum(F.when(F.col("pos") <= k, F.col("rel")).otherwise(0)).alias(f"_h{k}") for k in valid_ks(ks)))
    out = out.join(total, "query_id", "left")
    recall = lambda k: F.when(F.coalesce("total", F.lit(0)) > 0, F.least(F.col(f"_h{k}") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    return out.select("query_id", F.coalesce(1.0 / F.col("_f"), F.lit(0.0)).alias("mrr"), *(c for k in valid_ks(ks) for c in ((F.col(f"_h{k}") / k).alias(f"p@{k}"), recall(k).alias(f"recall@{k}"))))


def weak_relevance(related: Column, label: Column | None = None, wanted: Sequence[str] = (), missing_counts: bool = False) -> Column:
    """Relevance by a yes, and, if labels are wanted, by one of them."""
    yes = F.coalesce(F.lower(strip(related.cast("string"))) == "yes", F.lit(False))
    if label is None or not wanted:
        return yes.cast("int")
    return (yes & F.coalesce(label.isin(*wanted), F.lit(missing_counts))).cast("int")


def weak_metrics(pool: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """Per query: rows, labelled rows and their share, P@k, recall within the pool, and MRR, from 0/1 labels. pool: query_id, rank, doc_key."""
    joined = pool.join(labels, "doc_key", "left").withColumn("rel", F.coalesce("label", F.lit(0)))
    placed = joined.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_key")))
    out = placed.groupBy("query_id").agg(
        F.count("*").alias("n_pool"), F.count("label").alias("n_labelled"), F.sum("rel").alias("_r"),
        F.sum(F.when(F.col("pos") <= k, F.col("rel")).otherwise(0)).alias("_h"), F.min(F.when(F.col("rel") > 0, F.col("pos"))).alias("_f"),
    )
    return out.select("query_id", "n_pool", "n_labelled", (F.col("n_labelled") / F.col("n_pool")).alias("coverage"), (F.col("_h") / k).alias("precision"), F.when(F.col("_r") > 0, F.col("_h") / F.col("_r")).otherwise(0.0).alias("pool_recall"), F.coalesce(1.0 / F.col("_f"), F.lit(0.0)).alias("mrr"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of two sets of keys and of what they share; rates are 0 for empty sets."""
    a, b = (df.select(key).where(nonblank(F.col(key).cast("string")).isNotNull()).distinct().withColumn(n, F.lit(1)) for df, n in ((left, "_a"), (right, "_b")))
    counts = a.join(b, key, "full_outer").agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"))
    rate = lambda c: F.when(F.col(c) > 0, F.col("n_both") / F.col(c)).otherwise(0.0)
    return counts.select("*", rate("n_left").alias("left_share"), rate("n_right").alias("right_share"))


def extraction_rows(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per key: true and false positives, false negatives, precision, recall, f1 and the names matched, of arrays `predicted` and `gold`."""
    both = predicted.join(gold, "key", "full_outer").select("key", *(F.array_distinct(F.coalesce(F.col(c), F.expr("cast(array() as array<string>)"))).alias(c) for c in ("predicted", "gold")))
    hit = F.array_intersect("predicted", "gold")
    out = both.select("key", F.size(hit).alias("tp"), F.size(F.array_except("predicted", "gold")).alias("fp"), F.size(F.array_except("gold", "predicted")).alias("fn"), F.array_join(F.array_sort(hit), "|").alias("matched"))
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("*", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def extraction_summary(rows: DataFrame) -> DataFrame:
    """Micro measures (of the sums) and macro ones (means of the rows)."""
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), F.count("*").alias("n"))
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("n", "tp", "fp", "fn", p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1")


#: Aliases that become part of the plan; more of them meet the texts in a join.
ALIASES = 1000


def alias_hits(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, names: canonical names whose aliases stand in the text as whole words; keys without any go. texts: key (unique), text
    (plain_spaced); aliases: canonical, alias.

    With up to ALIASES aliases every text is searched where it is read, and nothing is shuffled. With more, runs of as many words
    as aliases have are joined with them; the same names are found either way.
    """
    table = aliases.select("canonical", "alias").where("alias <> '' AND canonical IS NOT NULL").distinct()
    known = table.limit(ALIASES + 1).collect()
    if len(known) > ALIASES:
        return _joined_hits(texts, table)
    if not known:
        return texts.select("key", F.expr("cast(array() as array<string>)").alias("names")).limit(0)
    listed = F.array(*(F.struct(F.lit(r["canonical"]).alias("name"), F.lit(f" {r['alias']} ").alias("alias")) for r in sorted(known)))
    # the text is bound once, however many aliases are looked for; a generator is not worked out again by a filter
    names = lambda p: F.array_sort(F.array_distinct(F.transform(F.filter(listed, lambda a: F.contains(p, a["alias"])), lambda a: a["name"])))
    found = F.transform(F.array(F.concat(F.lit(" "), F.col("text"), F.lit(" "))), lambda p: F.struct(names(p).alias("names")))
    return texts.select("key", F.inline(F.filter(found, lambda r: F.size(r["names"]) > 0)))


def _joined_hits(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias_hits() for any number of aliases: the distinct runs of words of each length that aliases have, joined with them."""
    sized = aliases.withColumn("_n", F.size(F.split("alias", " ")))
    lengths = sorted(r["_n"] for r in sized.select("_n").distinct().collect())  # words of the longest alias at most
    words = texts.select("key", F.split("text", " ").alias("_w"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice(F.col("_w"), i, F.lit(n)), " "))
    each = F.flatten(F.array(*(F.when(F.size("_w") >= n, F.array_distinct(runs(n))).otherwise(F.expr("cast(array() as array<string>)")) for n in lengths)))
    hits = words.select("key", F.explode(each).alias("alias")).join(sized.select("alias", "canonical"), "alias")
    return hits.groupBy("key").agg(F.array_sort(F.collect_set("canonical")).alias("names"))


def canonical_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, canonical: by its alias, or else as it is."""
    return names.join(aliases.groupBy(F.col("alias").alias("name")).agg(F.min("canonical").alias("_c")), "name", "left").withColumn("canonical", F.coalesce("_c", "name")).drop("_c")


def mean_std(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation (0 for a single value)."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def numeric_means(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    names = [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in keys]
    return df.groupBy(*keys).agg(*(F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in names))


def audit_sample(ids: DataFrame, n: int, seed: int = 0, id_col: str = "query_id") -> DataFrame:
    """n rows, the same ones for a seed whatever the partitioning (by a hash, not by a shuffled list)."""
    return ids.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)
