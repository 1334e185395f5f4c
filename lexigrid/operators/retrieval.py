"""Filtered nearest neighbours for many queries at once, and the steps from chunks to documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_doi, first_nonblank, nonblank

#: Chunks fetched for each document asked for, and the most.
OVERFETCH, MOST_CHUNKS = 8, 400
#: Queries that a task holds beside its chunks; more of them are dealt into groups, each with a scan of the chunks.
QUERY_GROUP = 2048
#: Scores, or differences of vectors' numbers, that a task holds at once.
DIFFERENCES = 1 << 20
FILTER_KEYS = ("doi", "disease", "source_type", "year", "year_min", "year_max")


def compile_filters(filters: dict | None, columns: dict[str, str] | None = None) -> Column:
    """Conjunction of the filters; blank texts and values of a wrong type count as none.

    Unknown keys raise. A null year never lies in a range.
    """
    given = filters or {}
    if unknown := sorted(set(given) - set(FILTER_KEYS)):
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    at = lambda c: F.col((columns or {}).get(c, c))
    number = lambda k: given[k] if isinstance(given.get(k), int) and not isinstance(given.get(k), bool) else None
    terms = [at(k) == given[k].strip() for k in ("disease", "source_type") if isinstance(given.get(k), str) and given[k].strip()]
    if isinstance(given.get("doi"), str) and given["doi"].strip():
        terms.append(at("doi_normalized") == canonical_doi(F.lit(given["doi"])))
    if number("year") is not None:
        terms.append(at("year") == number("year"))
    if number("year_min") is not None:
        terms.append(at("year") >= number("year_min"))
    if number("year_max") is not None:
        terms.append(at("year") <= number("year_max"))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def _scores(q: np.ndarray, x: np.ndarray, distance: str) -> np.ndarray:
    """Scores of queries (rows) and vectors (columns), rounded to nine places; NaN where there is none. They are worked out in place."""
    if distance == "euclid":
        s = q[:, None, :] - x[None, :, :]
        s *= s
        s = np.sqrt(s.sum(2))
        np.negative(s, out=s)
    else:
        s = q @ x.T
        if distance == "cosine":
            size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
            np.divide(s, size, out=s, where=size > 0)
            s[~(size > 0)] = np.nan
    return np.round(s, 9, out=s)


def _chosen(s: np.ndarray, floor: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Places and values of the k best scores of each row, those under its floor left out; of equal ones the first."""
    usable = s >= floor[:, None]  # no NaN is
    if s.shape[1] > k and usable.sum() > k * len(s):
        # where a row has more than k, its k-th best is the new floor
        more = np.flatnonzero(usable.sum(1) > k)
        own = np.where(usable[more], s[more], -np.inf)
        usable[more] &= s[more] >= np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k, None]
    rows, columns = np.nonzero(usable)
    values = s[rows, columns]
    order = np.lexsort((columns, -values, rows))
    order = order[_first_of_each(order, rows, k)]
    return (rows[order], columns[order]), values[order]


def _in_order(at: np.ndarray, score: np.ndarray, point: np.ndarray) -> np.ndarray:
    return pd.DataFrame({"at": at, "score": -score, "point": point}).sort_values(["at", "score", "point"]).index.to_numpy()


def _first_of_each(order: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Of rows in this order, by groups, if they are among the first k of their group."""
    own = groups[order]
    return np.arange(len(own)) - np.searchsorted(own, own, "left") < k


def knn(queries: DataFrame, chunks: DataFrame, k: int, distance: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k chunks nearest to each query: query_id, point_id, score, rank (ties: smaller point_id).

    queries: query_id, vector; chunks: point_id, vector. The score is rounded to nine places before it ranks, so sums in
    another order rank alike. Every task keeps its own k best for each query, and only those are shuffled: what is
    moved doesn't grow with the product of both sides. The queries are broadcast in groups of QUERY_GROUP rows.
    """
    if k <= 0:
        return queries.sparkSession.createDataFrame([], "query_id long, point_id long, score double, rank int")
    pool = (chunks if where is None else chunks.where(where)).select("point_id", "vector")
    context = queries.sparkSession.sparkContext
    point, kind = pool.schema["point_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def nearest(rows: list) -> DataFrame:
        shared = context.broadcast(([r["query_id"] for r in rows], np.array([r["vector"] for r in rows], float).reshape(len(rows), -1 if rows else 0)))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, q = shared.value
            # the k best of every query so far: its place, score and point
            at, top, which = np.empty(0, int), np.empty(0), None
            floor = np.full(len(q), -np.inf)  # no score under it can be among them
            for batch in batches:
                batch = batch[batch.vector.notna()].sort_values("point_id")
                if not len(own) or not len(batch):
                    continue
                x, points = np.array(batch.vector.tolist(), float), batch.point_id.to_numpy()
                which = points[:0] if which is None else which
                found = [(at, top, which)]
                step = max(1, DIFFERENCES // max(1, x.size if distance == "euclid" else len(x)))
                for i in range(0, len(q), step):
                    rows, s = _chosen(_scores(q[i : i + step], x, distance), floor[i : i + step], k)
                    found.append((rows[0] + i, s, points[rows[1]]))
                at, top, which = (np.concatenate(c) for c in zip(*found, strict=True))
                # earlier batches may hold smaller points
                keep = _first_of_each(order := _in_order(at, top, which), at, k)
                at, top, which = (c[order][keep] for c in (at, top, which))
                full = np.flatnonzero(np.bincount(at, minlength=len(q)) == k)
                floor[full] = top[np.searchsorted(at, full, "right") - 1]
            if len(at):
                names = pd.Series(own).to_numpy()[at]
                yield pd.DataFrame({"query_id": names, "point_id": which, "score": top})

        return pool.mapInPandas(best, f"query_id {kind}, point_id {point}, score double")

    # one group of queries at a time passes through the driver
    asked = queries.select("query_id", "vector").where("vector IS NOT NULL").orderBy("query_id").toLocalIterator()
    groups = []
    while (rows := list(islice(asked, QUERY_GROUP))) or not groups:
        groups.append(nearest(rows))
    local = reduce(DataFrame.unionByName, groups)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    return local.where(F.col("score").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)


def over_fetch(top_k: Column | int) -> Column:
    """Chunks to fetch for so many documents."""
    size = F.lit(top_k) if isinstance(top_k, int) else top_k
    return F.least(F.lit(MOST_CHUNKS), size * OVERFETCH)


def hit_candidates(hits: DataFrame) -> DataFrame:
    """Raw hits as candidates: the DOI as written or else normalised, a missing score as 0."""
    return hits.withColumn("doi", F.coalesce(first_nonblank(F.col("doi_original"), F.col("doi_normalized")), F.lit(""))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def best_per_document(hits: DataFrame) -> DataFrame:
    """The best chunk of each document for each query, in ranked order (ties: smaller point_id); blank documents go."""
    rank = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "point_id"))
    return hits.where(nonblank(F.col("doc_id").cast("string")).isNotNull()).withColumn("_r", rank).where("_r = 1").drop("_r")


def top_documents(best: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    return best.withColumn("doc_rank", rank).where(F.col("doc_rank") <= k)


def fetch_by_documents(chunks: DataFrame, ids: DataFrame, where: Column | None = None) -> DataFrame:
    """Chunks of the wanted documents; blank ids want none. No limit on how many."""
    wanted = ids.where(nonblank(F.col("doc_id").cast("string")).isNotNull()).select("doc_id").distinct()
    return (chunks if where is None else chunks.where(where)).join(wanted, "doc_id", "left_semi")


def fetch_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def exists(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each id and if the index has it; a blank one it hasn't."""
    known = chunks.select("doc_id").distinct().withColumn("_in", F.lit(True))
    return ids.join(known, "doc_id", "left").withColumn("exists", F.coalesce("_in", F.lit(False)) & nonblank(F.col("doc_id").cast("string")).isNotNull()).drop("_in")
