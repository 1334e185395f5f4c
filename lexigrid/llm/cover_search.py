"""Exact top-k inner-product search with dual cover trees.

Vectors and queries are dealt into blocks; every pair of a query block and a vector block is one group.
Inside it both sides get a cover tree: a node's points lie within its covering radius of its centre, and
the centres of its children are over half of that radius apart. Node pairs are visited together. For
queries within r of q and vectors within s of x, no inner product exceeds

    <q, x> + r |x| + s |q| + r s,

so a pair is left out if this is under the worst k-th score of the queries in the node. The first worst
scores come from a bounded sample of the vectors, which are candidates like all others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a vector block and of a query block; there are MIN_BLOCKS vector blocks at least.
BLOCK, QUERY_BLOCK, MIN_BLOCKS = 8192, 1024, 64
#: Vectors that give the queries their first worst scores. They prune; the result doesn't depend on them.
SEEDS = 2048
LEAF = 48
#: Components beyond this are computed with Python's integers.
SAFE = 2.0**20


class Node:
    __slots__ = ("centre", "children", "norm", "points", "radius", "worst")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children
        self.norm = float(np.sqrt(centre @ centre))
        self.worst = -np.inf


def cover_tree(x: np.ndarray) -> Node:
    """Cover tree over the rows of x. Equal rows end in one leaf of radius 0."""

    def build(points: np.ndarray, centre: int) -> Node:
        d = np.sqrt(((x[points] - x[centre]) ** 2).sum(1))
        radius = float(d.max())
        if len(points) <= LEAF or radius == 0:
            return Node(x[centre], radius, points, [])
        heads, owner, nearest = [centre], np.zeros(len(points), np.int64), d
        while nearest.max() > radius / 2:
            far = int(nearest.argmax())
            new = np.sqrt(((x[points] - x[points[far]]) ** 2).sum(1))
            closer = new < nearest
            owner[closer], nearest[closer] = len(heads), new[closer]
            heads.append(int(points[far]))
            if len(heads) > max(8, len(points) // 8):  # many dimensions: the rest keeps the heads it has
                break
        return Node(x[centre], radius, points, [build(points[owner == k], h) for k, h in enumerate(heads)])

    return build(np.arange(len(x)), 0)


class Best:
    """The k best of every query: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.found, self.floor = k, [[] for _ in range(n)], floor.copy()

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores: one row per query."""
        usable = (scores >= self.floor[queries][:, None]) & (ids[None, :] != own[queries][:, None])
        for row in np.flatnonzero(usable.any(1)):
            q = int(queries[row])
            at = np.flatnonzero(usable[row])
            s, i = scores[row, at], ids[at]
            if len(at) > self.k:
                keep = np.lexsort((i, -s))[: self.k]
                s, i = s[keep], i[keep]
            best = self.found[q]
            best.extend(zip(s.tolist(), (-i).tolist(), strict=True))
            if len(best) >= self.k:
                self.found[q] = best = heapq.nlargest(self.k, best)
                self.floor[q] = max(self.floor[q], best[-1][0])


def refresh(node: Node, floor: np.ndarray) -> None:
    for child in node.children:
        refresh(child, floor)
    node.worst = min(c.worst for c in node.children) if node.children else float(floor[node.points].min())


def bound(q: Node, x: Node) -> float:
    top = float(q.centre @ x.centre) + q.radius * x.norm + x.radius * q.norm + q.radius * x.radius
    return top + 1e-9 * (abs(top) + q.norm * x.norm) + 1e-6


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """k best (score, -id) of every query among the vectors, but for scores under its floor."""
    best = Best(len(queries), k, floor)
    if not len(queries) or not len(vectors):
        return best.found
    roots = cover_tree(queries), cover_tree(vectors)
    refresh(roots[0], best.floor)
    count = 0
    ready = [(-bound(*roots), count, *roots)]
    while ready:
        top, _, q, x = heapq.heappop(ready)
        if q.children:
            q.worst = min(c.worst for c in q.children)
        if -top < q.worst:
            continue
        if not q.children and not x.children:
            for at in range(0, len(x.points), 4096):
                part = x.points[at : at + 4096]
                best.add(q.points, queries[q.points] @ vectors[part].T, ids[part], query_ids)
            q.worst = float(best.floor[q.points].min())
            continue
        down = q.children and (not x.children or q.radius >= x.radius)
        for pair in [(c, x) for c in q.children] if down else [(q, c) for c in x.children]:
            if (b := bound(*pair)) >= pair[0].worst:
                count += 1
                heapq.heappush(ready, (-b, count, *pair))
    return best.found


def plain_search(queries: list[list[int]], query_ids, vectors: list[list[int]], ids, k: int) -> list[list[tuple[int, int]]]:
    """The same for components beyond SAFE, with Python's integers."""
    return [heapq.nlargest(k, ((sum(a * b for a, b in zip(q, v, strict=True)), -int(i)) for v, i in zip(vectors, ids, strict=True) if i != own)) for q, own in zip(queries, query_ids, strict=True)]


def topk_search(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k rows of highest integer inner product for every row whose id is divisible by `every`.

    Components x become floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties go to the
    smaller id. A query's own id is no candidate for it; fewer candidates than k give fewer rows.

    Rows with a null id, a null vector or a null or non-finite component take no part; vectors meet those
    of their own length only. Repeated rows (same id, same vector) count once. Scores beyond 64 bits are
    cut to the nearest that fits. Other columns are not read; an empty table gives an empty result.
    """
    clean = (
        vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .where(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
        .dropDuplicates(["vec_id", "v"])
    )
    n, chosen = clean.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, query_blocks = max(MIN_BLOCKS, -(-n // BLOCK)), max(1, -(-chosen // QUERY_BLOCK))
    # a bounded sample: SEEDS vectors, whatever the size of the table
    seeds = clean.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).collect()
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["v"]) for r in seeds}:
        own = [r for r in seeds if len(r["v"]) == size and all(abs(c) <= SAFE for c in r["v"])]
        if own:
            sample[size] = np.array([r["v"] for r in own], float).reshape(len(own), size), np.array([r["vec_id"] for r in own])

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            low = np.full(len(b), -np.inf)
            for row, (own, v) in enumerate(zip(b.vec_id, b.v, strict=True)):
                if len(v) in sample and np.all(np.abs(v) <= SAFE):
                    x, ids = sample[len(v)]
                    s = (x @ np.asarray(v, float))[ids != own]
                    # an id may stand for several vectors: as many different ids as asked for
                    if len(s) >= k and len(np.unique(ids[ids != own])) == len(s):
                        low[row] = np.partition(s, len(s) - k)[len(s) - k]
            yield b.assign(low=low)

    queries = clean.where(F.col("vec_id") % every == 0).mapInPandas(floors, "vec_id long, v array<double>, low double")
    left = queries.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "vec_id", "v", "low")
    right = clean.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("q"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("b"), "vec_id", "v")

    def meet(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for size in set(qs.v.map(len)) & set(xs.v.map(len)):
            q, x = qs[qs.v.map(len) == size], xs[xs.v.map(len) == size]
            a, b = np.array(q.v.tolist(), float).reshape(len(q), size), np.array(x.v.tolist(), float).reshape(len(x), size)
            if size and max(np.abs(a).max(), np.abs(b).max()) > SAFE:
                whole = [[int(c) for c in v] for v in q.v], [[int(c) for c in v] for v in x.v]
                found = plain_search(whole[0], q.vec_id.to_numpy(), whole[1], x.vec_id.to_numpy(), k)
            else:
                found = search(a, q.vec_id.to_numpy(), q.low.to_numpy(float), b, x.vec_id.to_numpy(), k)
            out.extend((int(own), -i, max(-(2**63), min(2**63 - 1, int(s)))) for own, rows in zip(q.vec_id, found, strict=True) for s, i in rows)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    local = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
