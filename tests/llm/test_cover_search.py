import math
import random

from lexigrid.llm.cover_search import topk_search

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k=10, every=100):
    seen = {}
    for vec_id, v, *_ in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = tuple(math.floor(1024 * x) for x in v)
            seen[vec_id, q] = None
    out = []
    for a, q in seen:
        if a % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), b) for b, v in seen if b != a and len(v) == len(q))
            out += [(a, i + 1, b, max(-(2**63), min(2**63 - 1, -s))) for i, (s, b) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in topk_search(spark.createDataFrame(rows, SCHEMA)).collect())


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [float(f"{rnd.gauss(0, 1):.3f}") for _ in range(8)], "x", 1) for i in range(700)]
    rows = [(i, [x for x in map(lambda y: round(y * 8) / 8, v)], s, r) for i, v, s, r in rows]
    rows += [(i, rows[3][1], None, None) for i in range(700, 1000)]  # one vector, many ids: ties
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0], None, None), (0, [1.0, 2.0], None, None), (5, [1.0, None], None, None), (6, None, None, None), (None, [1.0, 1.0], None, None), (7, [float("nan"), 1.0], None, None), (8, [float("inf"), 1.0], None, None), (9, [3.0, 1.0], None, None), (100, [-1.0, 1.0], None, None), (200, [1.0], None, None), (201, [2.0], None, None), (300, [], None, None), (10, [1e6, 1.0], None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
