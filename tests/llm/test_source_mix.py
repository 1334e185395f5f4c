import random
from collections import defaultdict
from fractions import Fraction
from math import ceil, floor, pi, sqrt

import pytest

from lexigrid.llm.source_mix import in_mix_order, mix_documents, timetable, whole_weights

SCHEMA = "doc_id long, text string, source string, slot long, __row string"


def plain_edf(blocks, raw):
    """Slots of one group by earliest deadline first, one after the other, with exact fractions: (slot, source, block, release, deadline).

    At every slot each source must be less than a block off its share of the ideal mix.
    """
    k = whole_weights(raw)
    ends = sorted({Fraction(b, x) for b, x in zip(blocks, k, strict=True)})
    slot_of = lambda v: sum(min(Fraction(b), x * v) for b, x in zip(blocks, k, strict=True))
    windows = [[(floor(slot_of(Fraction(i, x))), ceil(slot_of(Fraction(i + 1, x)))) for i in range(b)] for b, x in zip(blocks, k, strict=True)]
    at_ends = [slot_of(v) for v in ends]
    done, out, v, j = [0] * len(blocks), [], Fraction(0), 0
    for slot in range(sum(blocks)):
        deadline, s = min((windows[s][n][1], s) for s, n in enumerate(done) if n < blocks[s] and windows[s][n][0] <= slot)
        assert deadline > slot
        out.append((slot, s, done[s], *windows[s][done[s]]))
        done[s] += 1
        while at_ends[j] < slot + 1:
            v, j = ends[j], j + 1
        now = v + (slot + 1 - slot_of(v)) / Fraction(sum(x for b, x in zip(blocks, k, strict=True) if Fraction(b, x) > v))
        assert all(abs(n - min(Fraction(b), x * now)) < 1 for n, b, x in zip(done, blocks, k, strict=True))
    return out


def groups_of(tables):
    """Groups for timetable(), and what plain_edf() makes of them, one after the other."""
    groups, expected, number, first = [], [], 0, 0
    for blocks, raw in tables:
        groups.append((list(range(number, number + len(blocks))), blocks, raw))
        expected += [(first + slot, number + s, block, first + release, first + deadline) for slot, s, block, release, deadline in plain_edf(blocks, raw)]
        number, first = number + len(blocks), first + sum(blocks)
    return groups, expected


def scheduled(spark, groups, slots):
    rows = timetable(spark, groups, slots).collect()
    assert all(r["round"] == r["slot"] // slots for r in rows)
    return sorted((r["slot"], r["number"], r["block"], r["release"], r["deadline"]) for r in rows)


CASES = [
    ([1000, 330, 170, 22, 4, 3], [sqrt(4000), sqrt(1300), pi, sqrt(2), 0.01, 1e-7]),
    ([700, 60, 60], [0.98, 0.01, 0.01]),
    ([100, 100, 100], [1.0, 1.0, 1.0]),
    ([300], [0.3]),
    ([30] * 23, [1.0 + sqrt(i) for i in range(23)]),
    ([7, 300, 90, 800, 5], [3, 439, 120, 749, 3]),
]


@pytest.mark.parametrize("slots", [5, 64, 256])
def test_equals_plain_earliest_deadline_first(spark, slots):
    rng = random.Random(slots)
    weights = (lambda: rng.randint(1, 1000), lambda: rng.random() + 1e-4, lambda: 10 ** rng.uniform(-3, 0), lambda: 1.0)
    tables = [([rng.randint(1, rng.choice([3, 12])) for _ in range(n)], [w() for _ in range(n)]) for n, w in ((rng.randint(2, 60), rng.choice(weights)) for _ in range(40))]
    groups, expected = groups_of(CASES + tables)
    assert scheduled(spark, groups, slots) == expected


def test_windows_longer_than_many_rounds(spark):
    groups, expected = groups_of([([400, 300, 2, 1], [1.0, 0.5, 1e-3, 1e-4])])
    assert scheduled(spark, groups, 2) == expected


def test_thousands_of_sources(spark):
    rng = random.Random(3)
    blocks = [rng.randint(1, 5) for _ in range(3000)]
    rows = scheduled(spark, [(list(range(3000)), blocks, [sqrt(b) for b in blocks])], 256)
    assert [r[0] for r in rows] == list(range(sum(blocks))) and all(release <= slot < deadline for slot, _, _, release, deadline in rows)
    assert sorted(r[1:3] for r in rows) == [(s, b) for s, n in enumerate(blocks) for b in range(n)]


@pytest.mark.parametrize("sources", [49, 50])
def test_no_document_is_lost(spark, sources):
    """With 49 sources of these sizes, rounds that are scheduled apart could each count a block as their own."""
    rng = random.Random(sources)
    sizes = [max(1, int(9000 * rng.random() ** 3)) for _ in range(sources)]
    rows = [(i, s) for i, s in enumerate(s for s, n in enumerate(sizes) for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source long")
    assert mix_documents(docs).groupBy("row.doc_id").count().where("count = 1").count() == len(rows)
    assert in_mix_order(docs).distinct().count() == len(rows)


def test_documents_come_once_in_whole_blocks(spark):
    sizes = {"a": 900, "b": 330, "c": 70, "d": 5}
    rows = [(i, f"t{i}", s, 7, "x") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    weights = {"a": 0.5, "b": 0.3, "c": 1e-5}  # d has none: it comes last
    out = mix_documents(spark.createDataFrame(rows, SCHEMA), weights, block_docs=4, slots=40).collect()
    assert sorted(r["row"]["doc_id"] for r in out) == list(range(len(rows)))
    blocks = defaultdict(list)
    for r in out:
        assert r["release"] <= r["slot"] < r["deadline"] and r["round"] == r["slot"] // 40
        blocks[r["row"]["source"], r["block"]].append((r["slot"], r["place"]))
    assert all(len({s for s, _ in v}) == 1 and sorted(p for _, p in v) == list(range(len(v))) for v in blocks.values())
    assert all(len(v) == 4 for (s, b), v in blocks.items() if b < sizes[s] // 4)
    order = sorted((v[0][0], s) for (s, _), v in blocks.items())
    assert [s for s, _ in order] == list(range(len(order))) and [s for _, s in order[-2:]] == ["d", "d"]


def test_many_sources(spark):
    rows = [(i, "t", f"s{i % 300}", 0, None) for i in range(900)]
    out = mix_documents(spark.createDataFrame(rows, SCHEMA), block_docs=2).select("row.doc_id", "slot").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(900)) and {r["slot"] for r in out} == set(range(600))


def test_edges(spark):
    rows = [(1, "a", None, 0, "r"), (1, "a", None, 0, "r"), (None, None, "null", 0, None), (2, "", "", 0, None)]
    out = mix_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, (tuple(r["row"]) for r in out))) == sorted(map(str, rows))
    assert len({r["slot"] for r in out}) == 3
    assert mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    ordered = in_mix_order(spark.createDataFrame(rows, SCHEMA))
    assert ordered.columns == ["doc_id", "text", "source", "slot", "__row"]
    assert sorted(map(str, (tuple(r) for r in ordered.collect()))) == sorted(map(str, rows))
    assert in_mix_order(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        mix_documents(spark.createDataFrame(rows, SCHEMA), {"": -1.0})


def test_the_plan_of_the_mix_stays_small(spark):
    """Each step reads stored tables: plans that hold those of all steps before took the driver's memory."""
    docs = spark.createDataFrame([(i, f"t{i}", "abc"[i % 3], i, "x") for i in range(200)], SCHEMA)
    out = in_mix_order(docs, block_docs=4, slots=8)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert out.count() == 200
