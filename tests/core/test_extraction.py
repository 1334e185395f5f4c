import json

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import extraction, gold
from lexigrid.operators.extraction import Policy

TASK = f"task long, doi string, abstract string, result {gold.RESULT}"


def a_task(n, doi, reason, abstract=""):
    return (n, doi, abstract, [("reports", "choices", (["Yes"], None, None, None)), ("reason", "labels", (None, None, ["Evidence"], [reason])), ("sure", "rating", (None, "5", None, None))])


def an_answer(names, dois, summary="summary", aliases=(), snippet=None):
    cites = [{"doi": d} | ({"snippet": snippet} if snippet else {}) for d in dois]
    return {"answer": {"summary": summary, "risk_factors": [{"normalized_name": n, "aliases": list(aliases)} for n in names]}, "citations": cites}


def run(spark, tasks, answers, canonical, **policy):
    listed = [(c, a, k) for k, (c, names) in enumerate(canonical.items()) for a in names]
    aliases = extraction.closed_aliases(spark.createDataFrame(listed, "canonical string, alias string, place int"))
    truth = gold.gold_factors(spark.createDataFrame(tasks, TASK), aliases, "reports", "Yes", "sure", "reason", least=3)
    df = spark.createDataFrame([(k + 1, q, None, json.dumps(a)) for k, (q, a) in enumerate(answers)], "line int, query_id string, mode string, raw string").withColumn("raw", F.parse_json("raw"))
    rows = extraction.evaluate(df, truth, aliases, Policy(**policy), mode="rag_no_hyde")
    return rows, extraction.summarised(rows).first()


def test_micro_and_macro_measures(spark):
    tasks = [a_task(1, "10.1000/A", "Obesity and smoking were associated with venous thrombosis."), a_task(2, "10.1000/B", "History of DVT increased thrombosis risk.")]
    answers = [("q1", an_answer(["obesity", "hypertension"], ["10.1000/A"])), ("q2", an_answer(["prior dvt", "smoking"], ["10.1000/B"]))]
    rows, m = run(spark, tasks, answers, {"obesity": ["obesity"], "smoking": ["smoking"], "hypertension": ["hypertension"], "prior_vte": ["prior dvt", "history of dvt"]})
    assert [m[c] for c in ("micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1")] == pytest.approx([0.5, 2 / 3, 4 / 7, 0.5, 0.75, (0.5 + 2 / 3) / 2])
    assert (m["query_coverage_rate"], m["evaluated_queries"]) == (1.0, 2)
    first = rows.where("query_id = 'q1'").first()
    assert (first["pred_factors"], first["gold_factors"], first["matched_factors"], first["mode"]) == ("hypertension|obesity", "obesity|smoking", "obesity", "rag_no_hyde")


@pytest.mark.parametrize("no_gold, expected", [("skip", (0, 1, 0.0)), ("empty", (1, 0, 1.0))])
def test_answers_without_gold(spark, no_gold, expected):
    tasks = [a_task(1, "10.1000/C", "This text has no factor keyword from our small map.")]
    rows, m = run(spark, tasks, [(" ", an_answer(["obesity"], ["10.1000/C", "10.1000/C", "https://doi.org/10.1000/c"]))], {"obesity": ["obesity"]}, no_gold=no_gold)
    assert (m["evaluated_queries"], m["skipped_no_gold"], m["query_coverage_rate"]) == expected and m["micro_f1"] == 0.0
    row = rows.first()
    assert (row["query_id"], row["cited_doi_count"], row["gold_doi_count"]) == ("row_1", 1, 1)


def test_abstract_stands_in(spark):
    tasks = [a_task(1, "10.1000/E", "Reason text without canonical clues.", "Evidence mentions marker x for thrombosis risk.")]
    assert run(spark, tasks, [("q", an_answer(["marker x"], ["10.1000/E"]))], {"marker_x": ["marker x"]})[1]["micro_f1"] == 1.0


def test_catheter_occlusion(spark):
    tasks = [a_task(1, "10.1000/F", "Integrated catheters significantly reduced occlusion risk.")]
    assert run(spark, tasks, [("q", an_answer(["Occlusion"], ["10.1000/F"]))], {"catheter_occlusion": ["catheter occlusion", "occlusion"]})[1]["micro_f1"] == 1.0


def test_closed_set(spark):
    tasks, answers = [a_task(1, "10.1000/G", "Obesity was a consistent risk factor.")], [("q1", an_answer(["obesity", "unmapped token"], ["10.1000/G"]))]
    by = {c: run(spark, tasks, answers, {"obesity": ["obesity"]}, closed_set=c)[1] for c in (False, True)}
    assert (by[False]["micro_precision"], by[True]["micro_precision"]) == (0.5, 1.0) and (by[False]["micro_f1"], by[True]["micro_f1"]) == pytest.approx((2 / 3, 1.0))


def test_aliases_of_predictions(spark):
    tasks = [a_task(1, "10.1000/H", "Venous thromboembolism was associated with risk.")]
    answers = [("q1", an_answer(["previous venous thromboembolism"], ["10.1000/H"], aliases=["prior vte"]))]
    canonical = {"thromboembolism": ["venous thromboembolism", "thromboembolism"], "prior_vte": ["prior vte", "history of vte"]}
    assert [run(spark, tasks, answers, canonical, aliases=a)[1]["micro_precision"] for a in (True, False)] == [0.5, 1.0]


def test_summaries_and_snippets(spark):
    tasks, canonical = [a_task(1, "10.1000/I", "Chronic heart failure increased thrombosis risk.")], {"heart_failure": ["heart failure", "chronic heart failure"]}
    answers = [("q1", an_answer([], ["10.1000/I"], summary="Chronic heart failure was a strong risk factor."))]
    assert [run(spark, tasks, answers, canonical, summary=s)[1]["micro_f1"] for s in (False, True)] == [0.0, 1.0]
    tasks, canonical = [a_task(1, "10.1000/J", "Catheter occlusion and thrombophlebitis were frequent.")], {"catheter_occlusion": ["catheter occlusion", "occlusion"], "thrombophlebitis": ["thrombophlebitis"]}
    answers = [("q1", an_answer([], ["10.1000/J"], summary="summary without explicit factors", snippet="This cohort had catheter occlusion and thrombophlebitis events."))]
    assert [run(spark, tasks, answers, canonical, snippets=s)[1]["micro_f1"] for s in (False, True)] == [0.0, 1.0]


def test_odd_answers(spark):
    tasks = [a_task(1, "10.1000/K", "smoking")]
    odd = [None, [], "text", {"answer": "x", "citations": "y"}, {"answer": {"risk_factors": [1, {"normalized_name": 5, "aliases": "smoking"}, {"aliases": [None, " smoking "]}]}, "citations": [None, {"doi": 7}, {"doi": "10.1000/K", "snippet": " ", "text": 3, "content": "ok"}]}]
    rows, m = run(spark, tasks, [(f"q{k}", a) for k, a in enumerate(odd)], {"smoking": ["smoking"]})
    assert [r["excluded"] for r in rows.orderBy("line").collect()] == [True] * 4 + [False] and m["micro_f1"] == 1.0
    with pytest.raises(ValueError):
        Policy(no_gold="other")


def test_answers_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    aliases = extraction.closed_aliases(spark.createDataFrame([("obesity", "obesity", 0)], "canonical string, alias string, place int"))
    truth = spark.createDataFrame([("10 1000 a", ["obesity"])], "doi string, factors array<string>")
    raw = json.dumps(an_answer(["obesity"], ["10.1000/A"], summary="obesity"))
    df = spark.createDataFrame([(k, f"q{k}", None, raw) for k in range(20)], "line int, query_id string, mode string, raw string").select("line", "query_id", "mode", F.parse_json(read("raw")).alias("raw"))
    rows = extraction.evaluate(df, truth, aliases, Policy(closed_set=True, summary=True, snippets=True)).collect()
    assert len(rows) == 20 and {r["tp"] for r in rows} == {1} and seen.value == 20
