import datetime

from pyspark.sql import functions as F

from lexigrid.operators import gold
from lexigrid.streaming import jobs

TASK = f"task long, doi string, abstract string, result {gold.RESULT}"
ALIASES = [("obesity", "bmi", 0), ("obesity", "obesity", 0), ("surgery", "hip surgery", 1), ("surgery", "surgery", 1)]


def answers(choice, rating, *reasons):
    return [("risk", "choices", ([choice], None, None, None)), ("sure", "rating", (None, rating, None, None)), ("why", "textarea", (None, None, None, list(reasons)))]


def factors(spark, rows, **options):
    aliases = spark.createDataFrame(ALIASES, "canonical string, alias string, place int")
    out = gold.gold_factors(spark.createDataFrame(rows, TASK), aliases, "risk", "Yes", "sure", "why", **options)
    return {r["doi"]: r["factors"] for r in out.collect()}


def test_gold_factors(spark):
    rows = [
        (1, "https://doi.org/10.1/A", "after surgery", answers("yes", "4", "High BMI!")),
        (2, "10.1/a", None, answers(" YES ", "5", "hip   surgery")),  # the same DOI: both sets
        (3, "10.1/b", "obesity", answers("yes", "2", "surgery")),  # not sure enough
        (4, "10.1/c", "obesity", answers("yes", None)),  # no reason: the abstract
        (5, "10.1/d", "obesity", answers("yes", "3", "nothing known")),  # no hit: the abstract
        (6, "10.1/e", "obesity", answers("no", "5", "surgery")),
        (7, " ", "obesity", answers("yes", "5", "surgery")),
        (8, "10.1/f", None, None),
        (9, "10.1/g", "bmix", answers("yes", "4.5", "neurosurgery")),  # rating no whole number; no whole word
    ]
    assert factors(spark, rows) == {"10 1 a": ["obesity", "surgery"], "10 1 c": ["obesity"], "10 1 d": ["obesity"], "10 1 g": []}
    assert factors(spark, rows, abstracts=False, missing=False) == {"10 1 a": ["obesity", "surgery"], "10 1 d": []}
    assert factors(spark, []) == {}


def test_canonical_factor(spark):
    aliases = spark.createDataFrame(ALIASES, "canonical string, alias string, place int")
    names = spark.createDataFrame([("BMI",), ("severe obesity and surgery",), ("Age > 60",), ("",), (None,)], "name string")
    assert {r["name"]: r["canonical"] for r in gold.canonical_factor(names, aliases).collect()} == {"BMI": "obesity", "severe obesity and surgery": "obesity", "Age > 60": "age 60", "": "", None: ""}


def test_metadata_matches(spark):
    pool = spark.createDataFrame([("d", 2, "Other", 2000, "J"), ("d", 1, "A Title, here", 2001, "J One"), (" ", 1, "x", 1, "y"), ("e", 1, None, None, "")], "doi string, rank int, title string, year int, journal string")
    tasks = spark.createDataFrame([("d", "a title here", 2001, "j one!"), ("e", None, 3, None), ("f", "z", 1, "z")], "doi string, title string, year int, journal string")
    out = {r["doi"]: (r["title_similarity"], r["title_sim_ok"], r["year_match"], r["journal_match"]) for r in gold.metadata_matches(pool, tasks).collect()}
    assert out == {"d": (1.0, 1, 1, 1), "e": (0.0, 0, 0, 0)}


def test_in_id_order_and_metric_place(spark):
    ids = spark.createDataFrame([("3", 0), ("1", 1), ("9", 2)], "pmid string, place int")
    known = spark.createDataFrame([("1", "one"), ("3", "three")], "pmid string, title string")
    assert [(r["pmid"], r["title"]) for r in gold.in_id_order(ids, known).collect()] == [("3", "three"), ("1", "one"), ("9", None)]
    names = spark.createDataFrame([(m,) for m in ["nDCG@5", "R@10", "P@10", "mrr", "P@5"]], "m string")
    assert [r["m"] for r in names.orderBy(gold.metric_place(F.col("m"))).collect()] == ["mrr", "P@5", "P@10", "R@10", "nDCG@5"]


def test_records_live_from_when_they_were_stored(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [("k", at(0), "a"), ("k", at(23), "a"), ("k", at(24), "a"), ("k", at(25), "a"), ("m", at(0), "a"), ("m", at(1), "b"), ("m", at(2), "b"), ("m", at(3), "a"), (None, at(0), "a")]
    events = spark.createDataFrame(rows, "key string, ts timestamp, body string")
    hours = lambda df: sorted((r["key"], (r["ts"] - at(0)).total_seconds() / 3600) for r in df.collect())
    assert hours(jobs.once_within(events, "key")) == [("k", 0), ("k", 25), ("m", 0)]
    assert hours(jobs.once_within(events, "key", body="body")) == [("k", 0), ("k", 25), ("m", 0), ("m", 1), ("m", 3)]
