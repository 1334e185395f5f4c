import datetime
import os
import random
import re

from pyspark.sql import functions as F

from lexigrid.operators import answers, chunking, tables
from lexigrid.operators.chunking import Sentences
from lexigrid.plans import search_queries, workflows
from lexigrid.sources import readers

BASE = datetime.datetime(2024, 1, 1)


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v int, at int"
    rows = [(f"k{i}", i, 1) for i in range(100)]
    assert tables.read_latest(spark, path, schema).count() == 0
    tables.upsert_latest(spark.createDataFrame(rows, schema), path, ["k"], "at", 16)
    first = files_of(path)
    assert len(first) == 16
    change = spark.createDataFrame([("k7", 700, 2), ("k7", 699, 2 - 1), ("k8", -1, 0)], schema)
    touched = change.select(F.countDistinct(F.pmod(F.xxhash64("k"), F.lit(16)))).first()[0]
    for _ in range(2):  # the same batch again changes nothing
        before = files_of(path)
        tables.upsert_latest(change, path, ["k"], "at", 16)
        after = files_of(path)
        assert len(after) == 16 and len(set(after) - set(before)) == touched <= 2
        got = {r["k"]: (r["v"], r["at"]) for r in tables.read_latest(spark, path, schema).collect()}
        assert len(got) == 100 and got["k7"] == (700, 2) and got["k8"] == (8, 1) and got["k9"] == (9, 1)
    tables.upsert_latest(change.limit(0), path, ["k"], "at", 16)
    assert files_of(path) == after


def test_commands_on_saved_queries(spark):
    at = lambda s: BASE + datetime.timedelta(seconds=s)
    rows = [
        (1, at(0), "enable", None, None, None), (1, at(1), "create", " ", "d", True), (1, at(2), "create", " vte ", " d ", False), (1, at(3), "enable", None, None, None), (1, at(4), "create", "other", "o", None),
        (1, at(5), "update", "new", "", None), (1, at(6), "update", "new", "text", None), (1, at(7), "disable", "x", "y", None), (2, at(0), "update", "q", "d", None), (3, at(0), "create", "q", "d", None), (3, at(1), "drop", "q", "d", None),
    ]
    told, queries = tables.saved_query_changes(spark.createDataFrame(rows, "query_id int, at timestamp, command string, pubmed_query string, description string, enabled boolean"))
    assert [r["outcome"] for r in told.where("query_id = 1").orderBy("at").collect()] == ["not_found", "invalid: pubmed_query", "created", "enabled", "exists", "invalid: description", "updated", "disabled"]
    assert [r["outcome"] for r in told.where("query_id <> 1").orderBy("query_id", "at").collect()] == ["not_found", "created", "invalid: command"]
    got = {r["query_id"]: tuple(r)[1:] for r in queries.collect()}
    assert got == {1: ("new", "text", False, at(2), at(7)), 3: ("q", "d", True, at(0), at(0))}


def test_completions(spark):
    runs = spark.createDataFrame([(1, "RUNNING"), (2, "RUNNING")], "run_id int, status string")
    done = spark.createDataFrame([(1, "FAILED", "x", 5), (1, "SUCCESS", None, 9), (7, "SUCCESS", None, 1)], "run_id int, status string, error_message string, finished_at int")
    assert sorted(map(tuple, tables.complete(runs, done, "run_id", ["status", "error_message"]).collect())) == [(1, "SUCCESS", None, 9), (2, "RUNNING", None, None)]


def test_tables_of_configurations(spark):
    rows = [("a/llm_only", "llm_only", "f1", 0.5), ("b/llm_only", "llm_only", "f1", 1.0), ("b/llm_only", "llm_only", "f1", None), ("c", "rag_hyde", "f1", float("nan")), ("primary_deterministic/x", "llm_only", "f1", 0.0), ("d", "zzz", "f1", 1.0), ("d", "zzz", "other", None)]
    df = spark.createDataFrame(rows, "file string, configuration string, metric string, value double")
    wide = workflows.configuration_table(workflows.configuration_means(df))
    assert wide.columns == ["metric", "LLM only", "All"]
    assert sorted(map(tuple, wide.collect())) == [("f1", 0.5, 0.625), ("other", None, None)]
    assert [tuple(r) for r in workflows.configuration_table(workflows.configuration_means(df, primary_only=True)).collect()] == [("f1", 0.0, 0.0)]


def test_measures_of_a_summary(spark):
    text = '{"retrieval": {"nDCG@10": 0.5, "later": {"nDCG@10": 0.9}}, "Recall": [0.25, "0.1"], "recall_text": "0.3", "MRR": true, "note": 5, "f1": null}'
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, None), (4, "[]")], "k int, j string")
    assert sorted(map(tuple, answers.summary_metrics(df, "k", "j").collect())) == [(1, "MRR", 1.0), (1, "Recall", 0.25), (1, "nDCG@10", 0.9)]


ARTICLE = """<PubmedArticle><MedlineCitation Status="x"><PMID Version="1"> {pmid} </PMID><Article><Journal><Title>J &amp; K</Title><JournalIssue CitedMedium="p"><PubDate>{year}</PubDate></JournalIssue></Journal>
<ArticleDate DateType="e"><Year>2019</Year></ArticleDate><ArticleTitle>a <i>b</i> c</ArticleTitle><AuthorList><Author ValidYN="Y"><LastName>Doe</LastName><ForeName>Jane</ForeName><Initials>J</Initials></Author><Author><LastName>Solo</LastName></Author><Author><CollectiveName>The Group</CollectiveName></Author><Author/></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">{pmid}</ArticleId><ArticleId IdType="DOI"> </ArticleId><ArticleId IdType="DOI"> 10.1/{pmid} </ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""


def test_bulk_literature_in_parts(spark, tmp_path):
    body = "".join(ARTICLE.format(pmid=i, year="<Year>2020</Year>" if i % 2 else "<MedlineDate>2018 Dec</MedlineDate>") for i in range(1, 200))
    empty = "<PubmedArticle><MedlineCitation><PMID>900</PMID></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><Article><Journal><Title>no id</Title></Journal></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text(f"<PubmedArticleSet>{body}{empty}</PubmedArticleSet>")
    (tmp_path / "b.xml").write_text(f"<PubmedArticleSet>{ARTICLE.format(pmid=5, year='<Year>19x</Year>')}</PubmedArticleSet>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = {r["pmid"]: r for r in readers.read_articles(spark, str(tmp_path)).collect()}
            assert len(rows) == 199 and set(rows) == {str(i) for i in range(1, 200)}
            assert tuple(rows["7"]) == ("7", "10.1/7", "J & K", 2020, ["Doe J", "Solo", "The Group"]) and rows["8"]["year"] == 2019
            assert rows["5"]["year"] is None  # the last file's article counts, whose year is no number
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_id_tables_of_different_headers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\n  PMID\tPMCID\tDOI  \n1\tPMC1\t10.1/a\n\n2\tPMC2\n3\n \tPMC9\t10.1/z\n4\t\t 10.1/d \n4\tPMC4\t\n")
    (tmp_path / "b.tsv").write_text("doi\tother\tpmid\n10.1/b\tx\t2\n10.1/c\ty\t7\n")
    (tmp_path / "c.tsv").write_text("doi\tpmcid\n10.1/q\tPMC8\n")
    (tmp_path / "d.tsv").write_text("\n \n")
    got = sorted(map(str, map(tuple, readers.read_id_table(spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, [("1", "10.1/a", "PMC1"), ("2", "10.1/b", None), ("4", None, "PMC4"), ("7", "10.1/c", None), ("PMC9", None, "10.1/z")]))  # a trimmed line begins with its first word


def loop(text, size, overlap):
    """Packing as one loop over sentences, for texts without words longer than a chunk."""
    units = []
    for s in (x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x.strip()):
        if len(s) <= size:
            units.append(("s", s))
        else:
            units += [("w" if k else "W", w) for k, w in enumerate(s.split())] + [("|", "")]
    out, held = [], ""
    for kind, u in units:
        fresh = kind in "W|" or (held and len(held) + 1 + len(u) > size)
        if fresh and held:
            out.append(held)
            held = ""
        held = f"{held} {u}".strip() if u else held
    out += [held] if held else []
    result = out[:1]
    for before, chunk in zip(out, out[1:], strict=False):
        tail = before if len(before) <= overlap else before[-overlap:]
        if len(before) > overlap and " " in tail:
            tail = tail.split(maxsplit=1)[-1]
        tail = tail.strip()
        result.append(f"{tail} {chunk}" if overlap and tail and len(tail) + 1 + len(chunk) <= size else chunk)
    return result


def test_sentences_are_packed_with_tails(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcé漢", k=rng.randint(1, 9)))
    texts = [" ".join(" ".join(word() for _ in range(rng.randint(1, 14))) + rng.choice([".", "!", "?", ". \n"]) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, " "])], "i int, text string")
    for size, overlap in ((60, 15), (30, 0), (200, 199)):
        got = {r["i"]: r["c"] for r in df.select("i", chunking.sentence_chunks(F.col("text"), Sentences(size, overlap)).alias("c")).collect()}
        assert all(got[i] == loop(t, size, overlap) for i, t in enumerate(texts))
        assert got[80] == [] and got[81] == []
    packer = Sentences(3, 10)
    assert packer.pieces("abcdefghij") == ["abc", "def", "ghi", "j"] and packer.packed(["x abcdefg yz"]) == ["x", "abc", "def", "g", "yz"]


def test_broken_article_beside_a_whole_one(spark):
    """A text that is no XML stands in one batch with others."""
    rows = [(1, "<A><PMID>7</PMID><PubDate>1999 May</PubDate><Author><LastName>B</LastName></Author></A>"), (2, "<A>cut &amp</A>"), (3, None)]
    out = readers.article_records(spark.createDataFrame(rows, "k int, xml string").coalesce(1)).orderBy("k").collect()
    assert [(r["pmid"], r["year"], r["authors"], r["mesh"]) for r in out] == [("7", 1999, ["B"], []), (None,) * 4, (None,) * 4]


def test_page_records_keep_titles_with_signs(spark, tmp_path):
    html = [(1, '<html lang="en"><title>A &lt; B &amp</title>'), (2, "<html lang='de'><title>R&D <b ]]></title>"), (3, '<html lang="fr"><title>C</title>')]
    spark.createDataFrame(html, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    out = search_queries.page_records(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [r["title"] for r in out] == ["A and B &amp end", "R&D <b ]]> end", "C end"] and [r["pmid"] for r in out] == ["1", "2", "3"]
