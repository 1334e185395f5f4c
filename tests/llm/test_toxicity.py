import random
import zlib
from itertools import product

import numpy as np
import pytest

from lexigrid.llm.toxicity import DROP, EDGE, HIDE, IMITATE, IMITATES, KEEP_SIGN, REPEAT, SEPARATORS, Beginnings, Classifier, Parts, Restorer, Words, count_trigrams, features, score_documents, trigram_costs

DOCS, LABELS = "doc_id long, text string, score string, toxic int", "doc_id long, quality int, toxic int, text string"


def corpus():
    rnd = random.Random(3)
    plain = "the river runs under an old stone bridge while people walk along both banks and talk about weather music bread gardens".split()
    bad = ["idiot", "moron", "pathetic", "stupid"]
    rows, labels = [], []
    for i in range(800):
        w = rnd.choices(plain, k=rnd.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w), None, 1 - toxic))
        labels.append((i, 1, int(toxic), "x"))
    return rows, labels


@pytest.mark.parametrize(("written", "meant"), [("1d10t", "idiot"), ("m.0.r.0.n", "moron"), ("m o r o n", "moron"), ("stuuuupid", "stupid"), ("p4th3t1c", "pathetic"), ("st*pid", "stupid"), ("idiot!!", "idiot"), ("bridge", "bridge"), ("", "")])
def test_restores(spark, written, meant):
    global COSTS
    if "COSTS" not in globals():
        COSTS = trigram_costs(count_trigrams(spark.createDataFrame(corpus()[0], DOCS), "text"))
    assert Restorer(COSTS).decode(written) == meant


def all_paths(written, costs, spaces=False):
    """Cost and letters of each path of the lattice, one by one."""
    number = Restorer.number
    letters = [k for k, c in enumerate(written) if c.isalnum()]

    def go(at, a, b, out, cost):
        if at == len(written):
            yield cost + costs[a][b][0], out
            return
        c, means = written[at], IMITATES.get(written[at], "")
        arcs = [(c, 0.0 if c.isalpha() else KEEP_SIGN)] if c.isalnum() else [(c, 0.0)] if spaces and c == " " else []
        arcs += [(m, HIDE if len(means) > 2 else IMITATE) for m in means]
        for m, extra in arcs:
            yield from go(at + 1, b, number(m), out + m, cost + extra + costs[a][b][number(m)])
        edge = not letters or at <= letters[0] or at >= letters[-1]
        skips = [REPEAT] if out and any(m == out[-1] for m, _ in arcs) else []
        if not c.isalnum() and (c in SEPARATORS or edge or not means):
            skips.append((EDGE if means else 0.0) if edge else DROP)
        if skips:
            yield from go(at + 1, a, b, out, cost + min(skips))

    return go(0, 0, 0, "", 0.0)


def test_viterbi_is_the_best_of_all_paths(spark):
    costs = trigram_costs(count_trigrams(spark.createDataFrame(corpus()[0], DOCS), "text"))
    rnd, restorer = random.Random(9), Restorer(costs)
    for written in ["1d10t", "m.0.r.0.n", "p4th3t1c", "$tup1d!", "*#a", "!!", "", *("".join(rnd.choices("mronidt0134@!.-*", k=rnd.randint(1, 6))) for _ in range(150))]:
        found = sorted(all_paths(written, costs))
        if restorer.decode(written) != found[0][1]:  # several of one cost, or the repeat of a letter with several last letters
            assert restorer.decode(written) in {w for c, w in found if c < found[0][0] + 1e-9}
    words = ["moron", "idiot", "a", "it"]
    begin = Beginnings({f for w in words for f in features(w)})
    for written in ["".join(rnd.choices("mronidt0134@!.-*", k=rnd.randint(1, 6))) for _ in range(150)]:
        if any(f in {g for w in words for g in features(w)} for _, w in all_paths(written, costs) for f in features(w)):
            assert begin.meets(written)


def test_words_in_parts(spark):
    costs = trigram_costs(count_trigrams(spark.createDataFrame(corpus()[0], DOCS), "text"))
    wanted = {"=moron", "=idiot", "=pathetic", "^idio", "=ass"}
    words, rnd = Words(costs, wanted, parts=True), random.Random(4)
    for written in ("mo ron", "id i ot", "id 1 0t!", "mor on.", "p4 the tic"):
        (meant,) = words.parts.of(f"walk {written} and".split())
        assert words.joined(meant) == meant.translate(str.maketrans("104", "ioa", " !.")) and words.joined(meant) in words.of(f"walk {written} and")[0]
    assert words.parts.of("a s s as s m o r o n mo bridge ron".split()) == set()  # a spaced run, or too short, or not next to each other
    # what white space stands for, against all paths; and the spans against all spans and all readings of them
    for written in ("mo ron", "id i ot", "the mo", "an d a", *(" ".join("".join(rnd.choices("mronidt10", k=rnd.randint(1, 2))) for _ in range(3)) for _ in range(60))):
        found = sorted(all_paths(written, costs, True))
        assert words.restorer.decode(written, spaces=True) in {w for c, w in found if c < found[0][0] + 1e-9} or any(a == b for a, b in zip(written, written[1:]))
    parts = Parts({"=moron", "=idiot"})
    for tokens in product(["mo", "ron", "id", "iot", "i", "0t", "mor", "oron"], repeat=3):
        spans = [" ".join(tokens[a:b]) for a in range(3) for b in range(a + 2, 4)]
        assert parts.of(list(tokens)) == {s for s in spans if any(w in ("moron", "idiot") for _, w in all_paths(s, costs))}
    assert parts.of(["m"] * 200_000) == set()


def test_runs_of_any_length():
    model = Classifier({"=ass": 5.0, "=moron": 4.0, "^idio": 3.0, "=incomprehensibilities": 2.0}, np.zeros(7))
    top = lambda run: sorted(model.signs(set(), [run])[1:4], reverse=True)
    assert top("ass") == [5.0, 0.0, 0.0] and top("class") == [0.0, 0.0, 0.0]
    assert top("moron") == [4.0, 0.0, 0.0] and top("amoronmoron") == [4.0, 4.0, 0.0]
    assert top("idiotic") == [3.0, 0.0, 0.0] and top("theincomprehensibilities") == [2.0, 0.0, 0.0]


def test_opens_the_gates(spark):
    words = Words(trigram_costs(count_trigrams(spark.createDataFrame(corpus()[0], DOCS), "text")))
    for written, meant in (("stuupid", "stupid"), ("iddiot", "idiot"), ("bridge", "bridge")):
        assert {meant, written} == words.of(f"{written} people")[0] - {"people"}
    for space in ("  ", "\t", "\n", " \n "):
        assert words.of(f"walk {space.join('moron')} and")[1] == ["moron"]
    # a word over the place where runs were cut, and one after it
    (run,) = words.of(" ".join("river" * 18 + "people" + "moron" + "bridge" * 20))[1]
    assert "moron" in run and len(run) > 200
    assert words.of("bridge-" * 6 + "m0r0n-" + "x1" * 30_000)[0].pop().startswith("bridge" * 6 + "moron")


def test_held_out_and_disguised(spark):
    rows, labels = corpus()
    disguised = [(2000 + i, t, "k", 0) for i, t in enumerate(["people walk along 1d10t and talk", "the old m o r o n runs under stone", "the old mo ron runs", "walk id i ot under stone", "music bread stuuuupid gardens", "weather p4th3t1c music"])]
    edges = [(None, None, None, None), (5000, "", None, 1), (5000, "", None, 1), (5001, "river " * 20000, None, None)]
    out = {r["doc_id"]: r for r in score_documents(spark.createDataFrame(rows + disguised + edges, DOCS), spark.createDataFrame(labels + [(None, 1, 1, "")], LABELS)).collect()}
    held = [(i, bool(t)) for i, _, t, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] for i, _ in held)
    assert sum(bool(out[i]["predicted"]) == t for i, t in held) >= 0.97 * len(held)
    assert all(out[d[0]]["predicted"] == 1 for d in disguised)
    assert out[None]["score"] == out[5000]["score"] < 0.5 and out[5001]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], LABELS)
    rows = spark.createDataFrame([(1, "an idiot", None, 1)], DOCS)
    assert [r["predicted"] for r in score_documents(rows, none).collect()] == [0]
    assert score_documents(spark.createDataFrame([], DOCS), none).count() == 0


def test_only_words_that_show_something_are_kept(spark):
    costs = trigram_costs(count_trigrams(spark.createDataFrame(corpus()[0], DOCS), "text"))
    wanted = {"=moron", "=idiot", "^path"}
    all_words, some = Words(costs), Words(costs, wanted, parts=True)
    for text in ("bridge m0r0n, people", "the Patthetic river", "(idiot) mo ron x9", "walk bridge", "", None):
        shown = {w for w in all_words.of(text)[0] if wanted & set(features(w))}
        found = some.of(text)[0]
        assert shown == {w for w in found if w not in map(some.joined, some.parts.of((text or "").lower().split()))} | (shown & found)
        assert all(wanted & set(features(w)) for w in found)
    assert {"bridge", "people", "the", "walk"} <= some.nothing | some.only_opens and not some.cache


def test_trigrams_of_many_texts_count_like_those_of_each(spark):
    texts = ["a", "", None, "Ab!c d", "é İx", "zz" * 5, "Ünder the bridge"]
    rows = [(k, t, None) for k, t in enumerate(texts)]
    whole = count_trigrams(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1), "text")
    each = sum(count_trigrams(spark.createDataFrame([r], "doc_id long, text string, source string"), "text") for r in rows)
    assert (whole == each).all() and whole.sum() > 0
