"""Toxicity scores of texts whose words may be disguised: noisy-channel restoring, then a classifier.

A disguised word is a path through a lattice: each written character may stand for itself, for letters that it
imitates, or for nothing (separators, and repeats of the letter before). Viterbi decoding finds the path of least cost
under a character trigram model of the whole corpus. Only words that show a sign of disguise are decoded. Neighbouring tokens
that together may stand for a known word are decoded as one string, in which white space may stand for itself or for nothing.

The classifier knows words and word beginnings that toxic texts have far oftener than others, from restored texts of a
bounded sample of labelled rows, and a logistic regression over how strongly and how often a text shows them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBERS, added_up, column, discard, numbers_of_task, stored

#: What written characters may stand for, besides themselves (fixed values).
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SEPARATORS = set(" .-_*~'`^,:;/\\|+=#")
#: Costs in nats: standing for another letter, standing for any vowel, a dropped separator, a dropped repeat.
IMITATE, HIDE, DROP, REPEAT, KEEP_SIGN = 1.0, 2.5, 1.0, 0.7, 6.0
#: Dropping a sign at either end of a word that may imitate a letter.
EDGE = 0.8
LETTERS, PARTS = 64, 64
SAMPLE, FIT_SAMPLE, FEATURES = 40_000, 20_000, 30_000
CACHE = 300_000


def letter_numbers(codes: np.ndarray) -> np.ndarray:
    """0: no letter; 1-26: a-z; 27-63: all other letters, by their code."""
    out = np.zeros(len(codes), np.int64)
    small = codes | 32
    plain = (small >= 97) & (small <= 122) & (codes < 128)
    out[plain] = small[plain] - 96
    wide = codes >= 0xAA
    out[wide] = 27 + codes[wide] % 37
    return out


#: Numbers of the first codes, and letter trigrams that are counted together.
NUMBER_OF = letter_numbers(np.arange(256, dtype=np.uint32)).astype(np.int32)
COUNTED = 1 << 20


def _trigrams(low: str) -> np.ndarray:
    """Numbers of the letter trigrams of a text, which is lower-cased."""
    if low.isascii():
        n = NUMBER_OF[np.frombuffer(low.encode(), np.uint8)]
    else:
        n = letter_numbers(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.int32)
    # a boundary before and after each word, whatever stands between words
    some = n > 0
    some[1:] |= some[:-1].copy()
    some[:1] = True
    n = n[some]
    return (n[:-2] * LETTERS + n[1:-1]) * LETTERS + n[2:]


def count_trigrams(docs: DataFrame, text_col: str) -> np.ndarray:
    """Letter trigrams of all texts; a table of LETTERS ** 3 numbers whatever the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, some = np.zeros(LETTERS**3, np.int64), False
        waiting, size = [], 0
        for batch in batches:
            for value in column(batch, text_col):
                text = value.as_py()
                for at in range(0, len(text or ""), 1 << 20):
                    some = True
                    waiting.append(_trigrams(text[max(0, at - 2) : at + (1 << 20)].lower()))
                    size += len(waiting[-1])
                    if size >= COUNTED:
                        cells += np.bincount(np.concatenate(waiting), minlength=LETTERS**3)
                        waiting, size = [], 0
        if waiting:
            cells += np.bincount(np.concatenate(waiting), minlength=LETTERS**3)
        if some:
            yield numbers_of_task(np.split(cells, PARTS))

    out = np.zeros((PARTS, LETTERS**3 // PARTS), np.int64)
    for part, total in added_up(docs.select(text_col).mapInArrow(run, NUMBERS), np.int64).items():
        out[part] = total
    return out.reshape(LETTERS, LETTERS, LETTERS)


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), backed off to bigrams and single letters."""
    c = counts.astype(float)
    one = (c.sum((0, 1)) + 1) / (c.sum() + LETTERS)
    two = (c.sum(0) + 20 * one) / (c.sum((0, 2))[:, None] + 20)
    return -np.log((c + 10 * two[None]) / (c.sum(2, keepdims=True) + 10))


class Restorer:
    """Viterbi decoding of disguised words."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    @staticmethod
    @lru_cache(1 << 16)
    def number(c: str) -> int:
        return int(letter_numbers(np.array([ord(c)], np.uint32))[0])

    def decode(self, written: str, spaces: bool = False) -> str:
        """Letters that the written characters most likely stand for; with `spaces`, white space may also stand for the end of a word."""
        costs, number = self.costs, self.number
        ends: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(0, 0): (0.0, None, "")}  # last two letters -> cost, letters as a chain, last character read
        first = next((k for k, c in enumerate(written) if c.isalnum()), len(written))
        final = next((k for k in range(len(written) - 1, -1, -1) if written[k].isalnum()), -1)
        for at, c in enumerate(written):
            if c not in IMITATES and c.isalpha():  # stands for itself, or repeats the letter before
                k, now = number(c), {}
                for (a, b), (cost, letters, last) in ends.items():
                    total = cost + costs[a][b][k]
                    key = (b, k)
                    if key not in now or total < now[key][0]:
                        now[key] = (total, (letters, c), c)
                    if last == c and letters and ((a, b) not in now or cost + REPEAT < now[a, b][0]):
                        now[a, b] = (cost + REPEAT, letters, last)
                ends = now
                continue
            arcs: list[tuple[str, float]] = []
            if c.isalpha():
                arcs.append((c, 0.0))
            elif c.isalnum():
                arcs.append((c, KEEP_SIGN))
            elif spaces and c == " ":
                arcs.append((c, 0.0))
            means = IMITATES.get(c, "")
            arcs += [(m, HIDE if len(means) > 2 else IMITATE) for m in means]
            edge = first >= at or final <= at
            silent = (EDGE if edge and means else 0.0 if edge else DROP) if not c.isalnum() and (c in SEPARATORS or edge or not means) else None
            now: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
            for (a, b), (cost, letters, last) in ends.items():
                row = costs[a][b]
                for m, extra in arcs:
                    k = number(m)
                    total = cost + extra + row[k]
                    key = (b, k)
                    if key not in now or total < now[key][0]:
                        now[key] = (total, (letters, m), m)
                # a repeat of the letter before, or a sign that stands for nothing
                skip = REPEAT if letters and any(m == last for m, _ in arcs) else silent
                if silent is not None and (skip is None or silent < skip):
                    skip = silent
                if skip is not None and ((a, b) not in now or cost + skip < now[a, b][0]):
                    now[a, b] = (cost + skip, letters, last)
            ends = now
        chain = min(((cost + costs[a][b][0], letters) for (a, b), (cost, letters, _) in ends.items()), key=lambda x: x[0])[1]
        out = []
        while chain:
            chain, m = chain
            out.append(m)
        return "".join(reversed(out))


#: Single characters with white space between, three of them at least.
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
TRIM = re.compile(r"^[\W_]+|[\W_]+$")
RUN = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1")
SIGNS = re.compile(r"[^\W\d_].*[\d\W_]|[\d@$!|+€£*(].*[^\W\d_]")


#: Signs that can stand for nothing only.
SILENT = ".,;:?\"')]"
#: Words of fewer letters are no whole words of a run, and white space doesn't break them up.
BEGIN = 4
#: First characters of a token that settle whether it can begin like a feature.
HEAD = 4


class Beginnings:
    """Can a written word stand for one that shows a feature? The lattice of Restorer.decode(), followed only as far as
    some feature begins so; no path that decode() may take is left out."""

    def __init__(self, wanted: Iterable[str]):
        wanted = set(wanted)
        self.whole = {f[1:] for f in wanted if f[0] == "="}
        self.leads = {f[1:] for f in wanted if f[0] == "^"}
        self.begun = {w[:k] for w in self.whole | self.leads for k in range(len(w) + 1)}

    def begins(self, written: str) -> bool:
        """May what begins so stand for a word that shows a feature?"""
        return self.walk(written) != set()

    def meets(self, written: str) -> bool:
        alive = self.walk(written)
        return alive is None or not alive.isdisjoint(self.whole)

    def walk(self, written: str) -> set[str] | None:
        """Beginnings of features that the written characters lead to; None if one of them is a feature of its own."""
        begun, leads, alive = self.begun, self.leads, {""}
        for c in written:
            means = (c if c.isalnum() else "") + IMITATES.get(c, "")
            now = set()
            for w in alive:
                for m in means:
                    longer = w + m
                    if longer in begun:
                        if longer in leads:
                            return None
                        now.add(longer)
                if not c.isalnum() or (w and w[-1] in means):  # a sign that stands for nothing, or a repeat
                    now.add(w)
            alive = now
            if not alive:
                break
        return alive


class Parts:
    """Spans of neighbouring tokens that together may stand for one of `wanted` words, each token for a letter at least.

    A walk from a token ends once no wanted word goes on, so it takes no more tokens than the longest such word has letters.
    """

    def __init__(self, wanted: Iterable[str]):
        self.whole = {f[1:] for f in wanted if f[0] == "=" and len(f) > BEGIN}
        self.begun = {w[:k] for w in self.whole for k in range(len(w) + 1)}
        self.first: dict[str, frozenset[str]] = {}
        self.leads: dict[tuple[str, str], bool] = {}

    def read(self, reached: set[str], token: str) -> set[str]:
        """Beginnings of wanted words that the lattice of a token leads to."""
        begun, bare = self.begun, token.rstrip(SILENT)
        if bare.isalpha() and not DOUBLE.search(bare):  # letters that stand for themselves; the first may be a repeat
            return {longer for w in reached if (longer := w + bare) in begun} | {longer for w in reached if w and w[-1] == bare[0] and (longer := w + bare[1:]) in begun}
        for c in bare:
            means = (c if c.isalnum() else "") + IMITATES.get(c, "")
            reached = {longer for w in reached for m in means if (longer := w + m) in begun} | {w for w in reached if not c.isalnum() or (w and w[-1] in means)}
            if not reached:
                break
        return reached

    def after(self, alive: Iterable[str], token: str) -> set[str]:
        """Those that are longer than what they came from."""
        return {w for came in alive for w in self.read({came}, token) if len(w) > len(came)}

    def opened(self, token: str) -> frozenset[str]:
        known = self.first.get(token)
        if known is None:
            if len(self.first) >= CACHE:
                self.first.clear()
            known = self.first[token] = frozenset(self.after(("",), token))
        return known

    def goes_on(self, token: str, start: str) -> bool:
        """May a token that opens a word be followed by one that starts so? Settles most neighbours without a walk."""
        known = self.leads.get((token, start))
        if known is None:
            if len(self.leads) >= CACHE:
                self.leads.clear()
            known = self.leads[token, start] = bool(self.read(set(self.opened(token)), start))
        return known

    def of(self, written: list[str], opens: set[str] | None = None) -> set[str]:
        """opens: those of the tokens that open a word, if known."""
        spans, opened = set(), self.opened
        if opens is None:
            opens = set(filter(opened, set(written)))
        if not opens:
            return spans
        known, goes_on = self.leads.get, self.goes_on
        for k in compress(range(len(written) - 1), map(opens.__contains__, written)):
            token, after = written[k], written[k + 1]
            # what can't go on with a first character can't with more, and few pairs of a token and a character differ
            if not (goes_on(*pair) if (may := known(pair := (token, after[:1]))) is None else may):
                continue
            if not (goes_on(*pair) if (may := known(pair := (token, after[:3]))) is None else may):
                continue
            alive, at = opened(token), k + 1
            while at < len(written) and (alive := self.after(alive, written[at])):
                at += 1
                # three and more single characters are a spaced run
                if not alive.isdisjoint(self.whole) and (at - k == 2 or any(len(w) > 1 for w in written[k:at])):
                    spans.add(" ".join(written[k:at]))
        return spans


class Words:
    """Restored words of texts; with `wanted` features, words that show none of them are left out (and disguised ones that
    can't are not decoded). With `parts`, words of these features that white space breaks up are found too."""

    def __init__(self, costs: np.ndarray, wanted: Iterable[str] | None = None, parts: bool = False):
        self.restorer = Restorer(costs)
        self.cache: dict[str, tuple[str, ...]] = {}
        self.all = wanted is None
        wanted = frozenset(wanted or ())
        self.whole, self.leads = ({f[1:] for f in wanted if f[0] == kind} for kind in "=^")
        beginnings = Beginnings(wanted)
        self.meets = (lambda _: True) if self.all else beginnings.meets
        self.begins = lru_cache(1 << 16)(beginnings.begins)
        self.parts = Parts(wanted) if parts else None
        self.spans: dict[str, str] = {}
        #: What is known of tokens: forms that show something, those that open a word, those of them that show nothing, and all others.
        self.shown: dict[str, tuple[str, ...]] = {}
        self.opens: set[str] = set()
        self.only_opens: set[str] = set()
        self.nothing: set[str] = set()

    def shows(self, word: str) -> bool:
        return word in self.whole or word[:4] in self.leads or word[:5] in self.leads

    def learn(self, token: str) -> None:
        """Notes forms of a token that show something, and whether it opens a word."""
        bare = token.rstrip(SILENT)
        if bare.isalpha() and not DOUBLE.search(bare):  # its only form; as what it may open, see Parts.read()
            shown = (bare,) if self.shows(bare) else ()
            opens = self.parts is not None and bare in self.parts.begun
        elif not self.begins(token[:HEAD]):  # no reading of it goes on, its own letters included
            shown, opens = (), False
        else:
            shown = tuple(filter(self.shows, self.forms(token)))
            opens = self.parts is not None and bool(self.parts.opened(token))
        if opens:
            self.opens.add(token)
        if shown:
            self.shown[token] = shown
        else:
            (self.only_opens if opens else self.nothing).add(token)

    def joined(self, span: str) -> str:
        """What a span of tokens stands for; empty if its likeliest reading keeps it apart."""
        known = self.spans.get(span)
        if known is None:
            if len(self.spans) >= CACHE:
                self.spans.clear()
            meant = self.restorer.decode(span, spaces=True)
            known = self.spans[span] = "" if " " in meant else meant
        return known

    def forms(self, token: str) -> tuple[str, ...]:
        """The token in lower case and without signs around it; decoded if it still shows a sign of disguise. A doubled
        letter may be meant: such a word comes as it is, and decoded too if that differs."""
        known = self.cache.get(token)
        if known is None:
            word = TRIM.sub("", token)
            known = (word,)
            if not word.isalpha() or RUN.search(word):
                core = token if len(word) < len(token) and any(c in "@$!|+€£(" for c in token[:1]) else word
                if SIGNS.search(core) or RUN.search(core):
                    known = (self.restorer.decode(core),) if self.meets(core) else ()
            elif DOUBLE.search(word) and self.meets(word) and (meant := self.restorer.decode(word)) != word:
                known = (word, meant)
            if self.all:  # else learn() keeps what it takes from this
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[token] = known
        return known

    def of(self, text: str | None) -> tuple[set[str], list[str]]:
        """Distinct restored words, and restored runs of spaced letters (which may hold several words)."""
        low = (text or "").lower()
        written, known = low.split(), self.cache.get
        if self.all:
            found = {f for w in set(written) for f in known(w) or self.forms(w)}
        else:
            if len(self.nothing) + len(self.opens) + len(self.shown) >= CACHE:  # never within a text
                for tokens in (self.nothing, self.opens, self.only_opens, self.shown):
                    tokens.clear()
            rest, found, shown = set(written).difference(self.nothing), set(), self.shown
            for w in rest.difference(self.only_opens):
                if w not in shown:
                    self.learn(w)
                if w in shown:
                    found.update(shown[w])
            if self.parts is not None:
                found |= {self.joined(span) for span in self.parts.of(written, rest.intersection(self.opens))}
        found.discard("")
        if b"\1\1\1" not in bytes(map((1).__eq__, map(len, written))):  # no three single characters in a row
            return found, []
        return found, [self.restorer.decode(" ".join(run.split())) for run in SPACED.findall(low) if any(c.isalpha() for c in run)]


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in (4, 5) if len(word) >= k)]


@dataclass
class Classifier:
    weights: dict[str, float]
    logit: np.ndarray
    cache: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        # within a spaced run; a word of fewer letters counts as a whole run only ('class' isn't 'ass')
        self.lengths = sorted({len(f) - 1 for f in self.weights if f[0] == "=" and len(f) > BEGIN})

    def strength(self, word: str) -> float:
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            known = self.cache[word] = max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
        return known

    def signs(self, words: set[str], runs: list[str]) -> list[float]:
        """How strongly and how often a text shows what toxic texts show."""
        found = [s for w in words if (s := self.strength(w)) > 0]
        for run in runs:
            inner = [self.weights.get(f"={run[a:a + n]}", 0.0) for n in self.lengths if n < len(run) for a in range(len(run) - n + 1)]
            found += [s for s in [self.strength(run), *inner] if s > 0]
        found.sort(reverse=True)
        top = [*found[:3], 0.0, 0.0, 0.0]
        return [1.0, top[0], top[1], top[2], min(sum(found), 60.0), float(np.log1p(len(found))), float(np.log1p(sum(s > 3 for s in found)))]

    def score(self, signs: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(signs, self.logit), -30, 30))))


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _train(rows: DataFrame, costs) -> Classifier:
    """rows: text, toxic, first. Weights from one part of a bounded sample (first), the regression from the other.

    What clean texts show is counted for the features of toxic ones only.
    """

    def shown(chosen: DataFrame, wanted: list[str] | None) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, keep, seen, n = Words(costs.value, wanted), None if wanted is None else set(wanted), Counter(), 0
            for batch in batches:
                for text in column(batch, "text"):
                    found, _ = words.of(text.as_py())
                    own = {f for w in found for f in features(w)}
                    seen.update(own if keep is None else own & keep)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([*seen, ""]), pa.array([*seen.values(), n], pa.int64())], ["feature", "n"])

        return chosen.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    learn = rows.where("first")
    toxic = {r["feature"]: r["n"] for r in shown(learn.where("toxic = 1"), None).where("n >= 3 OR feature = ''").collect()}
    n_toxic = toxic.pop("", 0)
    if not n_toxic:
        return Classifier({}, np.array([-3.0, 0, 0, 0, 0, 0, 0]))
    clean = {r["feature"]: r["n"] for r in shown(learn.where("toxic = 0"), list(toxic)).collect()}
    n_clean = clean.pop("", 0)
    sure = {}
    for f, t in toxic.items():
        c = clean.get(f, 0)
        w = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)) - np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if w > 0.8:
            sure[f] = float(w)
    model = Classifier({f: sure[f] for f in sorted(sure, key=lambda f: (-sure[f], f))[:FEATURES]}, np.zeros(7))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(costs.value, model.weights, parts=True)
        for batch in batches:
            found = [model.signs(*words.of(t.as_py())) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), column(batch, "toxic")], ["x", "toxic"])

    fit = rows.where("NOT first").select("text", "toxic").mapInArrow(signs, "x array<double>, toxic int").collect()
    if not fit:
        return model
    model.logit = fit_logit(np.array([r["x"] for r in fit]), np.array([r["toxic"] for r in fit], float))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score every text; labels are learnt from rows whose crc32(id as text) mod `modulus` is not `held`.

    Returns one row per row of docs: id_col, held_out, score (0 to 1), predicted (1 from 0.5 on). A null text counts as
    empty; empty texts get the score of a text that shows nothing. Labels other than 0 and 1, and rows without an id, teach
    nothing; an id with several labels teaches each. Without labels of toxic texts all scores are low. Repeated rows are scored
    each, an empty table gives an empty result; other columns are not read.

    SAMPLE + FIT_SAMPLE labelled rows at most (chosen by a hash of their id) fit the classifier; the character model counts
    all texts.
    """
    context = docs.sparkSession.sparkContext
    costs = context.broadcast(trigram_costs(count_trigrams(docs, text_col)))
    crc = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus == held
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~crc(F.col("id")))
    # chosen before they meet the texts, so no text is shuffled: SAMPLE + FIT_SAMPLE rows at most
    sample = stored(taught.orderBy(F.xxhash64("id"), "id", "toxic").limit(SAMPLE + FIT_SAMPLE), "labels")
    first = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SAMPLE + FIT_SAMPLE)) < SAMPLE
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").withColumn("first", first)
    model = context.broadcast(_train(rows, costs))
    discard(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = model.value
        words = Words(costs.value, classifier.weights, parts=True)
        for batch in batches:
            scores = [classifier.score(classifier.signs(*words.of(t.as_py()))) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [id_col, "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).alias("id"), crc(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
