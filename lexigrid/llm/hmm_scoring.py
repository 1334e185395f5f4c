"""Language-model scores by a hidden Markov model.

Training counts every word of the training texts (exact, by a shuffle). The commonest words and the end of a text
have emission rows of their own; all other words are one class for the states and share its probability in
proportion to the base model, so the table of the model is bounded while every word keeps an exact probability.

Baum-Welch: each task runs forward and backward over its whole texts with the present model and sends expected counts
per state; the sums make the next model. Scoring runs the scaled forward recursion over whole texts: the sum of the
logarithms of the scales is the exact log likelihood.

Long texts are run over in stretches, all at once: the product of the (scaled) matrices of an inner stretch carries the forward
vector over it, and the backward vector back, so every stretch begins and ends with what the whole text gives there.

The base model, sum over tokens of log10((c + 1) / (N + V + 1)), is the prior of all emissions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBERS, added_up, column, discard, encode, numbers_of_task, stored
from .placed_texts import LAST

END = b" "  # never a word
#: Words whose counts a task keeps before it sends them.
GATHER = 400_000
#: Tokens that a task runs over together (a longer text alone), and the longest stretch. Results don't depend on either.
TOKENS, STRETCH = 256_000, 1024
#: Steps between two scalings (a probability of 1e-30 at each would still fit), and matrices that are multiplied together.
SCALED, TOGETHER = 8, 64


#: Words beyond the common ones that a task of _coded() holds before it sends them.
RARE = 50_000


@dataclass(frozen=True)
class Settings:
    states: int = 16
    words: int = 20_000
    rounds: int = 6
    #: Tokens that the base model counts for in the emissions of a state.
    prior: float = 200.0
    stay: float = 0.8
    seed: int = 7


@dataclass
class Model:
    start: np.ndarray  # of a text
    step: np.ndarray
    emit: np.ndarray  # words and the class of other words x states


def tokens(text: str | None) -> list[bytes]:
    return [*encode(text).lower().split(), END]


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """word, n: how often each token stands in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for value in column(batch, text_col):
                counts.update(tokens(value.as_py()))
                if len(counts) > GATHER:
                    yield send()
                    counts = Counter()
        if counts:
            yield send()

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _coded(rows: DataFrame, shared) -> DataFrame:
    """Each text as numbers of common words (the last number: another word), and its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        other = len(number)
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at, n, ids, words, times, ends = 0, [], [], [], [], [0]
            for k, value in enumerate(column(batch, "text"), 1):
                t = tokens(value.as_py())
                code = np.fromiter(map(number.get, t, repeat(other)), np.uint32, len(t))
                n.append(len(t)), ids.append(pack(code.tobytes()))
                rare = Counter(filterfalse(number.__contains__, t))
                words.extend(rare), times.extend(rare.values()), ends.append(len(words))
                # a batch's other words are sent in parts, so that they are never all held
                if len(words) >= RARE or k == batch.num_rows:
                    pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "times"])
                    made = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
                    yield pa.RecordBatch.from_arrays([column(batch, "id")[at:k], column(batch, "held_out")[at:k], *made], ["id", "held_out", "n_tokens", "ids", "rare"])
                    at, n, ids, words, times, ends = k, [], [], [], [], [0]

    schema = "id long, held_out boolean, n_tokens long, ids binary, rare array<struct<word:binary,times:bigint>>"
    return rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32).astype(np.int64)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


class Stretches:
    """Texts cut into stretches, ordered by falling length so that all take a step together."""

    def __init__(self, sequences: list[np.ndarray]):
        pieces = np.array([-(-len(s) // STRETCH) for s in sequences])
        self.first = np.cumsum([0, *pieces])  # stretch of each text, in the order of texts
        text = np.repeat(np.arange(len(sequences)), pieces)
        self.flat = np.concatenate(sequences)
        starts = np.cumsum([0, *(len(s) for s in sequences)])
        self.begin = starts[text] + (np.arange(len(text)) - self.first[text]) * STRETCH
        self.length = np.minimum(starts[text + 1] - self.begin, STRETCH)
        self.order = np.argsort(-self.length, kind="stable")
        self.text, self.inside = text, self.begin > starts[text]
        self.left = self.steps(self.order)
        self.at = [self.flat[self.begin[self.order[:m]] + t] for t, m in enumerate(self.left)]

    def steps(self, order: np.ndarray) -> list[int]:
        """How many of these stretches (by falling length) take each step."""
        length = self.length[order]
        return np.searchsorted(-length, -np.arange(int(length[0])), "left").tolist() if len(order) else []

    def ends(self, model: Model, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch, in its order: the state's distribution before it, and (backward) the scaled weights of what follows it."""
        n, k = len(self.begin), len(model.start)
        before, after = np.ones((n, k)), np.ones((n, k))
        head = self.first[:-1][np.diff(self.first) > 1]
        tail = self.first[1:][np.diff(self.first) > 1] - 1
        if len(head):
            a = _scaled(model.start * model.emit[self.flat[self.begin[head]]])
            for t in range(1, STRETCH):
                a = (a @ model.step) * model.emit[self.flat[self.begin[head] + t]]
                if t % SCALED == 0:
                    a = _scaled(a)
            before[head + 1] = _scaled(a)
            inner = np.concatenate([np.arange(a + 1, b) for a, b in zip(head.tolist(), tail.tolist(), strict=True)])
            product = np.empty((len(inner), k, k))
            for low in range(0, len(inner), TOGETHER):
                x = self.begin[inner[low : low + TOGETHER]]
                p = model.step * model.emit[self.flat[x]][:, None, :]
                for t in range(1, STRETCH):
                    p = (p.reshape(-1, k) @ model.step).reshape(-1, k, k)
                    p *= model.emit[self.flat[x + t]][:, None, :]
                    if t % SCALED == 0:
                        p = _scaled(p)
                product[low : low + TOGETHER] = _scaled(p)
            number = np.full(n, -1)
            number[inner] = np.arange(len(inner))
            for j in range(1, int((tail - head).max())):  # from the j-th stretch of each text to the next
                on = head[tail - head > j] + j
                before[on + 1] = _scaled(np.einsum("ni,nij->nj", before[on], product[number[on]]))
            if backward:
                order = tail[np.argsort(-self.length[tail], kind="stable")]
                b = np.ones((len(order), k))
                for t, m in reversed(list(enumerate(self.steps(order)))):
                    b[:m] = (model.emit[self.flat[self.begin[order[:m]] + t]] * b[:m]) @ model.step.T
                    if t % SCALED == 0:
                        b[:m] = _scaled(b[:m])
                after[order - 1] = b
                for j in range(1, int((tail - head).max())):
                    on = tail[tail - head > j] - j
                    after[on - 1] = _scaled(np.einsum("nij,nj->ni", product[number[on]], after[on]))
        return before[self.order], after[self.order]

    def forward(self, model: Model, before: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list, np.ndarray]:
        """Forward vectors and emissions step by step, the scales where vectors were scaled, and log10 likelihoods of the texts."""
        vectors, emits, scales, ones = [], [], [], np.ones(len(model.start))
        logs = np.zeros(len(before))
        a = np.where(self.inside[self.order][:, None], before @ model.step, model.start)
        for t, m in enumerate(self.left):
            e = model.emit[self.at[t]]
            a = (a[:m] @ model.step if t else a) * e
            scale = None
            if t % SCALED == SCALED - 1:
                scale = a @ ones
                a = a / scale[:, None]
                logs[:m] += np.log10(scale)
            vectors.append(a), emits.append(e), scales.append(scale)
            on = self.left[t + 1] if t + 1 < len(self.left) else 0
            if on < m:  # stretches that end here
                logs[on:m] += np.log10(a[on:].sum(1))
        return vectors, emits, scales, np.bincount(self.text[self.order], logs, minlength=len(self.first) - 1)


def log_likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the probability of each sequence (all have a token), by the scaled forward recursion."""
    s = Stretches(sequences)
    return s.forward(model, s.ends(model, False)[0])[-1]


def expected_counts(sequences: list[np.ndarray], model: Model, counts: Model) -> float:
    """Add the expected counts of the sequences. Returns their log10 likelihood."""
    s = Stretches(sequences)
    before, after = s.ends(model, True)
    ahead, emits, scales, logs = s.forward(model, before)
    inside = s.inside[s.order]
    back, k = np.empty((0, len(model.start))), len(model.start)
    steps, gammas, ones = np.zeros((k, k)), [None] * len(s.left), np.ones((k, 1))
    for t in range(len(s.left) - 1, -1, -1):
        m = s.left[t]
        if len(back) < m:  # stretches that end here
            back = np.concatenate([back, after[len(back) : m]])
        gamma = ahead[t] * back
        whole = gamma @ ones
        gamma /= whole
        gammas[t] = gamma
        follows = emits[t] * back
        follows /= whole if scales[t] is None else whole * scales[t][:, None]
        if t:
            steps += ahead[t - 1][:m].T @ follows
            # in proportion to the vector of what follows: the next step divides by its own sum
            back = follows @ model.step.T
        elif inside.any():  # the step from the stretch before
            steps += before[inside].T @ follows[inside]
    counts.step += model.step * steps
    counts.start += gammas[0][~inside].sum(0)
    where, gamma = np.concatenate(s.at), np.concatenate(gammas)
    for state in range(k):
        counts.emit[:, state] += np.bincount(where, gamma[:, state], minlength=len(counts.emit))
    return float(logs.sum())


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows of about TOKENS tokens together."""
    rows, size = [], 0
    for batch in batches:
        cols = [column(batch, c) for c in names]
        for k in range(batch.num_rows):
            row = tuple(c[k].as_py() for c in cols)
            ids = _ids(row[0])
            rows.append((ids, *row[1:]))
            size += len(ids)
            if size >= TOKENS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


#: Rows of the emission table that are summed together.
SLICE = 1024


def _round(coded: DataFrame, shared, states: int, height: int) -> tuple[Model, float]:
    """One round of Baum-Welch counts over all training texts."""
    pieces = -(-height // SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counts = Model(np.zeros(states), np.zeros((states, states)), np.zeros((height, states)))
        total, some = 0.0, False
        for rows in _grouped(batches, ["ids"]):
            some = True
            total += expected_counts([ids for (ids,) in rows], model, counts)
        if some:
            yield numbers_of_task([np.concatenate([counts.start, counts.step.ravel(), [total]]), *(counts.emit[a : a + SLICE].ravel() for a in range(0, height, SLICE))])

    sums = added_up(coded.select("ids").mapInArrow(run, NUMBERS), np.float64)
    if not sums:
        return Model(np.zeros(states), np.zeros((states, states)), np.zeros((height, states))), 0.0
    start, step = sums[0][:states], sums[0][states : states + states**2].reshape(states, states)
    return Model(start, step, np.concatenate([sums[k + 1].reshape(-1, states) for k in range(pieces)])), float(sums[0][-1])


def _normal(counts: Model, base: np.ndarray, prior: float) -> Model:
    """Probabilities of the counts; base: the base model's probabilities of the emission rows."""
    start = counts.start + 1.0
    step = counts.step + 1.0
    emit = counts.emit + prior * base[:, None]
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _begin(base: np.ndarray, s: Settings) -> Model:
    """Sticky steps, and emissions that tilt the base model differently for each state."""
    rnd = np.random.default_rng(s.seed)
    emit = base[:, None] * np.exp(rnd.normal(0, 1.0, (len(base), s.states)))
    step = np.full((s.states, s.states), (1 - s.stay) / max(1, s.states - 1))
    np.fill_diagonal(step, s.stay if s.states > 1 else 1.0)
    return Model(np.full(s.states, 1 / s.states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def train(coded: DataFrame, base: np.ndarray, s: Settings) -> tuple[Model, list[float]]:
    """The model after s.rounds rounds, and the log10 likelihood of the training texts before each."""
    model, seen = _begin(base, s), []
    context = coded.sparkSession.sparkContext
    for _ in range(s.rounds):
        shared = context.broadcast(model)  # (s.words + 2) x s.states numbers, whatever the corpus
        counts, total = _round(coded, shared, s.states, len(base))
        model = _normal(counts, base, s.prior)
        seen.append(total)
        shared.unpersist()
    return model, seen


def score_documents(docs: DataFrame, settings: Settings = Settings(), modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text with a model of those whose crc32(id as text) mod `modulus` is not `held`.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end. Returns one row per row of docs: id_col,
    held_out, n_tokens, n_known (tokens that training has), train_tokens (N), base_score, score (both log10).
    Words that training lacks share the base model's 1 / (N + V + 1), in both scores.

    A null text is empty: its one token is the end. A null id counts as the empty text, which is for training. Repeated rows
    are scored, and counted, each; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    number = docs[id_col].cast("long")
    crc = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(number.alias("id"), (crc % modulus == held).alias("held_out"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    counts = stored(count_words(rows.where(~F.col("held_out")), "text"), "words")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(settings.words).collect()  # bounded
    ends = counts.where(F.col("word") == F.lit(END)).select("n").first()
    words = [END, *(bytes(r["word"]) for r in top)]
    known = np.array([ends["n"] if ends else 0, *(r["n"] for r in top)], float)
    rest_mass = (total - known.sum()) + (kinds - int((known > 0).sum())) + 1.0  # counts plus one of all other words, and of the unknown one
    base = np.append(known + 1.0, rest_mass) / (total + kinds + 1.0)
    base /= base.sum()
    other = len(words)

    coded = stored(_coded(rows, spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})), "coded")
    model, _ = train(coded.where(~F.col("held_out")), base, settings)
    final = spark.sparkContext.broadcast((model, np.log10((known + 1.0) / (total + kinds + 1.0)), known > 0, float(np.log10(base[-1]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, logs, seen, other_log = final.value
        for group in _grouped(batches, ["ids", "row", "id", "held_out"]):
            score = log_likelihoods([g[0] for g in group], best)
            plain, hits, rare = [], [], []
            for ids, *_ in group:
                common = ids[ids != other]
                plain.append(float(logs[common].sum())), hits.append(int(seen[common].sum())), rare.append(len(ids) - len(common))
            cols = [pa.array([g[k] for g in group], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.bool_()))]
            cols += [pa.array([len(g[0]) for g in group], pa.int64()), pa.array(hits, pa.int64()), pa.array(plain), pa.array(score - np.array(rare) * other_log)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "id", "held_out", "n_tokens", "hits", "plain", "states"])

    scored = coded.select("ids", "row", "id", "held_out").mapInArrow(run, "row long, id long, held_out boolean, n_tokens long, hits long, plain double, states double")
    log = F.log10((F.coalesce("n", F.lit(0)) + 1.0) / F.lit(float(total + kinds + 1)))
    rare = coded.select("row", F.inline("rare")).join(counts, "word", "left").groupBy("row").agg(F.sum(log * F.col("times")).alias("rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    extra = F.coalesce("rare_log", F.lit(0.0))
    out = scored.join(rare, "row", "left")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", (F.col("hits") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("plain") + extra).alias("base_score"), (F.col("states") + extra).alias("score"))
