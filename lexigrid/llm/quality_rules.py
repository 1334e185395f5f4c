"""Quality rules with compression bands.

A base of plain counts (words, repeated five-word windows) and the method's verdict: the ratio of
zstandard-compressed to raw bytes, over the whole document and over fixed chunks of it, must lie in a
band that depends on the length. Below the band a text repeats itself; above it, it is incompressible.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, encode, texts, trimmed

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / raw bytes.

    whole: (least bytes, lowest ratio, highest ratio), by length; short texts carry the frame's own bytes,
    so their limits are wide. A text shorter than the first entry has no band.
    chunk: the same limits for every full chunk of chunk_bytes, in texts of more than one; what is left at the end is a chunk
    with the limits for whole texts of its length. A document fails by its chunks if bad_share of them or more lie outside.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.30, 1.05),
        (256, 0.22, 0.95),
        (512, 0.20, 0.80),
        (1024, 0.18, 0.74),
        (4096, 0.15, 0.70),
        (32768, 0.12, 0.70),
        (262144, 0.08, 0.70),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.15, 0.70)
    bad_share: float = 0.5
    level: int = 3


def repeated_words(items: list[bytes]) -> int:
    """Words covered by five-word windows that occur twice or more (the first occurrence included)."""
    n = len(items) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in items), np.int64, len(items))
    if len(number) == len(items):
        return 0
    key, span = codes[:n], len(number)
    for j in range(1, WINDOW):
        if span > 2**62 // len(number):
            _, key = np.unique(key, return_inverse=True)
            span = int(key.max()) + 1
        key = key * len(number) + codes[j : j + n]
        span *= len(number)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(items) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()]
    return len(lines) - len(set(lines))


class Rater:
    """Counts, ratios and verdicts of single texts."""

    def __init__(self, bands: Bands):
        self.bands = bands
        self.packer = zstandard.ZstdCompressor(level=bands.level)
        self.starts = [b[0] for b in bands.whole]

    def ratio(self, raw: bytes | memoryview) -> float:
        return len(self.packer.compress(raw)) / len(raw)

    def inside(self, ratio: float, length: int) -> bool:
        """Is it within the band for texts of that length?"""
        _, low, high = self.bands.whole[bisect_right(self.starts, length) - 1]
        return low <= ratio <= high

    def verdict(self, raw: bytes) -> tuple[float | None, int, int, bool]:
        """Ratio of the whole text, chunks rated, chunks outside their band, and if the bands accept it."""
        k = bisect_right(self.starts, len(raw)) - 1
        if k < 0:
            return (self.ratio(raw) if raw else None), 0, 0, True
        whole = self.ratio(raw)
        fits = self.inside(whole, len(raw))
        size, (least, most) = self.bands.chunk_bytes, self.bands.chunk
        view = memoryview(raw)
        n = bad = 0
        for at in range(0, len(raw) - size + 1, size):
            n += 1
            bad += not least <= self.ratio(view[at : at + size]) <= most
        rest = len(raw) % size if n else 0
        if rest >= self.starts[0]:
            n += 1
            bad += not self.inside(self.ratio(view[-rest:]), rest)
        return whole, n, bad, fits and (not bad or bad < self.bands.bad_share * n)

    def rate(self, text: str | None) -> tuple:
        text = text or ""
        raw = encode(text)
        items = raw.split()
        n = len(items)
        chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        repeats = repeated_words(items)
        failed = n < 10 or 100 * repeats > 20 * n
        whole, chunks, bad, fits = self.verdict(raw)
        return n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, not failed and fits, whole, chunks, bad


FIELDS = (
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("kept", T.BooleanType(), pa.bool_()),
    ("whole_ratio", T.DoubleType(), pa.float64()),
    ("n_chunks", T.LongType(), pa.int64()),
    ("n_bad_chunks", T.LongType(), pa.int64()),
)


def rate_documents(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, the base counts, base_failed, kept, whole_ratio, n_chunks, n_bad_chunks.

    A null text counts as none: no words, base_failed, not kept, whole_ratio null. Repeated rows give
    repeated results, an empty table an empty one; other columns, clashing names included, are not read.
    No shuffle: each text is rated where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rater = Rater(bands)
        for batch in batches:
            rows = [rater.rate(t) for t in texts(batch, text_col)]
            made = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([column(batch, id_col), *made], [id_col, *(f[0] for f in FIELDS)])

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(trimmed(run), T.StructType([picked.schema[id_col], *(T.StructField(n, t) for n, t, _ in FIELDS)]))


def keep_documents(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows of docs that rate_documents() keeps, with all their columns, whatever their names. Null and empty texts go;
    repeated rows share their fate; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rater = Rater(bands)
        for batch in batches:
            yield batch.filter(pa.array([rater.rate(t)[6] for t in texts(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
