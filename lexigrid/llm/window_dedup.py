"""Substring dedup by level-wise doubling of word windows.

A window of `window` words survives a level if the shorter window chosen in it is repeated somewhere; only the
survivors are looked at on the next level, with windows of twice that length, until the full length is reached
or none is left. The shorter window chosen is the one of least hash inside the longer one, so equal longer
windows choose equal shorter ones, and about one in (window - length) / 2 of the shorter ones is sent at all.

A level sends back what is repeated (most documents' own words never go further). On the last level the first
occurrence of each window goes back, and every other one is removed. Texts that equal an earlier one as a whole
need no windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stored
from .placed_texts import ASKED, COPY, Asking, copies, covered, first_places, keyed, repeated_places, row_array, row_type, with_facts
from .shingles import join_hashes, slices, word_hashes

#: Windows gathered before equal ones among them are sent once, and the kind of the facts about first occurrences.
GATHER, FIRST = 500_000, 0


class Survivors:
    """Windows of one text that no level has dropped."""

    def __init__(self, words: np.ndarray, window: int):
        self.words, self.window = words, window
        self.alive = np.arange(max(0, len(words) - window + 1))

    def chosen(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shorter windows at all places, and the place chosen in each survivor."""
        h = join_hashes(self.words, length)
        if not len(self.alive):
            return h, self.alive
        # rolling the bits differently from the shuffle key keeps the choice apart from the dealing
        inside = np.lib.stride_tricks.sliding_window_view(h ^ np.uint64(0x5851F42D4C957F2D), self.window - length + 1)[self.alive]
        return h, self.alive + inside.argmin(1)

    def keep(self, length: int, repeated: np.ndarray) -> None:
        _, place = self.chosen(length)
        self.alive = self.alive[np.isin(place, repeated)]


def _first_windows(batches: Iterator[pa.RecordBatch], window: int, length: int) -> Iterator[pa.RecordBatch]:
    out = Asking(places=length < window)
    for batch in batches:
        docs, tags = column(batch, "doc").to_numpy(), column(batch, "tag").to_numpy()
        for low, _, data, offsets in slices(column(batch, "text")):
            w, first = word_hashes(data, offsets, lower=False)
            for row in range(len(offsets) - 1):
                s = Survivors(w[first[row] : first[row + 1]], window)
                if len(s.alive):
                    h, place = s.chosen(length)
                    place = np.unique(place)
                    out.add(h[place], int(docs[low + row]), int(tags[low + row]), place)
            if out.size > GATHER:
                yield out.send()
    if out.size:
        yield out.send()


def dedup_windows(docs: DataFrame, window: int = 20, start: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of words that also starts earlier (in a document of smaller id, or
    earlier in the same one).

    window must be start times a power of two. Returns one row per row of docs: id_col, n_words, n_removed,
    kept (the kept words joined by one space), kept_sha256. Words are [^\\x20\\x09-\\x0D]+, unchanged; a null text has none.
    Null ids come after all others. Rows with the same id and text are one document, so none of them is
    removed for the other; rows with the same id and other texts are ordered by the place, then by their texts' hashes.
    An empty table gives an empty result; other columns are not read.
    """
    levels = [start]
    while levels[-1] < window:
        levels.append(2 * levels[-1])
    if levels[-1] != window or start < 1:
        raise ValueError("the window must be the starting length times a power of two")
    rows = keyed(docs, id_col, text_col)

    def begin(batches):
        return _first_windows(batches, window, start)

    found = rows.select("doc", "tag", "text").mapInArrow(begin, ASKED)
    facts = copies(rows).unionByName(_answers(found, start, window))
    for k, length in enumerate(levels[1:], 1):
        facts = stored(facts, "windows")
        found = with_facts(rows, facts, _next_windows(levels[:k], length, window), ASKED)
        facts = facts.unionByName(stored(_answers(found, length, window), "windows"))
    out = with_facts(rows, facts, _apply(levels[:-1], window), f"row {row_type(rows)}, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.select(F.col("row")[id_col].alias(id_col), "n_words", "n_removed", "kept", "kept_sha256")


def _answers(found: DataFrame, length: int, window: int) -> DataFrame:
    return first_places(found, FIRST) if length == window else repeated_places(found, length)


def _survivors(raw: bytes, facts: dict, levels: list[int], window: int) -> Survivors:
    s = Survivors(word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)[0], window)
    for length in levels:
        if len(s.alive):
            s.keep(length, facts[length][:, 0] if length in facts else np.zeros(0, np.int64))
    return s


def _next_windows(levels: list[int], length: int, window: int):
    def use(documents):
        out = Asking(places=length < window)
        for doc, tag, _, raw, facts in documents:
            if COPY in facts:
                continue
            s = _survivors(raw, facts, levels, window)
            if len(s.alive):
                h, place = s.chosen(length)
                place = np.unique(place)
                out.add(h[place], doc, tag, place)
            if out.size > GATHER:
                yield out.send()
        if out.size:
            yield out.send()

    return use


def _apply(levels: list[int], window: int):
    def use(documents):
        rows, size = [], 0
        for _, _, row, raw, facts in documents:
            words = raw.split()
            if COPY in facts:  # all its windows start earlier
                gone = np.full(len(words), len(words) >= window)
            else:
                s = _survivors(raw, facts, levels, window)
                later = np.setdiff1d(s.alive, facts[FIRST][:, 0] if FIRST in facts else [])
                gone = covered(len(words), later, window)
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            rows.append((row, len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            size += len(kept)
            if size > 1 << 22 or len(rows) >= 4096:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)

    return use


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([row_array([r[0] for r in rows]), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1))], ["row", "n_words", "n_removed", "kept", "kept_sha256"])
