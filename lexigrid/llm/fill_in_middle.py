"""Fill-in-middle transformation: texts cut at two units into prefix, middle and suffix, which change places.

A unit is a run of ASCII letters or one other code point. One Aho-Corasick automaton finds the places where that class changes
(pairs of a letter and an ASCII non-letter, in either order) and the sentinels; every code point beyond ASCII stands as one
replacement character while it searches. Between two such events all characters are of one class, so a gap is one unit if
they are letters, else as many as it is long. Units up to every event follow by arithmetic, and a cut is looked up by rank
among the events; no character between them is visited one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, encode, texts

#: What begins prefix, suffix and middle.
SENTINELS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters that one search goes over, so that the events of a very long text are never all held as Python objects.
SPAN = 1 << 20


@cache
def automaton():
    """Sentinels have the value -1, pairs of characters of two classes 1."""
    import ahocorasick

    found = ahocorasick.Automaton()
    others = [c for c in map(chr, range(128)) if c not in ascii_letters]
    for a in ascii_letters:
        for b in others:
            found.add_word(a + b, 1)
            found.add_word(b + a, 1)
    for s in SENTINELS:
        found.add_word(s, -1)
    found.make_automaton()
    return found


class Units:
    """Units of one text: how many there are, and after how many code points so many of them end."""

    def __init__(self, text: str):
        plain = text.encode("ascii", "replace").decode("ascii")
        search, parts = automaton().iter, []
        for at in range(0, len(plain), SPAN):
            low = max(0, at - 2)  # an event that ends in this span may begin before it
            # the end of each event; that of a sentinel, at least 2, as a negative number
            ends = np.fromiter((end * kind for end, kind in search(plain[low : at + SPAN])), np.int64)
            place = np.abs(ends) + low
            parts.append(np.where(ends < 0, -place, place)[place >= at])
        events = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.marked = bool((events < 0).any())
        #: first character of each run of one class, and the end of the text
        self.edges = np.concatenate(([0], events[events > 0], [len(plain)]))
        letters = (np.arange(len(self.edges) - 1) + (plain[:1] not in ascii_letters)) % 2 == 0
        units = np.where(letters, 1, np.diff(self.edges)) if plain else np.zeros(1, np.int64)
        self.letters, self.before = letters, np.concatenate(([0], np.cumsum(units)))
        self.n = int(self.before[-1])

    def end_of(self, units: int) -> int:
        """Code points that the first so many units take."""
        if not units:
            return 0
        k = int(np.searchsorted(self.before, units)) - 1  # the run in which the last of them ends
        return int(self.edges[k + 1]) if self.letters[k] else int(self.edges[k] + units - self.before[k])


@dataclass(frozen=True)
class Rates:
    """Of a hundred documents, how many are transformed, and how many of those begin with the suffix."""

    transformed: int = 90
    suffix_first: int = 20
    seed: str = "1"


def chosen(doc_id, seed: str) -> tuple[int, ...]:
    """Four numbers from the hash of a document's id; a null id counts as an empty one."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in range(0, 32, 8))


def transformed(doc_id, text: str | None, rates: Rates) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    text = text or ""
    units = Units(text)
    a, b, c, d = chosen(doc_id, rates.seed)
    if not text or units.marked or c % 100 >= rates.transformed:
        return units.n, "plain", None, None, text
    first, last = sorted((a % (units.n + 1), b % (units.n + 1)))
    low, high = units.end_of(first), units.end_of(last)
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if d % 100 < rates.suffix_first:
        return units.n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that transformed() made the output of. No part holds a sentinel, so the first of each kind is the one put there."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, middle = output[len(first) :].split(MIDDLE, 1)
    one, other = head.split(second, 1)
    return one + middle + other if form == "psm" else other + middle + one


_COUNTS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]


def _per_document(docs: DataFrame, rates: Rates, id_col: str, text_col: str, names: list[str], finish) -> DataFrame:
    picked = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, id_col)
            # each output is finished before the next text is read
            rows = [(*(r := transformed(i.as_py(), t, rates))[:4], *finish(r[4], r[1])) for i, t in zip(ids, texts(batch, text_col), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(names))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *made], [id_col, *(f.name for f in _COUNTS), *names])

    return picked.mapInArrow(run, T.StructType([picked.schema[id_col], *_COUNTS, *(T.StructField(x, T.StringType()) for x in names)]))


def fill_in_middle(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n (units), form (plain, psm, spm), prefix_chars and middle_chars (code points, null if plain), output.

    Where a text is cut, and into which form, follows from a hash of its id alone, so repeated rows give repeated results
    and a task that runs again gives the same ones. Null and empty texts are plain and empty, and so are, as they are, texts that
    hold a sentinel; a null id counts as an empty one. Texts of any length are cut where they are read, nothing is shuffled;
    a text's events take 8 bytes each. Other columns, clashing names included, are not read; an empty table gives an empty one.
    """
    return _per_document(docs, rates, id_col, text_col, ["output"], lambda output, form: (output,))


def restore_texts(outputs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and text, from the output and form of fill_in_middle(). A null output stays null; a null form counts as plain."""
    picked = outputs.select(id_col, "output", "form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [x and restored(x, form or "plain") for x, form in zip(texts(batch, "output"), texts(batch, "form"), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(back, pa.string())], [id_col, "text"])

    return picked.mapInArrow(run, T.StructType([picked.schema[id_col], T.StructField("text", T.StringType())]))


def digest_outputs(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As fill_in_middle(), with output_sha256 and restored_sha256 (of the text that restored() makes of output and form) in place of the output."""

    def digest(text: str) -> str:
        return hashlib.sha256(encode(text)).hexdigest()

    return _per_document(docs, rates, id_col, text_col, ["output_sha256", "restored_sha256"], lambda output, form: (digest(output), digest(restored(output, form))))
