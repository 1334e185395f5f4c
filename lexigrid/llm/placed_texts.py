"""Texts and what other tasks found out about places in them, brought together by document.

A document is known by (doc, tag): its id (null: last) and a hash of its text. Rows that have both alike are
one document: they get the same result. Texts travel compressed; facts are (doc, tag, kind, start, end).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, encode, mix, trimmed

LAST = 2**63 - 1


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """doc, tag, row, text; null texts are empty. row: the columns to carry along (the id alone if not given)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tag"), F.struct(*(docs[c] for c in carry or [id_col])).alias("row"), text.alias("text"))


def row_type(rows: DataFrame) -> str:
    """The type of row, for the schemas of functions that hand it on."""
    return rows.schema["row"].dataType.simpleString()


def row_array(rows: list[pa.Scalar]) -> pa.Array:
    return pa.array([r.as_py() for r in rows], rows[0].type)


def with_facts(rows: DataFrame, facts: DataFrame, use: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: str, packed: bool = False) -> DataFrame:
    """use() gets (doc, tag, row, bytes, {kind: int64 array of (start, stop)}) for each row, in order of documents; row is
    a scalar of Arrow's.

    rows: doc, tag, row and text, or body if packed, which is then handed on as it is. A row without facts gets an empty dict.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            body = pa.array([compress(encode(t.as_py())) for t in column(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), column(batch, "tag"), column(batch, "row"), body], ["doc", "tag", "row", "body"])

    kind = rows.schema["row"].dataType
    bodies = rows.select("doc", "tag", "row", "body") if packed else rows.mapInArrow(trimmed(pack), f"doc long, tag long, row {kind.simpleString()}, body binary")
    null = F.lit(None)
    both = facts.select("doc", "tag", "kind", "start", "stop", null.cast(kind).alias("row"), null.cast("binary").alias("body")).unionByName(
        bodies.select("doc", "tag", F.lit(LAST >> 32).cast("int").alias("kind"), null.cast("long").alias("start"), null.cast("long").alias("stop"), "row", "body")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return use(_documents(batches, bytes if packed else zstandard.ZstdDecompressor().decompress))

    return both.repartition("doc", "tag").sortWithinPartitions("doc", "tag", "kind", "start").mapInArrow(trimmed(run), schema)


def _documents(batches: Iterator[pa.RecordBatch], expand: Callable[[bytes], bytes]) -> Iterator[tuple]:
    """The facts of a document stand before its bodies (of which repeated rows have several)."""
    key, waiting, facts = None, [], {}
    for batch in batches:
        doc, tag, kind, start, stop = (column(batch, c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("doc", "tag", "kind", "start", "stop"))
        bodies, carried = column(batch, "body"), column(batch, "row")
        at = 0
        for k in np.flatnonzero(bodies.is_valid().to_numpy(zero_copy_only=False)).tolist():
            if k > at:
                waiting.append((kind[at:k], start[at:k], stop[at:k]))
            now = (int(doc[k]), int(tag[k]))
            if now != key:
                key, facts, waiting = now, _by_kind(waiting), []
            yield *now, carried[k], expand(bodies[k].as_py()), facts
            at = k + 1
        if at < len(doc):
            waiting.append((kind[at:], start[at:], stop[at:]))


def _by_kind(waiting: list) -> dict[int, np.ndarray]:
    if not waiting:
        return {}
    kind, start, stop = (np.concatenate(x) for x in zip(*waiting, strict=True))
    return {int(x): np.stack([start[kind == x], stop[kind == x]], 1) for x in np.unique(kind)}


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Places of n that lie in [s, s + length) for one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: What a task asks about strings by their hashes: rows for one occurrence each, if the task itself has seen more of it
#: (many), and apart from those (alive, dealt anywhere) all places of strings that the task has seen more than once.
ASKED = "h long, many int, alive int, doc long, tag long, pos long"


class Asking:
    """Strings of many texts. Of equal ones in a batch a single row is dealt by the hash, however common they are."""

    def __init__(self, places: bool):
        self.places, self.parts, self.size = places, [], 0

    def add(self, h: np.ndarray, doc: int, tag: int, pos: np.ndarray) -> None:
        if len(h):
            self.parts.append((h, np.full(len(h), doc, np.int64), np.full(len(h), tag, np.int64), pos.astype(np.int64)))
            self.size += len(h)

    def send(self) -> pa.RecordBatch:
        """With places, also all places of what is repeated here; else the first of equal strings is the one that counts."""
        h, doc, tag, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.argsort(h, kind="stable") if self.places else np.lexsort((tag, pos, doc, h))
        at = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        sizes = np.diff(np.append(at, len(h)))
        many = np.zeros(len(h), np.int32)
        many[order[at]] = sizes > 1
        ask = np.sort(order[at])  # as they came: neighbours share their document, which packs well
        own = np.sort(order[np.repeat(sizes > 1, sizes)]) if self.places else ask[:0]
        anywhere = mix(pos[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ doc[own].view(np.uint64)).view(np.int64)
        rows = np.concatenate([ask, own])
        alive = np.repeat(np.array([0, 1], np.int32), [len(ask), len(own)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[ask].view(np.int64), anywhere])), pa.array(np.where(alive == 1, 0, many[rows]).astype(np.int32)), pa.array(alive), pa.array(doc[rows]), pa.array(tag[rows]), pa.array(pos[rows])], [c.split()[0] for c in ASKED.split(", ")])


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns cut so that equal values of the first one (sorted) stay together."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        now = [column(batch, c).to_numpy(zero_copy_only=False) for c in names]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        if last == 0 and kept and kept[-1][0][-1] == now[0][0]:
            kept.append(now)
            continue
        whole = [np.concatenate(x) for x in zip(*kept, [c[:last] for c in now], strict=True)]
        if len(whole[0]):
            yield whole
        kept = [[c[last:] for c in now]]
    if kept:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _facts(places: DataFrame, kind: int) -> DataFrame:
    return places.select("doc", "tag", F.lit(kind).alias("kind"), F.col("pos").alias("start"), F.col("pos").alias("stop"))


def repeated_places(asked: DataFrame, kind: int) -> DataFrame:
    """Facts of that kind: the places whose string stands anywhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, many, alive, *place in whole_runs(batches, [c.split()[0] for c in ASKED.split(", ")]):
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            again = np.repeat(np.diff(np.append(starts, len(h))) > 1, np.diff(np.append(starts, len(h))))
            keep = (alive == 1) | (again & (many == 0))  # where many is set, the places are among those alive
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in place], ["doc", "tag", "pos"])

    return _facts(asked.repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(run), "doc long, tag long, pos long"), kind)


def first_places(asked: DataFrame, kind: int) -> DataFrame:
    """Facts of that kind: the first place (by document, then place) of each string, also of those that are alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, *place in whole_runs(batches, ["h", "doc", "tag", "pos"]):
            keep = np.concatenate([[True], h[1:] != h[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in place], ["doc", "tag", "pos"])

    return _facts(asked.repartition("h").sortWithinPartitions("h", "doc", "pos", "tag").mapInArrow(trimmed(run), "doc long, tag long, pos long"), kind)


#: Kinds of facts about texts that stand more than once: a copy of the first one, and the first one itself.
COPY, REPEATED = 1, 2


def copies(rows: DataFrame) -> DataFrame:
    """Of documents with equal texts: that the first one repeats, and that the others are its copies."""
    same = rows.select("doc", "tag", F.xxhash64(F.lit(1), "text").alias("more"), F.octet_length("text").alias("bytes"))
    groups = same.groupBy("tag", "more", "bytes").agg(F.count("*").alias("n"), F.min("doc").alias("least")).where("n > 1")
    found = same.join(groups, ["tag", "more", "bytes"]).select("doc", "tag", F.when(F.col("doc") == F.col("least"), REPEATED).otherwise(COPY).alias("kind"))
    return found.distinct().select("doc", "tag", "kind", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))
