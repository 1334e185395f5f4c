"""Exact substring dedup by suffix arrays over the parts of the corpus that can repeat.

1. Every `length`-byte string is looked at through one shorter `key` string in it: of all in it, the one that is
   rarest by a table of counters of fixed size (then of least hash), so equal strings have equal keys. Strings whose key
   stands nowhere else are single. Rarest first also keeps apart what only touches a passage that is common: a string with a
   byte of its own around it has a key of its own.
2. The other strings, with the bytes they need, are dealt by their key. Equal pieces are sent once. Each task sorts
   the suffixes of its pieces in two stages (suffix_sort.py); strings that share `length` bytes are neighbours there.
3. Single strings are reported to their documents, which drop the bytes covered by any other string.

Documents with equal texts are found beforehand: they repeat as a whole, and one of them stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBERS, added_up, column, discard, numbers_of_task, stored, trimmed
from .placed_texts import ASKED, COPY, REPEATED, Asking, copies, keyed, repeated_places, row_array, row_type, runs_of, with_facts
from .shingles import prefix_hash, slices, window_hash
from .suffix_sort import common_prefixes, sort_suffixes

CELLS, PARTS = 1 << 20, 64
#: Bytes of a text that are looked at together; strings never reach over more.
SEGMENT = 1 << 20
#: Bytes of pieces whose suffixes are sorted together.
BLOCK = 1 << 20
#: Kinds of facts: places of keys that are repeated, and runs of strings that are single.
KEY, SINGLE = 3, 4


def segments(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Parts of a text such that each string starts in exactly one and lies in it."""
    for a in range(0, max(1, n - length + 1), SEGMENT):
        yield a, min(n, a + SEGMENT + length - 1)


def key_hashes(data: np.ndarray, key: int) -> np.ndarray:
    at = np.arange(len(data) - key + 1)
    return window_hash(prefix_hash(data), at, at + key)


def commonness(cells: np.ndarray) -> np.ndarray:
    """Log-scaled counts of the cells, in the upper bits."""
    return np.minimum(64 * np.log2(1.0 + cells), 16383).astype(np.uint64) << np.uint64(50)


def choose(h: np.ndarray, cells: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` keys: the place of the least common one, then by hashes, then by places."""
    v = cells[h >> np.uint64(44)] | ((h & np.uint64((1 << 26) - 1)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < span:
        v = np.minimum(v[: len(v) - (span - size)], v[span - size :])
    return (v & np.uint64((1 << 24) - 1)).astype(np.int64)


def _counters(rows: DataFrame, key: int, length: int) -> np.ndarray:
    """How many key strings fall in each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(column(batch, "text")):
                if len(data) >= key:
                    h = key_hashes(data, key)
                    inside = np.ones(len(data) + 1, bool)  # not over the end of a text
                    for end in offsets[1:-1].tolist():
                        inside[max(0, end - key + 1) : end] = False
                    cells += np.bincount((h[inside[: len(h)]] >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        if cells.any():
            yield numbers_of_task(np.split(cells, PARTS))

    out = np.zeros((PARTS, CELLS // PARTS), np.int64)
    for part, total in added_up(rows.select("text").mapInArrow(trimmed(count), NUMBERS), np.int64).items():
        out[part] = total
    return out.reshape(-1)


def _keys(rows: DataFrame, cells, key: int, length: int) -> DataFrame:
    """What each task asks about the keys of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cells.value
        out = Asking(places=True)
        for batch in batches:
            docs, tags = column(batch, "doc").to_numpy(), column(batch, "tag").to_numpy()
            for low, _, data, offsets in slices(column(batch, "text")):
                for row in range(len(offsets) - 1):
                    raw = data[offsets[row] : offsets[row + 1]]
                    for a, b in segments(len(raw), length):
                        if b - a >= length:
                            h = key_hashes(raw[a:b], key)
                            place = np.unique(choose(h, table, length - key + 1))
                            out.add(h[place], int(docs[low + row]), int(tags[low + row]), place + a)
                if out.size > 500_000:
                    yield out.send()
        if out.size:
            yield out.send()

    return rows.select("doc", "tag", "text").mapInArrow(trimmed(run), ASKED)


PIECES = "kind int, doc long, tag long, h long, many int, start long, windows int, body binary"
TEXT, PIECE = 0, 1


def _pieces(cells, key: int, length: int):
    """For each document its compressed text with its runs of open strings, and the pieces that hold them."""

    row_kind: list[pa.DataType] = []

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        carried = pa.array([None if r[8] is None else r[8].as_py() for r in found], row_kind[0])
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)), carried], [*(x.split()[0] for x in PIECES.split(", ")), "row"])

    def use(documents):
        table = cells.value
        compress = zstandard.ZstdCompressor(level=3).compress
        texts, pieces, size = [], {}, 0
        for doc, tag, row, raw, facts in documents:
            row_kind[:] = [row.type]
            n = len(raw)
            repeated = n >= length and (COPY in facts or REPEATED in facts)
            runs = np.array([(0, n - length + 1)] if repeated else [], np.int64).reshape(-1, 2)
            if n >= length and COPY not in facts:
                data = np.frombuffer(raw, np.uint8)
                live = facts[KEY][:, 0] if KEY in facts else np.zeros(0, np.int64)
                open_ = np.zeros(n - length + 1, bool)
                for a, b in segments(n, length):
                    h = key_hashes(data[a:b], key)
                    place = choose(h, table, length - key + 1)
                    again = np.zeros(len(h), bool)
                    again[live[(live >= a) & (live < a + len(h))] - a] = True
                    alive = again[place]
                    open_[a : a + len(place)] = alive
                    # strings with the same key at the same place form one piece
                    cut = np.flatnonzero(alive & np.concatenate([[True], (place[1:] != place[:-1]) | ~alive[:-1]]))
                    stop = np.flatnonzero(alive & np.concatenate([(place[1:] != place[:-1]) | ~alive[1:], [True]])) + 1
                    for x, y in zip(cut.tolist(), stop.tolist(), strict=True):
                        body = raw[a + x : a + y - 1 + length]
                        known = pieces.get(body)
                        if known is None:
                            pieces[body] = (PIECE, doc, tag, int(h[place[x]].view(np.int64)), int(repeated), a + x, y - x, body, None)
                            size += len(body) + 100
                        elif known[4] == 0 and (known[1], known[2], known[5]) != (doc, tag, a + x):
                            pieces[body] = (*known[:4], 1, *known[5:])
                if not repeated:
                    runs = np.stack(runs_of(open_), 1).astype(np.int64)
            texts.append((TEXT, doc, tag, 0, 0, 0, 0, len(runs).to_bytes(8, "little") + runs.tobytes() + compress(raw), row))
            size += len(raw) // 2
            if size > 1 << 24:
                yield rows(texts + list(pieces.values()))
                texts, pieces, size = [], {}, 0
        if texts or pieces:
            yield rows(texts + list(pieces.values()))

    return use


def _single_strings(length: int):
    """Strings of the pieces that are no other string's equal, as runs in their documents."""

    def solve(block: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[5] for r in block), np.uint8)
        sizes = np.array([len(r[5]) for r in block])
        begin = np.cumsum(sizes) - sizes
        windows = np.array([r[4] for r in block])
        wanted = np.zeros(len(text), bool)
        for b, w in zip(begin.tolist(), windows.tolist(), strict=True):
            wanted[b : b + w] = True
        order = sort_suffixes(text, wanted, length)
        same = common_prefixes(text, order, length) >= length
        twice = np.zeros(len(text), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out = []
        for r, b in zip(block, begin.tolist(), strict=True):
            if not r[2]:
                for x, y in zip(*runs_of(~twice[b : b + r[4]]), strict=True):
                    out.append((r[0], r[1], r[3] + int(x), r[3] + int(y)))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["doc", "tag", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, key = [], 0, None
        for batch in batches:
            cols = [column(batch, c) for c in ("h", "doc", "tag", "many", "start", "windows", "body")]
            for h, doc, tag, many, start, windows, body in zip(*(c.to_pylist() for c in cols), strict=True):
                if size > BLOCK and h != key:
                    yield solve(block)
                    block, size = [], 0
                key = h
                block.append((doc, tag, many, start, windows, body))
                size += len(body)
        if block:
            yield solve(block)

    return run


def _cut_out(length: int, whole_characters: bool):
    def use(documents):
        expand = zstandard.ZstdDecompressor().decompress
        rows, size = [], 0
        for _, _, row, body, facts in documents:
            m = int.from_bytes(body[:8], "little")
            runs = np.frombuffer(body[8 : 8 + 16 * m], np.int64).reshape(m, 2)
            raw = expand(body[8 + 16 * m :])
            edge = np.zeros(len(raw) + 1, np.int64)
            if m:
                starts = np.zeros(len(raw) + 1, np.int64)
                np.add.at(starts, runs[:, 0], 1)
                np.add.at(starts, runs[:, 1], -1)
                hit = np.cumsum(starts[:-1]) > 0
                for a, b in facts.get(SINGLE, ()):
                    hit[a:b] = False
                a, b = runs_of(hit)
                np.add.at(edge, a, 1)
                np.add.at(edge, b - 1 + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = np.stack(runs_of(gone), 1)
            data = np.frombuffer(raw, np.uint8)
            if whole_characters and m:
                character = np.cumsum((data & 0xC0) != 0x80)
                gone = np.isin(character, character[gone])
            kept = data[~gone].tobytes()
            rows.append((row, len(raw), int(gone.sum()), spans.tolist(), kept))
            size += len(raw)
            if size > 1 << 22 or len(rows) >= 4096:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)

    return use


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
    digests = pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string())
    return pa.RecordBatch.from_arrays([row_array([r[0] for r in rows]), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1)), digests], ["row", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])


def _dedup(docs: DataFrame, length: int, key: int, id_col: str, text_col: str, carry: list[str], whole_characters: bool = False) -> DataFrame:
    if not 8 <= key <= length:
        raise ValueError("the key must be shorter than the strings")
    rows = keyed(docs, id_col, text_col, carry)
    cells = docs.sparkSession.sparkContext.broadcast(commonness(_counters(rows, key, length)))
    facts = stored(repeated_places(_keys(rows, cells, key, length), KEY).unionByName(copies(rows)), "keys")
    found = stored(with_facts(rows, facts, _pieces(cells, key, length), f"{PIECES}, row {row_type(rows)}"), "pieces")
    discard(facts)
    pieces = found.where(f"kind = {PIECE}").select("h", "doc", "tag", "many", "start", "windows", "body")
    single = stored(pieces.repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(_single_strings(length)), "doc long, tag long, start long, stop long"), "strings")
    single = single.select("doc", "tag", F.lit(SINGLE).alias("kind"), "start", "stop")
    texts = found.where(f"kind = {TEXT}").select("doc", "tag", "row", "body")
    return with_facts(texts, single, _cut_out(length, whole_characters), f"row {row_type(rows)}, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string", packed=True)


def dedup_substrings(docs: DataFrame, length: int = 200, key: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else, in any document.

    Texts count as UTF-8 bytes, null as empty; strings never cross documents and are judged on the input. Returns one
    row per row of docs: id_col, n_bytes, n_removed, spans (array of [start, stop) of the maximal removed runs), kept
    (binary: the remaining bytes), kept_sha256.

    Rows with equal texts repeat each other, whether their ids are equal, different or null. An empty table gives an
    empty result; other columns are not read.
    """
    out = _dedup(docs, length, key, id_col, text_col, [id_col])
    return out.select(F.col("row")[id_col].alias(id_col), "n_bytes", "n_removed", "spans", "kept", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = 200, key: int = 100, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs, all its columns, with the texts that dedup_substrings() leaves and, if there is such a column, their lengths.

    A character of which a byte is removed goes as a whole, so texts stay valid UTF-8. Null texts become empty ones.
    """
    out = _dedup(docs, length, key, id_col, text_col, [c for c in docs.columns if c != text_col], whole_characters=True)
    text = F.col("kept").cast("string")
    made = {text_col: text.alias(text_col), chars_col: F.length(text).cast(docs.schema[chars_col].dataType).alias(chars_col) if chars_col in docs.columns else None}
    return out.select(*(made[c] if made.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns))
