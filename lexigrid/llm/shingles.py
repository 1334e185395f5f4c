"""Word and shingle hashes of whole Arrow columns with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix

#: Bytes hashed at a time (a longer text is hashed alone).
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 2**64))
        k += m
    return out[:n]


_tables: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Kept tables of the powers of the base ("up") and of its inverse ("down")."""
    table = _tables.get(kind)
    if table is None or len(table) < n:
        table = powers(_BASE if kind == "up" else pow(_BASE, -1, 2**64), max(n, SLICE + 2))
        if n <= 8 * SLICE:
            _tables[kind] = table
    return table[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = the hash of data[i:j], scaled by the position (see window_hash)."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("down", len(data)), out=c[1:])
    return c


def window_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], alike wherever the bytes stand."""
    h = (c[end] - c[start]) * _power("up", len(c))[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them); null texts are empty."""
    texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (one more at the end)."""
    ink = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the first word of each row."""
    starts, ends, first = word_spans(data, offsets)
    c = prefix_hash(_LOWER[data] if lower else data)
    return window_hash(c, starts, ends), first


def join_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, as if all were of one row."""
    n = len(w) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        h = (h ^ w[j : j + n]) * np.uint64(_BASE)
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text, words in lower case: k words each; with
    fewer words the whole sequence as one shingle; none without words."""
    for low, _, data, offsets in slices(texts):
        w, first = word_hashes(data, offsets, lower=True)
        h = join_hashes(w, k)
        for row in range(len(offsets) - 1):
            a, b = int(first[row]), int(first[row + 1])
            if b - a >= k:
                yield low + row, np.unique(h[a : b - k + 1])
            elif b > a:
                yield low + row, join_hashes(w[a:b], b - a) + np.uint64(b - a)
            else:
                yield low + row, np.zeros(0, np.uint64)


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """shingle_sets() of a single text in UTF-8."""
    data = np.frombuffer(raw, np.uint8)
    w, _ = word_hashes(data, np.array([0, len(data)]), lower=True)
    if len(w) >= k:
        return np.unique(join_hashes(w, k))
    return join_hashes(w, len(w)) + np.uint64(len(w)) if len(w) else np.zeros(0, np.uint64)
