"""Two-stage suffix sorting of a bounded piece of text, for suffixes compared by their first `depth` bytes.

Suffixes smaller than their successor are sorted directly. The others follow by a scan of the buckets of first
bytes in order: when a suffix is met, the one that starts before it takes the next free place of its own bucket,
if it is larger than its successor. Within a bucket those stand before the directly sorted ones.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix: is it smaller than the one that starts a byte later? The last one is not."""
    n = len(text)
    up = np.zeros(n, bool)
    if n > 1:
        change = np.flatnonzero(text[1:] != text[:-1])  # equal bytes go by the next change
        rise = text[change + 1] > text[change]
        nearest = np.searchsorted(change, np.arange(n))
        known = nearest < len(change)
        up[known] = rise[nearest[known]]
    return up


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes (flags) in order of their first `depth` bytes; at the end zeros are taken to follow."""
    n = len(text)
    full = np.concatenate([text, np.zeros(1, np.uint8), np.full(depth + 8, 255, np.uint8)])
    up = smaller_than_next(full)
    need = np.zeros(len(full), bool)
    need[:n] = wanted
    # a larger suffix is placed by its successor, and so on up to one that is sorted directly
    fresh = np.flatnonzero(need & ~up)
    while len(fresh):
        fresh = fresh[~need[fresh + 1]] + 1
        need[fresh] = True
        fresh = fresh[~up[fresh]]
    direct = np.flatnonzero(need & up)
    rows = np.lib.stride_tricks.sliding_window_view(full, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    heads = full[direct]
    ends = np.searchsorted(heads, np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(met: np.ndarray) -> None:
        before = met - 1
        before = before[before >= 0]
        before = before[need[before] & ~up[before]]
        if len(before):
            first = full[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part in np.split(before, cuts):
                queues[full[part[0]]].append(part)

    for byte in range(256):
        queue, k = queues[byte], 0
        while k < len(queue):
            induce(queue[k])
            k += 1
        own = direct[ends[byte] : ends[byte + 1]]
        out += [*queue, own]
        induce(own)
    order = np.concatenate(out)
    order = order[order < n]
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each neighbouring two of the sorted suffixes: how many bytes they share, up to `depth`."""
    full = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    shared = np.zeros(max(len(order) - 1, 0), np.int64)
    open_ = np.arange(len(shared))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(full, 8)).view(np.uint64).ravel()
    done = 0
    while done + 8 <= depth and len(open_):
        same = words[order[open_] + done] == words[order[open_ + 1] + done]
        open_ = open_[same]
        done += 8
        shared[open_] = done
    # the last bytes one by one for those that agree so far, and the rest of a word for those that don't
    rest = np.arange(len(shared))[shared < depth]
    for _ in range(8):
        if not len(rest):
            break
        at = shared[rest]
        same = (full[order[rest] + at] == full[order[rest + 1] + at]) & (at < depth)
        rest = rest[same]
        shared[rest] += 1
    return shared
