"""Audit of how filters interact: what each takes away, in every order in which they can be applied.

Every batch of rows becomes packed bitmaps: one for each filter (rows that fail it), for each label, and for each part. What
is left after a set of filters is the part AND NOT the bitmaps of the set, whatever their order, so a popcount for each of
the 2^k sets answers for all k! orders. Tasks send these counts per part; they are added up, and the orders are read off them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, discard, encode, stored, texts

#: Filters of documents, in the order of their bits.
DOCUMENT_FILTERS = "ABCDE"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_flags(text: str | None) -> int:
    """Bits of the filters A to D that a text fails: too few words, too few distinct ones, too many capitals, markup characters."""
    raw = encode(text)
    words = raw.split()
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * len(text or "")) << 2 | (len(raw.translate(None, b"#$%&*|")) < len(raw)) << 3


def flag_texts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, flags (A to D), digest (16 bytes of the text's SHA-256) of every row; null texts are empty, null parts are ''."""
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(text_flags(t), hashlib.sha256(encode(t)).digest()[:16]) for t in texts(batch, "text")]
            made = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "part"), *made], ["doc_id", "part", "flags", "digest"])

    return picked.mapInArrow(run, T.StructType([picked.schema["doc_id"], picked.schema["part"], T.StructField("flags", T.IntegerType()), T.StructField("digest", T.BinaryType())]))


def flag_repeats(rows: DataFrame, bit: int) -> DataFrame:
    """rows with that bit set in flags where a smaller doc_id has the same digest. Null ids are never repeats, nor do others repeat them.

    Rows meet the first of their digest by digest and id together, so that the copies of one text are spread over all tasks.
    """
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    known = rows.join(first, ["digest", "doc_id"], "left")
    repeat = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return known.withColumn("flags", F.col("flags") + F.when(repeat, 1 << bit).otherwise(0)).drop("_first", "digest")


def subset_counts(rows: DataFrame, filters: int) -> DataFrame:
    """part, kept, good, toxic: arrays over the sets of filters (by their bits) of how many rows no filter of the set fails, and how many
    of those are labelled good or toxic. rows: part, flags, good, toxic.

    A task holds the counts of the parts that it has met, and sends them when they are many.
    """
    sets, most = 1 << filters, 4096
    fields = ["part", "kept", "good", "toxic"]

    def send(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        table = np.stack(list(counts.values()))
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(list(table[:, k]), pa.list_(pa.int64())) for k in range(3))], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            flags = column(batch, "flags").to_numpy(zero_copy_only=False)
            failing = [np.packbits(flags >> k & 1) for k in range(filters)]
            labels = [np.packbits(column(batch, name).to_numpy(zero_copy_only=False)) for name in ("good", "toxic")]
            # what no filter of a set fails: that of the set without its lowest filter, AND NOT that filter
            left = [np.packbits(np.ones(len(flags), bool))]
            for s in range(1, sets):
                low = s & -s
                left.append(left[s ^ low] & ~failing[low.bit_length() - 1])
            index = np.stack([np.stack([x, x & labels[0], x & labels[1]]) for x in left], 1)
            codes = column(batch, "part").dictionary_encode()
            places = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(places, kind="stable")
            ends = np.cumsum(np.bincount(places, minlength=len(codes.dictionary)))
            for k, part in enumerate(codes.dictionary.to_pylist()):
                own = order[ends[k - 1] if k else 0 : ends[k]]
                span = slice(own.min() // 8, own.max() // 8 + 1)  # bytes in which the part has rows
                bits = np.zeros((span.stop - span.start) * 8, bool)
                bits[own - span.start * 8] = True
                found = np.bitwise_count(index[:, :, span] & np.packbits(bits)).sum(2, dtype=np.int64)
                counts[part] = counts[part] + found if part in counts else found
            if len(counts) >= most:
                yield send(counts)
                counts = {}
        if counts:
            yield send(counts)

    picked = rows.select("part", "flags", "good", "toxic")
    sent = picked.mapInArrow(run, "part string, kept array<bigint>, good array<bigint>, toxic array<bigint>")
    total = [F.sum(F.get(name, F.lit(s))).alias(f"{name}_{s}") for name in fields[1:] for s in range(sets)]
    return sent.groupBy("part").agg(*total).select("part", *(F.array(*(F.col(f"{name}_{s}") for s in range(sets))).alias(name) for name in fields[1:]))


def order_table(counts: DataFrame, names: str) -> DataFrame:
    """All orders of the filters, step by step, from subset_counts(): part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (rows that the filter removes, over all orders)."""
    full = (1 << len(names)) - 1
    steps, times = [], {}
    for order in permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append({"step": step, "filter_order": "".join(names[x] for x in order), "before": before, "after": before | 1 << k, "own": k})
            times[k, before] = times.get((k, before), 0) + 1
            before |= 1 << k
    # what a filter removes over all orders, as one sum over the sets that can stand before it
    shapley = [" + ".join(f"{n} * (kept[{before}] - kept[{before | 1 << k}])" for (x, before), n in times.items() if x == k) for k in range(len(names))]
    every = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in row.items())) for row in steps))
    each = counts.select("part", "kept", "good", "toxic", F.expr(f"array({', '.join(shapley)})").alias("shapley"), F.explode(every).alias("o"))
    return each.selectExpr(
        "part", "o.filter_order", "o.step", "kept[o.after] as kept", "kept[o.before] - kept[o.after] as removed",
        "kept[0] - kept[shiftleft(1, o.own)] - kept[o.before] + kept[o.after] as redundant", f"kept[{full} - shiftleft(1, o.own)] - kept[{full}] as unique_fails",
        "good[o.before] - good[o.after] as good_lost", "toxic[o.before] - toxic[o.after] as toxic_lost", "shapley[o.own] as shapley",
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """How the filters A to E (see text_flags() and flag_repeats()) interact on docs, per part and order: see order_table().

    labels: doc_id, quality, toxic; of several labels of an id a 1 counts, and each row of an id that repeats counts by itself.
    Null texts are empty, a null part is '' and counts with an empty one, a null id has no label and repeats nothing; very long texts are
    read one at a time. Other columns, clashing names included, are not read. An empty table has no parts and gives no rows.
    The rows' facts (some 40 bytes each) are stored until they are counted; texts are read once and never shuffled.
    """
    facts = stored(flag_texts(docs, id_col, text_col, part_col), "flags")
    known = labels.where("quality = 1 OR toxic = 1").groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = flag_repeats(facts, DOCUMENT_FILTERS.index("E")).join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    counts = stored(subset_counts(rows, len(DOCUMENT_FILTERS)), "subsets")
    discard(facts)
    return order_table(counts, DOCUMENT_FILTERS)
