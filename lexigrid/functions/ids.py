"""Identities: hashes and name-based UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

#: Fixed value: the namespace of the ids of indexed chunks.
NAMESPACE = "b2c2df40-7a1b-4f9a-9e1c-0e7c8a7f6c1a"


def document_id(doi: Column) -> Column:
    return F.sha2(doi, 256)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """UUID of version 5: SHA-1 of the namespace's bytes and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def point_id(doc_id: Column, index: Column, namespace: str = NAMESPACE) -> Column:
    return uuid5(F.concat_ws(":", doc_id, index.cast("string")), namespace)


def body_hash(model: Column, lines: Column) -> Column:
    """Hash of a batch: the model's line, then one line for each item in order."""
    return F.sha2(F.concat_ws("\n", model, F.array_join(lines, "\n")), 256)


def item_line(*parts: Column) -> Column:
    """Parts joined by bars; null and 0 as ''."""
    return F.concat_ws("|", *(F.coalesce(F.when(p.cast("string") != "0", p.cast("string")), F.lit("")) for p in parts))


def question_key(question: Column) -> Column:
    """Short key of a question whatever its case and spacing."""
    return F.substring(F.sha2(F.lower(squeeze(question)), 256), 1, 12)


def options_key(options: Column) -> Column:
    """Short key of options (a map), whatever their order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(options)))
    return F.substring(F.sha2(F.to_json(ordered), 256), 1, 12)
