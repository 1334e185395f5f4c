"""Reading VARIANT values of unknown shape: what isn't of the wanted kind counts as absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nonblank


def members(v: Column, path: str) -> Column:
    """The objects in the list at path; other members, and what is no list, give none."""
    listed = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.filter(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def words(v: Column, path: str) -> Column:
    """The trimmed text at path; null if it is blank or no text."""
    value = F.variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", nonblank(F.variant_get(v, path, "string")))


def texts(v: Column, path: str) -> Column:
    """The trimmed texts in the list at path, in order; blank ones and other members are left out."""
    listed = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.filter(F.transform(listed, lambda x: words(x, "$")), lambda t: t.isNotNull())
