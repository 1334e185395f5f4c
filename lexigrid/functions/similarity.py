"""Ratcliff-Obershelp similarity of titles, in Arrow batches: Spark has no expression for it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain


def ratio(a: str | Column, b: str | Column) -> Column:
    """Twice the matching characters over all, of both texts in plain form; 0 if either is blank."""

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() if p.strip() and q.strip() else 0.0 for p, q in zip(x, y, strict=True)])

    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return compare(plain(as_column(a)), plain(as_column(b)))


def best_title(candidates_ratio: Column, year: Column, wanted_year: Column) -> Column:
    """A ratio that counts less if the years are more than one apart; under 0.93 it counts for nothing."""
    near = F.when(F.abs(year - wanted_year) > 1, candidates_ratio * 0.92).otherwise(candidates_ratio)
    return F.when(near >= 0.93, near)
