"""Dates and times, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How literature dates are written; a bare year means its first day.
LITERATURE_FORMATS = ("yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy MMM d", "yyyy MMM", "yyyy")


def iso(c: Column) -> Column:
    """Time of an ISO text, null if it isn't one."""
    return F.try_to_timestamp(F.trim(c))


def literature_date(c: Column) -> Column:
    tries = [F.try_to_timestamp(F.trim(c), F.lit(f)) for f in LITERATURE_FORMATS]
    year = F.nullif(F.regexp_extract(c, r"^\s*(\d{4})", 1), F.lit(""))
    return F.coalesce(*tries, F.try_to_timestamp(year, F.lit("yyyy")))


def valid_year(c: Column) -> Column:
    return F.coalesce(c.between(1800, 2100), F.lit(False))


def next_run(now: Column, times: Column) -> Column:
    """Next of the HH:MM times of the day (an array) after now; one that has passed comes tomorrow. No times: now."""
    at = F.transform(times, lambda t: F.to_timestamp(F.concat(F.date_format(now, "yyyy-MM-dd"), F.lit(" "), t), "yyyy-MM-dd HH:mm"))
    return F.coalesce(F.array_min(F.transform(at, lambda t: F.when(t > now, t).otherwise(t + F.expr("INTERVAL 1 DAY")))), now)
