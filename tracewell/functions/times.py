"""Column functions on times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from a to b, with fractions; works on timestamps with and without zone."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def parse_time(c: Column, fallback: str | None = None) -> Column:
    """ISO times with Z, offsets or fractions, or epoch milliseconds; others become ``fallback`` or null."""
    t = F.coalesce(F.try_to_timestamp(c), F.when(c.rlike(r"^\d{12,14}$"), F.timestamp_millis(F.expr("0") + c.try_cast("long"))))
    return F.coalesce(t, F.to_timestamp(F.lit(fallback))) if fallback else t


def local_time(c: Column, zone: str = "America/Los_Angeles", fmt: str = "yyyy-MM-dd HH:mm") -> Column:
    """A UTC time as text in a zone."""
    return F.date_format(F.from_utc_timestamp(c.cast("timestamp"), zone), fmt)


def week_span(first: Column, last: Column) -> Column:
    """Whole days between, in weeks begun: max(1, days // 7 + 1); 0 without times."""
    days = F.floor(seconds_between(first, last) / 86400)
    return F.when(first.isNull() | last.isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor(days / 7) + 1)).cast("int")
