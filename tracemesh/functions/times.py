"""Timestamps: text in, ``TIMESTAMP_NTZ`` (log time) or ``TIMESTAMP`` (instant) out, null if unknown."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemesh.functions.patterns import MONTHS


def parse_ts(stamp: Column, year: int | Column) -> Column:
    """``2024-12-16 23:38:50`` or ``Dec 16 23:38:50``; the latter is given ``year``."""
    full = F.when(stamp.rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"), stamp.try_cast("timestamp_ntz"))
    parts = F.split(F.trim(stamp), r"\s+")
    month = F.array_position(F.array(*[F.lit(name.lower()) for name in MONTHS]), F.lower(F.get(parts, F.lit(0))))
    year = F.lit(year) if isinstance(year, int) else year
    dated = F.format_string("%04d-%02d-%s %s", year, month, F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.get(parts, F.lit(2)))
    syslog = F.when(
        stamp.rlike(r"(?i)\A\s*[a-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s*\z") & (month > 0),
        dated.try_cast("timestamp_ntz"),
    )
    return F.coalesce(full, syslog)


def parse_instant(stamp: Column) -> Column:
    """An RFC 3339 stamp, or ``2024-12-16 23:38:50.123`` read as UTC."""
    upper = F.upper(stamp)
    zoned = F.when(
        upper.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"), upper.try_cast("timestamp")
    )
    naive = F.when(
        stamp.rlike(r"\A\d{4}-\d{2}-\d{2} +\d{2}:\d{2}:\d{2}(\.\d+)?\z"), F.concat(stamp, F.lit("Z")).try_cast("timestamp")
    )
    return F.coalesce(zoned, naive)


def parse_bound(text: str | None) -> datetime | None:
    """A range bound given as a date, or a date and a time to the minute or second; null if it is neither."""
    if not text:
        return None
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    return None
