"""Log lines to classified values and entries, and the filters over entries.

Lines are ``(line, text)`` plus any columns that identify the file, which are kept.
Entries are ``(line, pos, timestamp, type, value)``: ``pos`` numbers the entries of
a line, so ``(line, pos)`` is the input order that later operators rely on.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemesh.functions import EXTRACTORS, classify, line_timestamp
from tracemesh.functions import extract as X
from tracemesh.functions.patterns import ENTRY_TYPES, SKIPPED_LITERALS
from tracemesh.functions.times import parse_ts

_ENTRY_EXTRACTORS = {
    "Email": X.extract_emails,
    "IP": X.extract_ips,
    "DNSName": X.extract_dnsnames,
    "URL": X.extract_urls,
    "Username": X.extract_usernames,
    "TTY": X.extract_ttys,
}
_FINDING_EXTRACTORS = {
    "email": X.extract_emails,
    "ip": X.extract_ips,
    "url": X.extract_urls,
    "dns_name": X.extract_dnsnames,
}


def names(spec: str | Iterable[str] | None) -> list[str]:
    """A comma list or an iterable of names, trimmed."""
    if spec is None:
        return []
    return [part.strip() for part in (spec.split(",") if isinstance(spec, str) else spec)]


def _tagged(label: str, found: Column, column: str) -> Column:
    return F.transform(found, lambda value: F.struct(F.lit(label).alias(column), value.alias("value")))


def _other_columns(lines: DataFrame) -> list[str]:
    return [name for name in lines.columns if name != "text"]


def _labelled_values(lines: DataFrame, extractors: Sequence[str], include: list[str], exclude: list[str]) -> DataFrame:
    text = F.col("text")
    found = F.concat(*[EXTRACTORS[name](text) for name in extractors])
    wanted = F.filter(found, lambda v: (F.octet_length(v) >= 3) & ~v.isin(*SKIPPED_LITERALS))

    def label(value: Column) -> Column:
        labels = classify(value)
        return F.array_except(labels, F.array(*map(F.lit, exclude))) if exclude else labels

    # Labelled before the values become rows: a filter on a computed column would work it out twice.
    labelled = F.transform(wanted, lambda v: F.struct(v.alias("value"), label(v).alias("categories")))
    rows = lines.select(*_other_columns(lines), F.posexplode(labelled).alias("pos", "_v"))
    rows = rows.select(*_other_columns(lines), F.col("pos").cast("bigint").alias("pos"), "_v.value", "_v.categories")
    rows = rows.filter(F.size("categories") > 0)
    if include:
        rows = rows.filter(F.arrays_overlap("categories", F.array(*map(F.lit, include))))
    return rows


def classify_lines(
    lines: DataFrame, include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None
) -> DataFrame:
    """Every extracted value of at least three bytes with its categories."""
    refused = names(exclude)
    return _labelled_values(lines, [n for n in EXTRACTORS if n not in refused], names(include), refused)


def scan_stats_basic(lines: DataFrame, exclude: str | Iterable[str] | None = None) -> DataFrame:
    """The short scan: addresses, e-mails and phone numbers only."""
    refused = names(exclude)
    return _labelled_values(lines, [n for n in ("ip", "email", "phonenumber") if n not in refused], [], refused)


def extract_entries(lines: DataFrame, types: str | Iterable[str] = ENTRY_TYPES) -> DataFrame:
    """The entry table: typed values with line and timestamp, not classified again."""
    text = F.col("text")
    wanted = names(types)
    found = F.concat(*[_tagged(name, make(text), "type") for name, make in _ENTRY_EXTRACTORS.items() if name in wanted])
    keep = _other_columns(lines)
    # Spark reads the stamp after the explode, so only for lines that hold something.
    return lines.select(*keep, line_timestamp(text).alias("timestamp"), F.posexplode(found).alias("pos", "_entry")).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), "timestamp", "_entry.type", "_entry.value"
    )


def scan_findings(lines: DataFrame, exclude: str | Iterable[str] | None = None) -> DataFrame:
    """E-mail, address, URL and host name findings; the last is called ``dns_name`` here."""
    refused = names(exclude)
    text = F.col("text")
    wanted = {name: make for name, make in _FINDING_EXTRACTORS.items() if name not in refused}
    found = F.concat(*[_tagged(name, make(text), "category") for name, make in wanted.items()])
    keep = _other_columns(lines)
    return lines.select(*keep, F.posexplode(found).alias("pos", "_found")).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), "_found.category", "_found.value"
    )


def limit_lines(lines: DataFrame, limit: int | None = None, sample: int = 1) -> DataFrame:
    """The first ``limit`` lines of each file, and of those every ``sample``-th."""
    if limit is not None:
        lines = lines.filter(F.col("line") <= limit)
    if sample > 1:
        lines = lines.filter(F.col("line") % sample == 0)
    return lines


def filter_types(
    entries: DataFrame, include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None
) -> DataFrame:
    if include is not None:
        entries = entries.filter(F.col("type").isin(*names(include)))
    if exclude is not None:
        entries = entries.filter(~F.col("type").isin(*names(exclude)))
    return entries


def time_range(entries: DataFrame, start: datetime | None, end: datetime | None, year: int) -> DataFrame:
    """Entries between two times, both included; entries without a readable time go once a bound is set."""
    if start is None and end is None:
        return entries
    at = parse_ts(F.col("timestamp"), year)
    if start is not None:
        entries = entries.filter(at >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        entries = entries.filter(at <= F.lit(end).cast("timestamp_ntz"))
    return entries
