"""Sessions: rows that follow each other closely in time."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType
from pyspark.sql.window import Window


def gap_sessions(rows: DataFrame, gap_ms: int = 1000, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Add ``session``, the first time of the session a row belongs to.

    A row more than ``gap_ms`` whole milliseconds after the row before it begins a new
    session; without ``keys`` all rows form one sequence.  Rows within one gap length of
    each other are always in one session, so they are first reduced to one row per time
    bucket.  Buckets are ordered inside chunks, and the chunk borders are joined by a
    second pass over one row per chunk; with chunks of about the root of the number of
    buckets no window holds more than that many rows, whatever the size of the input.
    Null keys are one key.
    """
    names = rows.columns
    # Structs compare null-safe, plain keys do not.
    if keys:
        rows = rows.withColumn("_key", F.struct(*keys))
    keys = ["_key"] if keys else []
    gap_us = gap_ms * 1000 + 999  # a gap counts in whole milliseconds
    kind = rows.schema[ts].dataType
    epoch = F.lit("1970-01-01 00:00:00Z" if isinstance(kind, TimestampType) else "1970-01-01 00:00:00").cast(kind)
    at = F.timestamp_diff("MICROSECOND", epoch, F.col(ts))
    timed = rows.withColumn("_at", at).withColumn("_bucket", F.expr(f"floor(_at / {gap_us})"))
    span = timed.agg(F.min("_bucket").alias("low"), F.max("_bucket").alias("high")).first()
    size = max(1024, isqrt((span["high"] or 0) - (span["low"] or 0) + 1))
    buckets = timed.groupBy(*keys, "_bucket").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    buckets = buckets.withColumn("_chunk", F.expr(f"floor((_bucket - {span['low'] or 0}) / {size})"))

    chunks = buckets.groupBy(*keys, "_chunk").agg(F.max("_hi").alias("_last"))
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = chunks.withColumn("_before", F.lag("_last").over(over_chunks))

    inside = Window.partitionBy(*keys, "_chunk").orderBy("_bucket")
    sequence = [*keys, "_chunk"]
    marked = buckets.join(chunks.select(*sequence, "_before"), sequence).withColumn(
        "_prev", F.coalesce(F.lag("_hi").over(inside), F.col("_before"))
    )
    begins = F.col("_prev").isNull() | (F.col("_lo") - F.col("_prev") > gap_us)
    marked = marked.withColumn("_begin", F.when(begins, F.col("_lo")))
    # The session of a bucket is the last begin up to it, in its chunk or in an earlier one.
    opened = marked.groupBy(*sequence).agg(F.max("_begin").alias("_opened"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.withColumn("_carried", F.max("_opened").over(earlier)).select(*sequence, "_carried")
    so_far = F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    sessions = marked.join(opened, sequence).select(
        *keys, "_bucket", F.coalesce(so_far, F.col("_carried")).alias("_session")
    )
    joined = timed.join(sessions, [*keys, "_bucket"])
    return joined.withColumn("session", F.timestamp_add("MICROSECOND", F.col("_session"), epoch)).select(*names, "session")


def session_summary(sessions: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Time range and size of each session."""
    return sessions.groupBy(*keys, "session").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows")
    )


def session_collect(sessions: DataFrame, keys: Sequence[str] = (), ts: str = "ts", pos: str = "row_number") -> DataFrame:
    """The identities of each session, one row per type; the last row of a type gives its value."""
    return sessions.groupBy(*keys, "session", "type").agg(F.max_by("value", F.struct(ts, pos)).alias("value"))


def session_rows(sessions: DataFrame, keys: Sequence[str] = (), ts: str = "ts", pos: str = "row_number") -> DataFrame:
    """The row numbers of each session in time order, one row per element, since a session may be of any length."""
    return sessions.select(*keys, "session", ts, pos)
