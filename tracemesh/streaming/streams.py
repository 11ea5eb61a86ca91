"""Entries and sessions from streaming input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tracemesh.operators.entries import extract_entries

_EPOCH = {True: "timestamp_ntz'1970-01-01 00:00:00'", False: "timestamp'1970-01-01 00:00:00Z'"}


def stream_entries(lines: DataFrame) -> DataFrame:
    """The entry table of a stream of ``(line, text)``: stateless, so it is the batch operator."""
    return extract_entries(lines)


def stream_sessions(rows: DataFrame, gap_ms: int = 1000, late: str = "10 seconds", keys: Sequence[str] = ("type",)) -> DataFrame:
    """Sessions of a stream of ``(ts, type, value)`` with the last value per session.

    A session closes when the watermark passes its end.  Rows exactly one window length apart
    still merge, so the window is the largest gap that counts as ``gap_ms`` whole milliseconds.
    """
    window = F.session_window("ts", _gap(gap_ms))
    return (
        rows.withWatermark("ts", late)
        .groupBy(*keys, window.alias("w"))
        .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("rows"), F.max_by("value", "ts").alias("value"))
        .drop("w")
    )


def stream_collect(
    rows: DataFrame, types: Sequence[str | None], gap_ms: int = 1000, late: str = "10 seconds", keys: Sequence[str] = (), ts: str = "ts", pos: str = "row_number"
) -> DataFrame:
    """What :func:`tracemesh.operators.sessions.session_collect` gives, on a stream: ``(*keys, session, type, value)``.

    Each session gives one row per type, with the value of the last row of that type by time and ``pos``, in whatever order the
    rows arrive.  A session is emitted once, when the watermark has passed its end; rows later than ``late`` are dropped by Spark.  State is one
    row per open session, with the last row of each of ``types``, so the types are given beforehand; a row of another type is an
    error and not left out.  Null keys are one key, a null among ``types`` stands for rows without a type, and rows without a time are in no session.
    """
    local = isinstance(rows.schema[ts].dataType, TimestampNTZType)

    def between(at, source: bool, target: bool):
        """The same microseconds after the epoch, with or without a time zone."""
        return F.timestamp_add("MICROSECOND", F.timestamp_diff("MICROSECOND", F.expr(_EPOCH[source]), at), F.expr(_EPOCH[target]))

    known = F.lit(False)
    for name in types:
        known = known | F.col("type").eqNullSafe(F.lit(name))
    message = F.concat(F.lit("a type that was not given: "), F.coalesce("type", F.lit("null")))
    at = between(F.col(ts), local, False) if local else F.col(ts)
    named = rows.select(
        *[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)],
        at.alias("_ts"),
        F.col(pos).alias("_pos"),
        F.when(known, F.col("type")).otherwise(F.raise_error(message)).alias("_type"),
        F.col("value").alias("_value"),
    ).filter("_ts IS NOT NULL")
    row = F.struct(F.col("_ts").alias("ts"), F.col("_pos").alias("pos"), F.col("_value").alias("value"))
    last = [F.max(F.when(F.col("_type").eqNullSafe(F.lit(name)), row)).alias(f"_last{n}") for n, name in enumerate(types)]
    own = [F.col(f"_key{n}") for n in range(len(keys))]
    closed = (
        named.withWatermark("_ts", late)
        .groupBy(*own, F.session_window("_ts", _gap(gap_ms)).alias("_window"))
        .agg(F.min("_ts").alias("_start"), *last)
    )
    begin = between(F.col("_start"), False, True) if local else F.col("_start")
    per_type = [F.struct(F.lit(name).cast("string").alias("type"), F.col(f"_last{n}").alias("last")) for n, name in enumerate(types)]
    found = closed.select(*[c.alias(k) for c, k in zip(own, keys, strict=True)], begin.alias("session"), F.inline(F.array(*per_type)))
    return found.filter("last IS NOT NULL").select(*keys, "session", "type", F.col("last.value").alias("value"))


def _gap(gap_ms: int) -> str:
    """Rows one window length apart still merge, so this is the largest gap of ``gap_ms`` whole milliseconds."""
    return f"{gap_ms * 1000 + 999} microseconds"
