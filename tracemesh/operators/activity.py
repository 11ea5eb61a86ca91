"""Activity of groups over time: counts per unit, segments, statistics.

Input are group entries ``(group_id, line, pos, type, value, node, at)`` with ``at`` the
time that was read from the timestamp; see :func:`timed`.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.functions.times import parse_ts

HOUR = 3600 * 1_000_000
LEVELS = (("none", 0), ("low", 10), ("medium", 30), ("high", 50))


def timed(entries: DataFrame, year: int) -> DataFrame:
    """Entries whose timestamp can be read, with it as ``at``."""
    return entries.withColumn("at", parse_ts(F.col("timestamp"), year)).filter(F.col("at").isNotNull())


def heatmap_slice(entries: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Entries from ``start`` up to but not including ``end``, by line and timestamp."""
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    return entries.filter((F.col("at") >= low) & (F.col("at") < high)).orderBy("group_id", "line", "timestamp", "pos")


def first_type_per_value(entries: DataFrame) -> DataFrame:
    """Distinct values with the type they were first seen with."""
    order = F.struct("line", "timestamp", "pos")
    return entries.filter("value <> ''").groupBy("group_id", "value").agg(F.min_by("type", order).alias("type"))


def activity(entries: DataFrame, unit: str) -> DataFrame:
    """Entries per hour, day, type or value of each group, with the place the key first occurs."""
    keys = {
        "hour": F.date_trunc("hour", "at").cast("timestamp_ntz"),
        "day": F.date_trunc("day", "at").cast("timestamp_ntz"),
        "type": F.col("type"),
        "value": F.col("value"),
    }
    return entries.groupBy("group_id", keys[unit].alias("key")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(F.struct("line", "pos")).alias("first")
    )


def _micros(at: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))


def activity_summary(entries: DataFrame) -> DataFrame:
    """Entries, distinct nodes, time range and duration per group."""
    span = F.timestamp_diff("MICROSECOND", F.min("at"), F.max("at"))
    per_node = entries.groupBy("group_id", "node").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")
    )
    span = F.timestamp_diff("MICROSECOND", F.min("lo"), F.max("hi"))
    return per_node.groupBy("group_id").agg(
        F.sum("n").alias("total_entries"),
        F.count(F.lit(1)).alias("unique_entries"),
        F.min("lo").alias("min_at"),
        F.max("hi").alias("max_at"),
        F.floor(span / (24 * HOUR)).alias("duration_days"),
        (span / HOUR).alias("duration_hours"),
    )


def heatmap_segments(entries: DataFrame, segments: int = 200) -> DataFrame:
    """Entries per equal slice between the first and last time of each group.

    60 slices below an hour, 120 below a day, 168 below a week, else ``segments``.  A slice
    does not include its end, so the very last entry is in none; with a zero range all are empty.
    """
    per_group = entries.groupBy("group_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    span = F.timestamp_diff("MICROSECOND", F.col("lo"), F.col("hi"))
    number = F.when(span < HOUR, 60).when(span < 24 * HOUR, 120).when(span < 7 * 24 * HOUR, 168).otherwise(segments)
    whole, rest = F.floor(span / number), span % number
    up = (rest * 2 > number) | ((rest * 2 == number) & (whole % 2 == 1))  # halves to even
    groups = per_group.select("group_id", "lo", number.alias("n"), (whole + up.cast("bigint")).alias("step"))
    placed = entries.select("group_id", "at").join(groups, "group_id").filter("step > 0")
    offset = F.timestamp_diff("MICROSECOND", F.col("lo"), F.col("at"))
    counts = (
        placed.withColumn("segment", F.floor(offset / F.col("step")).cast("bigint"))
        .filter("segment < n")
        .groupBy("group_id", "segment")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    grid = groups.select("group_id", "lo", "n", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - F.lit(1).cast("bigint"))).alias("segment"))
    cnt = F.coalesce("cnt", F.lit(0)).cast("bigint")
    level = F.lit("extreme")
    for name, most in reversed(LEVELS):
        level = F.when(cnt <= most, name).otherwise(level)

    def edge(index: Column) -> Column:
        return F.timestamp_add("MICROSECOND", F.col("step") * index, F.col("lo"))

    return grid.join(counts, ["group_id", "segment"], "left").select(
        "group_id",
        "segment",
        edge(F.col("segment")).alias("start"),
        edge(F.col("segment") + 1).alias("end"),
        cnt.alias("cnt"),
        (F.col("segment") / F.col("n") * 100).alias("percentage"),
        F.lit("Unknown").alias("dominant_type"),
        level.alias("activity_level"),
    )


def busiest(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest counts of each group, earlier first occurrence first on ties."""
    order = Window.partitionBy("group_id").orderBy(F.desc("cnt"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def heatmap_statistics(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Busiest hours, days and values ``(group_id, kind, rank, key, cnt, percentage)``, and averages per group."""
    hours, days, values = (activity(entries, unit) for unit in ("hour", "day", "value"))
    totals = activity_summary(entries).select("group_id", "total_entries", "unique_entries")

    def top(counts: DataFrame, kind: str, k: int, text: Column) -> DataFrame:
        ranked = busiest(counts, k).join(totals, "group_id")
        share = F.round(F.col("cnt") / F.col("total_entries") * 100, 1) if kind == "value" else F.lit(None).cast("double")
        return ranked.select("group_id", F.lit(kind).alias("kind"), "rank", text.alias("key"), "cnt", share.alias("percentage"))

    tops = top(hours, "hour", 3, F.date_format("key", "yyyy-MM-dd HH:00"))
    tops = tops.unionByName(top(days, "day", 3, F.date_format("key", "yyyy-MM-dd")))
    tops = tops.unionByName(top(values, "value", 5, F.col("key")))

    def mean(counts: DataFrame, unit: str) -> DataFrame:
        return counts.groupBy("group_id").agg(
            F.round(F.avg("cnt"), 1).alias(f"avg_{unit}"), F.count(F.lit(1)).alias(f"active_{unit}s")
        )

    means = totals.join(mean(hours, "hour"), "group_id").join(mean(days, "day"), "group_id")
    return tops, means
