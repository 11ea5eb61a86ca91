"""A small set of lines that shows every value of a group."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.session import discard, materialise

log = logging.getLogger(__name__)


def line_cover(entries: DataFrame) -> DataFrame:
    """Greedy cover: always the line with the most values not yet shown, the first such line on ties.

    Returns ``(group_id, line)``.  All groups advance together, and many lines at a time: each open value is
    reserved for the best of its lines, by open values and then by number, and a line that holds all its
    values is taken.  The one-by-one rule takes it too: open values of a line only become fewer, and
    until this line is taken no line that shares a value with it comes first.  Chains of lines that wait for one
    other line with as many open values are decided in the same round, see ``_certain``.  Rounds are logged.
    Entries without a group, line or value are left out.
    """
    per_line = Window.partitionBy("group_id", "line")
    gain = F.count(F.lit(1)).over(per_line)
    left = materialise(entries.select("group_id", "line", "value").dropna().distinct().withColumn("gain", gain), "cover")
    chosen: DataFrame | None = None
    rounds = 0
    while chosen is None or not left.isEmpty():
        taken = _certain(left)
        shown = left.join(taken, ["group_id", "line"], "left_semi").select("group_id", "value").distinct()
        before = left
        still = left.drop("gain").join(shown, ["group_id", "value"], "left_anti")
        left = materialise(still.withColumn("gain", gain), "cover")
        discard(before)
        chosen = taken if chosen is None else chosen.unionByName(taken)
        rounds += 1
    log.info("line_cover: %d rounds", rounds)
    return chosen


def _certain(left: DataFrame) -> DataFrame:
    """``(group_id, line)`` of the lines that are certain to be taken, the best of each group among them.

    A line that holds all its values is taken.  A line that is second of two in the others, always behind the same line with
    as many open values, is taken if that line is not, since that line then loses a value and falls behind; so along a chain of
    such lines the parity of the distance decides.
    """
    value = ["group_id", "value"]
    best = F.min(F.struct((-F.col("gain")).alias("loss"), F.col("line").alias("line")))
    first = left.groupBy(*value).agg(best.alias("first"), F.count(F.lit(1)).alias("n"))
    blocker = F.when(F.col("line") != F.col("first.line"), F.col("first.line"))
    several = blocker.isNotNull() & ((F.col("n") > 2) | (F.col("first.loss") != -F.col("gain")))
    lines = left.join(first, value).groupBy("group_id", "line").agg(
        F.bool_or(several).alias("several"), F.min(blocker).alias("low"), F.max(blocker).alias("high")
    )
    single = lines.filter("NOT several AND low IS NOT DISTINCT FROM high")
    state = single.select("group_id", "line", F.coalesce("low", "line").alias("up"), F.col("low").isNotNull().alias("odd"), F.col("low").isNull().alias("free"))
    state = materialise(state, "taken")
    while not state.filter("NOT free").isEmpty():
        above = state.select("group_id", F.col("line").alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"), F.col("free").alias("_free"))
        # What is behind a line with several blockers meets no row and is left out.
        moved = state.join(above, ["group_id", "up"]).select(
            "group_id", "line", F.col("_up").alias("up"), (F.col("odd") != F.col("_odd")).alias("odd"), F.col("_free").alias("free")
        )
        before, state = state, materialise(moved, "taken")
        discard(before)
    return state.filter("NOT odd").select("group_id", "line")


def cover_values(entries: DataFrame, cover: DataFrame) -> DataFrame:
    """The values of each chosen line, one row each, with the first timestamp of the line."""
    kept = entries.join(cover, ["group_id", "line"], "left_semi")
    stamped = F.when(F.col("timestamp") != "", F.struct("pos", "timestamp"))
    per_value = kept.groupBy("group_id", "line", "value").agg(F.min(stamped).alias("_s"))
    first = per_value.groupBy("group_id", "line").agg(F.min("_s").alias("_t"))
    return per_value.join(first, ["group_id", "line"]).select(
        "group_id", "line", "value", F.coalesce("_t.timestamp", F.lit("N/A")).alias("timestamp")
    )
