"""Order-dependent building blocks that never sort one group in one task.

A window over ``partitionBy(key)`` puts every row of a key into one task.  These
helpers cut each key into bounded slices first, work inside the slices, and
carry the small per-slice result over the slice borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.session import materialise

SLICE = 1 << 16
LOOKUP_BYTES = 64 << 20
SALTS = 16


def number_rows(df: DataFrame, order: Sequence[str], out: str, within: Sequence[str] = ()) -> DataFrame:
    """1-based consecutive numbers by ``order`` (which must be unique), globally or per ``within`` key.

    Rows are range-partitioned, numbered inside each partition, and shifted by the
    rows of earlier partitions.  Only a key that began in an earlier partition needs
    a shift, so the shift table has at most one row per partition.
    """
    within, order = list(within), list(order)
    if not within:
        return _number_all(df, order, out)
    # The partition must not change between the two uses below, hence the written table.
    sliced = df.repartitionByRange(*within, *order).withColumn("_slice", F.spark_partition_id())
    sliced = materialise(sliced, "number")
    sizes = sliced.groupBy(*within, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sizes.withColumn("_shift", F.sum("_n").over(earlier)).filter("_shift > 0").select(*within, "_slice", "_shift")
    )
    local = F.row_number().over(Window.partitionBy("_slice", *within).orderBy(*order))
    return (
        sliced.withColumn(out, local.cast("bigint"))
        .join(F.broadcast(shifts), [*within, "_slice"], "left")
        .withColumn(out, F.col(out) + F.coalesce("_shift", F.lit(0)))
        .drop("_slice", "_shift")
    )


def _number_all(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Global numbers: sorted partitions are written with Spark's increasing ids, which hold the partition and the place in it."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(placed, "number").withColumn("_slice", F.shiftright("_id", 33))
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    number = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_shift") + 1
    return placed.join(F.broadcast(shifts), "_slice").withColumn(out, number).drop("_id", "_slice", "_shift")


def previous_value(df: DataFrame, group: str, pos: str, value: Column, out: str, size: int = SLICE) -> DataFrame:
    """``lag(value)`` within ``group`` ordered by the integer ``pos``, which must be unique in the group.

    Groups of more than ``size`` rows are cut into slices, the rows with the same ``pos div size``: at most ``size`` rows.  The
    first row of a later slice takes its value from the last row of the slice before it.  Such groups are few, as each has
    more than ``size`` rows, and are broadcast.
    """
    wide = F.broadcast(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size).select(group, F.lit(True).alias("_wide")))
    cut = F.when(F.col("_wide"), F.expr(f"{pos} div {size}")).otherwise(F.lit(0))
    sliced = df.withColumn("_value", value).join(wide, group, "left").withColumn("_slice", cut)
    inside = Window.partitionBy(group, "_slice").orderBy(pos)
    lagged = sliced.withColumn(out, F.lag("_value").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = sliced.filter("_wide").groupBy(group, "_slice").agg(F.max_by("_value", pos).alias("_last"))
    borders = (
        last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(group).orderBy("_slice")))
        .filter(F.col("_carry").isNotNull())
        .select(group, "_slice", "_carry")
    )
    return (
        lagged.join(borders, [group, "_slice"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(out)))
        .drop("_value", "_wide", "_slice", "_first", "_carry")
    )


def join_counted(left: DataFrame, table: DataFrame, key: str, count: str, hot: int = 1000) -> DataFrame:
    """Inner join with a table that is unique on ``key`` and knows how often each key occurs in ``left``.

    The ``hot`` most frequent keys are joined by broadcast, a fixed number of rows, so
    that none of their rows is shuffled; the others occur in less than one in ``hot`` rows each.
    """
    top = table.orderBy(F.desc(count), key).limit(hot)
    frequent = left.join(F.broadcast(top), key)
    rest = left.join(F.broadcast(top.select(key)), key, "left_anti").join(table, key)
    return frequent.unionByName(rest)


def join_lookup(left: DataFrame, table: DataFrame, key: str, spread_by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a lookup table, of which few rows share a key, whatever share of ``left`` one key has.

    The table is written and measured: up to ``LOOKUP_BYTES`` of JSON text it is broadcast; beyond, it is repeated
    ``SALTS`` times, and the rows of ``left`` are dealt to the copies by a hash of ``spread_by``.
    """
    table = materialise(table, "lookup")
    size = table.agg(F.sum(F.length(F.to_json(F.struct(*table.columns))))).first()[0] or 0
    if size <= LOOKUP_BYTES:
        return left.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")
