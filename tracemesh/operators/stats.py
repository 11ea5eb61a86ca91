"""Counts and frequency reports over classified values and entries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.functions import vkey
from tracemesh.operators.entries import filter_types

#: Fixed value: the occurrences allowed where no share of the lines is given.
UNSHARED_MOST = 1000


def category_stats(found: DataFrame) -> DataFrame:
    """Count and whole-number percentage per category, from ``categories`` arrays or a ``category`` column."""
    if "categories" in found.columns:
        found = found.select(F.explode("categories").alias("category"))
    counts = found.groupBy("category").agg(F.count(F.lit(1)).alias("cnt"))
    # The window runs over the categories, of which there are at most ten.
    total = F.sum("cnt").over(Window.partitionBy())
    return counts.withColumn("percentage", F.round(F.col("cnt") / total * 100)).orderBy(F.desc("cnt"), "category")


def run_summary(lines: DataFrame, found: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """One row: lines processed, labels given, source.

    A run stopped by ``limit`` counts the line at which it stopped.
    """
    seen = lines.agg(F.count(F.lit(1)).alias("n"))
    if limit is not None:
        seen = seen.select(F.least("n", F.lit(limit + 1)).alias("n"))
    labels = F.size("categories") if "categories" in found.columns else F.lit(1)
    total = found.agg(F.coalesce(F.sum(labels), F.lit(0)).cast("bigint").alias("total_classifications"))
    return total.select(
        F.lit(source).alias("source"),
        seen.scalar().alias("total_lines_processed"),
        "total_classifications",
    )


def findings_sample(findings: DataFrame, order: Iterable[str], k: int = 25) -> DataFrame:
    """The first ``k`` findings, as shown in a report."""
    return findings.orderBy(*order).limit(k)


def value_frequency(entries: DataFrame, types: str | Iterable[str] | None = None) -> DataFrame:
    """Entries (not lines) per type and value."""
    return filter_types(entries, types).groupBy("type", "value").agg(F.count(F.lit(1)).alias("cnt"))


def line_count(entries: DataFrame) -> DataFrame:
    """One row with the number of distinct lines, before any type filter."""
    return entries.agg(F.countDistinct("line").alias("lines"))


def frequency_report(entries: DataFrame, types: str | Iterable[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values with their share of all lines; ties by type and value."""
    top = value_frequency(entries, types).orderBy(F.desc("cnt"), "type", "value").limit(k)
    share = F.col("cnt") / line_count(entries).scalar() * 100
    return top.withColumn("share", share)


def frequency_cap(entries: DataFrame, max_freq: float, greedy: bool = True, most: int = UNSHARED_MOST):
    """The largest count that still qualifies, as a scalar column: ``max_freq`` percent of the lines, or ``most`` if that is not positive."""
    if greedy and max_freq <= 0:
        return F.lit(most)
    cap = entries.agg(F.floor(F.lit(max_freq) / 100.0 * F.countDistinct("line")).alias("cap"))
    return cap.scalar()


def qualifying_values(
    entries: DataFrame,
    types: str | Iterable[str] | None = None,
    max_freq: float = 10.0,
    greedy: bool = True,
    most: int = UNSHARED_MOST,
) -> DataFrame:
    """Values that occur at least twice and in no more than ``max_freq`` percent of the lines.

    In greedy mode a ``max_freq`` of 0 or less asks for at most ``most`` occurrences instead.
    """
    return value_frequency(entries, types).filter(
        (F.col("cnt") >= 2) & (F.col("cnt") <= frequency_cap(entries, max_freq, greedy, most))
    )


def value_lines(entries: DataFrame, types: str | Iterable[str] | None = None) -> DataFrame:
    """The inverted index value to line, one row per pair; kept flat because a value may be on any number of lines."""
    return (
        filter_types(entries, types)
        .groupBy("type", "value", "line")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def identity_summary(tagged: DataFrame) -> DataFrame:
    """Per identity: entries, lines (listed up to five), distinct values with three samples.

    The samples come from ranked rows, which Spark prunes before the shuffle, so a
    large identity is never gathered in one place.
    """
    tagged = tagged.filter("identity is not null")
    lines = tagged.groupBy("identity", "line").agg(F.count(F.lit(1)).alias("n"))
    values = tagged.select("identity", vkey(F.col("type"), F.col("value")).alias("vkey")).distinct()

    def first(df: DataFrame, column: str, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("identity").orderBy(column))
        head = df.withColumn("_rank", rank).filter(F.col("_rank") <= k)
        return head.groupBy("identity").agg(F.array_sort(F.collect_list(column)).alias(f"{column}_head"))

    counts = lines.groupBy("identity").agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("lines"))
    distinct_values = values.groupBy("identity").agg(F.count(F.lit(1)).alias("distinct_values"))
    line_text = F.when(F.col("lines") <= 5, F.array_join(F.col("line_head").cast("array<string>"), ", ")).otherwise(
        F.concat(F.col("lines").cast("string"), F.lit(" unique lines"))
    )
    more = F.when(
        F.col("distinct_values") > 3, F.concat(F.lit(" (+ "), (F.col("distinct_values") - 3).cast("string"), F.lit(" more)"))
    ).otherwise("")
    return (
        counts.join(distinct_values, "identity")
        .join(first(lines, "line", 5), "identity")
        .join(first(values, "vkey", 3), "identity")
        .select(
            "identity",
            "entries",
            "lines",
            "distinct_values",
            line_text.alias("line_list"),
            F.concat(F.array_join("vkey_head", ", "), more).alias("samples"),
        )
    )
