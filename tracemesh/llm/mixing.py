"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.llm.common import WORD, fresh, id_key

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"


def source_key(source: Column) -> Column:
    """Orders like the source by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unit_interval(*parts) -> Column:
    """A number from 0 up to 1 that depends on the parts only."""
    joined = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``(source_key, source_size, target)`` from one row per source.

    A target is ``min(weight * level, limit * size)``.  Leaving out the sources with the lowest ratio of
    limit to weight one after the other gives a candidate level each; the right one is the
    largest.  The windows see one row per source.  No source gives no row.
    """
    place = F.row_number().over(Window.orderBy("source_key"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * limit)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    free = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = F.max(F.col("free").cast("double") / F.col("heavy")).over(everything)
    table = table.withColumns({"free": free, "heavy": F.sum("weight").over(after)}).withColumn("level", level)
    return table.select("source_key", "source_size", F.least(F.col("weight") * F.col("level"), F.col("most").cast("double")).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """``(doc_id, source_key, size, source_size, target, copies)``, one row per input row.

    Inside a source every document expects ``target / source_size`` copies.  Documents stand in the
    order of falling size, so that what the sampling misses on one document it makes up on one of about
    that size; the expected copies are summed along that order, a random offset per source is added, and a
    document is taken once per whole number that the sum passes.  The sum has three levels, so no window
    holds a source: sizes within a source, 4096 slices (of a hash of the id) within a size, rows within a slice.

    Null and empty texts have size 0.  A source without any word is taken once, as it has no rate.  Null ids
    and repeated rows are rows like any other.  An empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        source_key(F.col("source")).alias("source_key"),
        text_size(F.col("text")).alias("size"),
        F.md5(key.cast("binary")).alias("hash"),
    ).withColumn("slice", F.substring("hash", 1, 3))
    level, cell = ["source_key", "size"], ["source_key", "size", "slice"]
    slices = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    sizes = slices.groupBy(*level).agg(F.sum("n").alias("n"))
    sources = sizes.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sources, weights, limit)

    def earlier(keys, order):
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    sizes = sizes.select(*level, earlier(["source_key"], F.desc("size")).alias("larger")).join(targets, "source_key")
    starts = slices.select(*cell, earlier(level, "slice").alias("before")).join(sizes, level)
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("hash", "doc_id"))
    placed = rows.withColumn("place", inside).join(starts, cell)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    offset = unit_interval(f"{seed}:", F.col("source_key"))
    last = F.col("larger") + F.col("before") + F.col("place")
    copies = F.floor(offset + rate * last) - F.floor(offset + rate * (last - 1))
    return placed.select("doc_id", "source_key", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: the words that the mix takes of each document, repeats counted."""
    plan = mix_plan(docs, weights, limit, seed)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns.

    Rows that agree in id, source and size share their copies evenly.  Null ids and repeated rows are rows like any other, null and
    empty texts have size 0, texts may be of any length, and an empty table gives an empty result.
    """
    names = [fresh(docs, n) for n in ("_key", "_source", "_size", "_copies", "_ties", "_place")]
    key, source, size, copies, ties, place = names
    plan = mix_plan(docs, weights, limit, seed).groupBy(
        id_key(F.col("doc_id")).alias(key), F.col("source_key").alias(source), F.col("size").alias(size)
    ).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(ties))
    keyed = docs.withColumns({key: id_key(docs["doc_id"]), source: source_key(docs["source"]), size: text_size(docs["text"])})
    joined = keyed.join(plan.filter(F.col(copies) > 0), [key, source, size])
    among = F.row_number().over(Window.partitionBy(key, source, size).orderBy(key))
    own = F.floor(F.col(copies) / F.col(ties)) + (F.col(place) <= F.col(copies) % F.col(ties)).cast("bigint")
    times = F.explode(F.expr(f"sequence(1L, `{copies}`)"))
    counted = joined.withColumn(place, among).withColumn(copies, own).filter(F.col(copies) > 0)
    return counted.withColumn(place, times).select(*[F.col(f"`{c}`") for c in docs.columns])
