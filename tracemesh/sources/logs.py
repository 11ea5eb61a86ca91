"""Text logs as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.operators.entries import limit_lines
from tracemesh.sources import ranges
from tracemesh.session import materialise

FEW_LINES = 1_000_000
#: Fixed value: files up to this many bytes are counted, larger ones estimated.
EXACT_BELOW = 100 << 20
BROADCAST_BLOCKS = 4_000_000  # three numbers each: some 96 MB, the blocks of 500 TB


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def _without_cr(value: str):
    return F.regexp_replace(value, r"\r\z", "")


def _same_blocks(spark: SparkSession) -> None:
    """Fix how files are cut into blocks, so that a later scan cuts them alike though executors come and go.

    Unless ``spark.sql.files.minPartitionNum`` is set, the cut depends on the number of cores at the time of the scan.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, spark.sparkContext.defaultParallelism)


def read_log(spark: SparkSession, path: str, limit: int | None = None, sample: int = 1, across_files: bool = False) -> DataFrame:
    """``(path, line, text)`` with 1-based line numbers per file, for local paths and object stores alike.

    ``across_files`` numbers on from one file to the next, by file name.

    A first pass counts the lines of each file block and writes that small table.  A line's number is its
    place in its task, less that of the first line of its block, plus the lines of earlier blocks.  Blocks are
    looked up by a 64-bit hash of path and offset, so the table holds three numbers per block; it is broadcast, and the text
    is not shuffled, up to ``BROADCAST_BLOCKS``.  Beyond that, or if two blocks shared a hash, path and offset are joined.

    With a ``limit`` of up to ``FEW_LINES``, a task reads no more of a file than its first lines take, where the files allow it
    (:mod:`tracemesh.sources.ranges`); otherwise the lines are numbered as above and the rest left out.

    Both passes must cut the files into the same blocks: ``spark.sql.files.minPartitionNum`` is set in the session if it is
    not, and a line whose block the first pass has not seen, in the same task, is an error, never left out.
    """
    if limit is not None and limit <= FEW_LINES:
        files = ranges.listing(spark, path)
        if ranges.can_read_ranges(files):
            return limit_lines(_first_lines(files, limit, across_files), limit, sample)
    _same_blocks(spark)
    lines = _text(spark, path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
        _without_cr("value").alias("text"),
    )
    key = F.xxhash64("path", "_block").alias("_key")
    blocks = materialise(lines.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start")), "blocks")
    # One row per file block, so even over all files the window stays small.
    order = Window.orderBy("path", "_block") if across_files else Window.partitionBy("path").orderBy("_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start") + 1).alias("_shift")
    task = lambda place: F.shiftright(place, 33)
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("different")).first()
    if size["n"] == size["different"] and size["n"] <= BROADCAST_BLOCKS:
        numbered = lines.withColumn("_key", key).join(F.broadcast(blocks.select(key, shift, "_start")), "_key", "left")
    else:
        numbered = lines.join(blocks.select("path", "_block", shift, "_start"), ["path", "_block"], "left")
    known = task(F.col("_place")) == task(F.col("_start"))
    line = F.when(known, F.col("_place") + F.col("_shift")).otherwise(F.raise_error(F.lit("the files changed, or were cut differently, between two passes")).cast("bigint"))
    return limit_lines(numbered.select("path", line.alias("line"), "text"), limit, sample)


def _first_lines(files: DataFrame, limit: int, across_files: bool) -> DataFrame:
    found = ranges.read_first_lines(files, limit)
    if not across_files:
        return found
    # A file before which there are fewer than ``limit`` lines was preceded by whole files only, so its shift is right.
    found = materialise(found, "first-lines")
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.select("path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")).filter(F.col("_shift") < limit)
    return found.join(shifts, "path").select("path", (F.col("line") + F.col("_shift")).alias("line"), "text")


def count_events(spark: SparkSession, path: str) -> DataFrame:
    """``(location, size, events)`` per file; Spark does not list empty files."""
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sizes = sizes.select(F.col("_metadata.file_path").alias("_path"), F.col("path").alias("location"), F.col("length").alias("size"))
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    counts = lines.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("events"))
    return sizes.join(counts, "_path", "left").select("location", "size", F.coalesce("events", F.lit(0)).alias("events"))


def line_estimates(spark: SparkSession, path: str, exact_below: int = EXACT_BELOW, share: float = 0.02, block: int = ranges.SAMPLE_BLOCK) -> DataFrame:
    """``(path, size, lines, error, bytes_read)`` per file: lines counted up to ``exact_below`` bytes, estimated from some ``share`` beyond.

    Line lengths differ within a file, so the estimate rests on blocks from all of it and comes with its standard error.
    Compressed files, and those on file systems that only Spark can read, are counted.
    """
    files = ranges.listing(spark, path)
    if ranges.can_read_ranges(files):
        return ranges.line_estimates(files, exact_below, share, block)
    counts = _text(spark, path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("_n"))
    counted = files.join(counts, "path", "left").withColumn("lines", F.coalesce("_n", F.lit(0)).cast("double"))
    return counted.select("path", "size", "lines", F.lit(0.0).alias("error"), F.col("size").alias("bytes_read"))


def estimate_lines(spark: SparkSession, path: str, exact_below: int = EXACT_BELOW) -> int:
    """The number of lines in all files, as far as they are larger than ``exact_below`` bytes by an estimate."""
    return round(line_estimates(spark, path, exact_below).agg(F.coalesce(F.sum("lines"), F.lit(0.0))).first()[0])
