"""Parts of text files: the first lines, and samples of blocks, by positioned reads in tasks.

Spark's text reader reads whole files.  Where Arrow's file systems can open the files (local, S3, GCS, HDFS with its native
library) and none is compressed, a task can read as many bytes as it needs instead.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of files that Spark's text reader decompresses.
COMPRESSED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate", ".xz")
FIRST_READ = 1 << 16
LARGEST_READ = 1 << 24
RANGE = 1 << 24
SAMPLE_BLOCK = 1 << 20
#: Blocks that a task counts, 64 MB at the default size.
BLOCKS_A_TASK = 64

ReadAt = Callable[[int, int], bytes]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size)`` of the files under ``path``; no contents are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"))


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def can_read_ranges(files: DataFrame) -> bool:
    """Whether tasks can read parts of these files."""
    compressed = files.filter(F.lower(F.substring_index("path", "/", -1)).rlike("(" + "|".join(e.replace(".", r"\.") for e in COMPRESSED) + r")\z"))
    first = files.select("path").first()
    if first is None or not compressed.isEmpty():
        return False
    try:
        located, name = _located(first["path"])
        with located.open_input_file(name):
            return True
    except (pa.ArrowException, OSError, ValueError):
        return False


# --- the first lines of files


def first_lines(read_at: ReadAt, size: int, limit: int) -> Iterator[bytes]:
    """Up to ``limit`` lines without their ends, by reads that grow from 64 KB to 16 MB and stop with the last line wanted."""
    at, length, rest, found = 0, FIRST_READ, b"", 0
    while at < size and found < limit:
        data = read_at(at, min(length, size - at))
        at, length = at + len(data), min(2 * length, LARGEST_READ)
        *lines, rest = (rest + data).split(b"\n")
        for line in lines[: limit - found]:
            yield line
        found += len(lines)
    if rest and found < limit:
        yield rest


def read_first_lines(files: DataFrame, limit: int) -> DataFrame:
    """``(path, line, text)`` of the first ``limit`` lines of each file; bytes that are not UTF-8 are replaced."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch["path"].to_pylist(), batch["size"].to_pylist(), strict=True):
                located, name = _located(path)
                with located.open_input_file(name) as file:
                    held, number = [], 0
                    for line in first_lines(lambda at, n: file.read_at(n, at), size, limit):
                        held.append(line.removesuffix(b"\r").decode(errors="replace"))
                        if len(held) == 1000:
                            yield _lines(path, number, held)
                            held, number = [], number + 1000
                    yield _lines(path, number, held)

    tasks = max(1, min(files.count(), files.sparkSession.sparkContext.defaultParallelism * 4))
    return files.repartition(tasks, "path").mapInArrow(rows, "path string, line bigint, text string")


def _lines(path: str, before: int, texts: list[str]) -> pa.RecordBatch:
    numbers = pa.array(range(before + 1, before + len(texts) + 1), pa.int64())
    return pa.record_batch([pa.array([path] * len(texts), pa.string()), numbers, pa.array(texts, pa.string())], ["path", "line", "text"])


# --- estimates of how many lines there are


def _ranges_of(size: int, exact_below: int, share: float, block: int, seed: int) -> list[tuple[int, int, int, int, bool]]:
    """``(stratum, blocks of the stratum, start, length, exact)`` of what is read of a file.

    Files up to ``exact_below`` bytes, or all for a share of 1, are read whole.  Larger ones are cut into blocks, and these into strata of neighbours, so many that
    two blocks of each make up about ``share`` of the file; the choice follows from the seed and the size of the file.
    """
    if size <= exact_below or share >= 1:
        return [(0, 1, start, min(RANGE, size - start), True) for start in range(0, size, RANGE)]
    blocks = -(-size // block)
    strata = max(1, min(blocks // 2, round(blocks * share / 2)))
    rng = random.Random(zlib.crc32(f"{seed}:{size}".encode()))
    found = []
    for h in range(strata):
        low, high = blocks * h // strata, blocks * (h + 1) // strata
        for b in rng.sample(range(low, high), min(2, high - low)):
            found.append((h, high - low, b * block, min(block, size - b * block), False))
    return found


def line_estimates(
    files: DataFrame, exact_below: int, share: float = 0.02, block: int = SAMPLE_BLOCK, seed: int = 1
) -> DataFrame:
    """``(path, size, lines, error, bytes_read)`` per file: an estimate of its lines with its standard error.

    A stratified sample: in each stretch of a file, line ends are counted in two blocks at random places, and the
    mean stands for the blocks of the stretch, of which only the last of the file can be shorter.  The error comes from the differences within the pairs, so it is 0 where all was read.
    A line without an end counts, if the last byte of the file says so.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size in zip(batch["path"].to_pylist(), batch["size"].to_pylist(), strict=True):
                for stratum, population, start, length, exact in _ranges_of(size, exact_below, share, block, seed):
                    out.append({"path": path, "size": size, "stratum": stratum, "population": population, "start": start, "length": length, "exact": exact})
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_pylist(out, planned)
                        out = []
                if size:
                    out.append({"path": path, "size": size, "stratum": -1, "population": 1, "start": size - 1, "length": 1, "exact": True})
            yield pa.RecordBatch.from_pylist(out, planned)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for path, start, length, stratum in zip(*(batch[c].to_pylist() for c in ("path", "start", "length", "stratum")), strict=True):
                located, name = _located(path)
                with located.open_input_file(name) as file:
                    data = file.read_at(length, start)
                ends.append(int(data != b"\n") if stratum == -1 else data.count(b"\n"))
            yield pa.record_batch([*batch.columns, pa.array(ends, pa.int64())], [*batch.schema.names, "ends"])

    fields = [("path", pa.string()), ("size", pa.int64()), ("stratum", pa.int64()), ("population", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("exact", pa.bool_())]
    planned = pa.schema(fields)
    schema = "path string, size bigint, stratum bigint, population bigint, start bigint, length bigint, exact boolean"
    ranges = files.mapInArrow(plan, schema)
    total = files.agg(F.coalesce(F.sum(F.when(F.col("size") <= exact_below, F.col("size")).otherwise(F.col("size") * share)), F.lit(0))).first()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, int(total // (BLOCKS_A_TASK * SAMPLE_BLOCK)))
    counted = ranges.repartition(tasks, "path", "start").mapInArrow(count, f"{schema}, ends bigint")
    strata = counted.groupBy("path", "size", "stratum", "population", "exact").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ends").alias("ends"), F.sum(F.col("ends") * F.col("ends")).alias("squares"), F.sum("length").alias("length")
    )
    n, population = F.col("n"), F.col("population")
    lines = F.when(F.col("exact") | (n == population), F.col("ends")).otherwise(F.col("ends") / n * population)
    spread = F.when(n > 1, (F.col("squares") - F.col("ends") * F.col("ends") / n) / (n - 1)).otherwise(0.0)
    variance = F.when(F.col("exact") | (n == population), 0.0).otherwise(population * (population - n) * spread / n)
    return strata.groupBy("path", "size").agg(
        F.sum(lines).cast("double").alias("lines"), F.sqrt(F.sum(variance)).alias("error"), F.sum(F.when(F.col("stratum") >= 0, F.col("length")).otherwise(1)).alias("bytes_read")
    )
