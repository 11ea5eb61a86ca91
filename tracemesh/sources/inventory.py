"""What lies in a folder: every file with its size and number of lines, also empty files and those that cannot be read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh.session import materialise

#: Bytes that one row of the counting job stands for, and bytes read at once.
RANGE, READ = 64 << 20, 1 << 20
#: Fixed value: the bytes that a line of an unreadable file is taken to have.
BYTES_A_LINE = 100


def _opened(location: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(location.replace("s3a://", "s3://", 1))


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark gives it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole if "://" in whole else whole.replace("file:", "file://", 1)


def _listed(location: str, recursive: bool) -> list[tuple[str, bool, int | None]]:
    """``(location, is_folder, size)`` of what lies in a folder, without names that begin with a dot or an underscore."""
    files, base = _opened(location)
    prefix = location[: location.replace("s3a://", "s3://", 1).rfind(base)] if base in location else "file://"
    found = files.get_file_info(fs.FileSelector(base, recursive=recursive))
    inside = lambda path: path[len(base) :].strip("/").split("/")
    shown = [i for i in found if not any(part[0] in "._" for part in inside(i.path))]
    return [(prefix + i.path, i.type == fs.FileType.Directory, i.size) for i in shown]


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(location, size)`` of all files below ``folder``.

    The driver lists the folder itself; each folder in it is listed by a task.
    """
    top = _listed(_qualified(spark, folder), recursive=False)
    rows = spark.createDataFrame([(n, *row) for n, row in enumerate(top)], "n bigint, location string, is_folder boolean, size bigint")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for location in batch["location"].to_pylist():
                files = [{"location": at, "size": size} for at, is_folder, size in _listed(location, recursive=True) if not is_folder]
                yield pa.RecordBatch.from_pylist(files, pa.schema([("location", pa.string()), ("size", pa.int64())]))

    folders = rows.filter("is_folder").select("n", "location")
    folders = folders.repartition(max(1, min(sum(r[1] for r in top), 10_000)), "n").select("location")
    return rows.filter("NOT is_folder").select("location", "size").unionByName(folders.mapInArrow(below, "location string, size bigint"))


def _count(location: str, at: int, end: int, size: int) -> int:
    """Line ends from ``at`` to ``end``; a last line without one counts too."""
    files, name = _opened(location)
    lines, last = 0, b"\n"
    with files.open_input_file(name) as file:
        while at < end:
            data = file.read_at(min(READ, end - at), at)
            if not data:
                raise OSError("the file is shorter than it was")
            lines, at, last = lines + data.count(b"\n"), at + len(data), data[-1:]
    return lines + (end == size and last != b"\n")


def file_inventory(spark: SparkSession, folder: str, block: int = RANGE) -> DataFrame:
    """``(location, size, events, error)`` of all files below ``folder``.

    ``events`` is the number of lines, of bytes in any encoding; empty files have none.  A file is counted in blocks by several tasks.  Where
    a file cannot be read, ``error`` says why and ``events`` is its size divided by ``BYTES_A_LINE``; the other files are not affected.
    The files are listed when the function is called, and read when the result is.
    """
    files = materialise(list_files(spark, folder), "files")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, errors = [], []
            for r in batch.to_pylist():
                try:
                    lines.append(_count(r["location"], r["at"], min(r["at"] + block, r["size"]), r["size"]))
                    errors.append(None)
                except (OSError, pa.ArrowException) as error:
                    lines.append(None)
                    errors.append(str(error) or type(error).__name__)
            yield pa.record_batch([batch["location"], pa.array(lines, pa.int64()), pa.array(errors, pa.string())], ["location", "lines", "error"])

    # An empty file has a block too, so that it is opened.
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(block).cast("bigint"))).alias("at")
    blocks = files.select("location", "size", at)
    dealt = blocks.repartition("location", "at")
    counts = dealt.mapInArrow(counted, "location string, lines bigint, error string").groupBy("location").agg(F.sum("lines").alias("lines"), F.min("error").alias("error"))
    guess = F.floor(F.col("size") / BYTES_A_LINE)
    events = F.when(F.col("error").isNull(), F.col("lines")).otherwise(guess).cast("bigint")
    return files.join(counts, "location").select("location", "size", events.alias("events"), "error")
