"""Readers for entries, identity rows, JSON records, stop lists, dictionaries and provenance records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh.functions.times import parse_instant
from tracemesh.sources.logs import read_log

ENTRY_SCHEMA = "line BIGINT, timestamp STRING, type STRING, value STRING, identity STRING"


def read_entries(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Entries from a JSON array, or from JSON lines with ``lines=True``, with ``pos`` in input order.

    An array has to be read by one task per file; JSON lines are split like any text.
    """
    reader = spark.read.schema(ENTRY_SCHEMA).option("multiLine", str(not lines).lower())
    entries = reader.json(path).withColumn("pos", F.monotonically_increasing_id())
    return entries if limit is None else entries.orderBy("pos").limit(limit)


def read_idrows(spark: SparkSession, path: str) -> DataFrame:
    """``row_number, ts, type, value`` from comma rows; the value may hold commas, bad rows are dropped."""
    text = F.trim(F.regexp_replace("value", r"\A\s+|\s+\z", ""))
    rows = spark.read.text(path).select(text.alias("row"))
    rows = rows.filter((F.col("row") != "") & ~F.col("row").startswith('"') & ~F.col("row").endswith('"'))
    part = F.split("row", ",", 4)
    parsed = rows.filter(F.size(part) == 4).select(
        F.when(F.trim(part[0]).rlike(r"\A[+-]?\d+\z"), F.trim(part[0]).try_cast("int")).alias("row_number"),
        parse_instant(F.trim(part[1])).alias("ts"),
        F.trim(part[2]).alias("type"),
        F.trim(part[3]).alias("value"),
    )
    return parsed.filter("row_number is not null and ts is not null")


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """``(rec, json)``: JSON lines numbered in input order over all files by name; blank lines left out."""
    lines = read_log(spark, path, across_files=True).filter(F.trim("text") != "")
    return lines.select(F.col("line").alias("rec"), F.col("text").alias("json"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(vec_id, vec)`` from one JSON array of integers per line."""
    return read_json_records(spark, path).select(F.col("rec").alias("vec_id"), F.from_json("json", "array<bigint>").alias("vec"))


def read_stoplist(spark: SparkSession, path: str) -> DataFrame:
    """Values to leave out: trimmed, without blank lines and ``#`` comments."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return lines.select(F.regexp_replace("value", r"\A\s+|\s+\z", "").alias("value")).filter("value <> ''").distinct()


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A token dictionary as written by ``write_dictionary``."""
    return spark.read.schema("token_text STRING, token BIGINT, cnt BIGINT").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Provenance records, one JSON file each: ``(location, json)``."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("location"), F.col("value").alias("json"))
