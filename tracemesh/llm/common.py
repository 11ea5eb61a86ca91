"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh.session import materialise

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BROADCAST_MARKS = 2_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` alone, with an empty text for null, so that no other column of ``docs`` can clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def id_key(doc_id: Column) -> Column:
    """A join key that is null-safe: null ids equal each other and no other id."""
    return F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n"))


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Let no more than ``rows`` documents at a time reach a Python worker, which bounds its memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def labelled(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``(doc_id, text, y)`` of the documents in ``marked(doc_id, y)``, which is unique on the id.

    Up to two million marks, some 50 MB, are broadcast, so that no text moves; more are joined by a shuffle.
    """
    marked = materialise(marked, "marked")
    few = marked.count() <= BROADCAST_MARKS
    return id_and_text(docs).join(F.broadcast(marked) if few else marked, "doc_id").select("doc_id", "text", "y")


def remainder(doc_id: Column, folds: int) -> Column:
    """The fold of a document: the CRC-32 of its decimal id, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
