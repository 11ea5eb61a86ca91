"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemesh.llm.common import fresh, id_and_text, id_key, text_digest
from tracemesh.session import materialise



def _bytes_of(rest: int, low: int = 0, high: int = 256) -> str:
    """A class of the bytes from ``low`` to below ``high`` with a remainder of ``rest`` modulo 8, written as characters."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(low + (rest - low) % 8, high, 8)) + "]"


#: A chunk of 64 bytes or more of UTF-8 ends after a character of code 3 modulo 8 and one of code 0, such as a blank, before one
#: of code 5 or one beyond ASCII, at the latest after 4096 bytes.  The last byte of a character has its code modulo 8 in any
#: script, and such a place is rare enough for the cuts of two texts to fall together again soon after a difference.
CHUNK = (
    rf"(?s).{{64,4091}}?{_bytes_of(3)}(?:{_bytes_of(0, 0, 128)}|[\xc0-\xff][\x80-\xbf]{{0,2}}{_bytes_of(0, 128, 192)})"
    rf"(?={_bytes_of(5, 0, 128)}|[\xc0-\xff])|.{{1,4096}}"
)
SALTS = 64


def recipes(docs: DataFrame, chunk: str = CHUNK) -> DataFrame:
    """``(doc_id, text_sha256, chunks, row)``; ``row`` numbers the rows and ``chunks`` lists the 64-bit identifier and the SHA-256 of each chunk in order.

    Where a chunk ends depends on the text around that place only, so an insertion
    changes the chunks near it and no others.  Chunks are of bytes, one character each for the pattern.  An empty or null
    text has no chunks.
    """
    pieces = F.regexp_extract_all(F.decode(F.col("text").cast("binary"), "ISO-8859-1"), F.lit(chunk), F.lit(0))
    identified = F.transform(pieces, lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("sha")))
    return id_and_text(docs).select("doc_id", text_digest(F.col("text")).alias("text_sha256"), identified.alias("chunks"), F.monotonically_increasing_id().alias("row"))


def chunk_table(recipe_rows: DataFrame) -> DataFrame:
    """The distinct chunks and in how many places each occurs: ``(id, sha, places)``."""
    chunks = recipe_rows.select(F.explode("chunks").alias("c"))
    return chunks.groupBy("c.id", "c.sha").agg(F.count(F.lit(1)).alias("places"))


def verified_lists(recipe_rows: DataFrame) -> DataFrame:
    """Replace ``chunks`` by ``recipe``, the ordered list of identifiers that tell different chunks apart.

    Chunks are reduced to distinct ``(id, sha)`` pairs before the shuffle.  As long as every 64-bit
    identifier stands for one SHA-256, the list of identifiers is the recipe; if two different
    chunks ever share one, the digests themselves are used.
    """
    shared = chunk_table(recipe_rows).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if shared.isEmpty():
        return recipe_rows.select("doc_id", "row", "text_sha256", F.transform("chunks", lambda c: c["id"]).alias("recipe"))
    return recipe_rows.select("doc_id", "row", "text_sha256", F.transform("chunks", lambda c: c["sha"]).alias("recipe"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Documents are equal when their recipes, the ordered lists of chunk identifiers, are; of
    equal ones the largest ``doc_id`` stays.  A text is read once; after that only identifiers
    move, 8 bytes per chunk.  Groups are counted in 64 salted parts, and rows meet their group on the
    same salted key, so a group of a third of all rows is spread over 64 tasks.

    Null texts equal empty ones.  A null id is smaller than any other.  Of rows that repeat both
    the id and the text, exactly one is kept.  An empty table gives an empty result.
    """
    rows = verified_lists(materialise(recipes(docs), "recipes"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    # Of rows that repeat an id, that with the highest number stands for it.
    parts = rows.groupBy("recipe", "salt").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("recipe").agg(F.max("top").alias("top"), F.sum("n").alias("group_size"))
    found = rows.join(parts.select("recipe", "salt").join(groups, "recipe"), ["recipe", "salt"])
    found = found.withColumn("keep_id", F.col("top.doc_id"))
    kept = F.col("row") == F.col("top.row")
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows that repeat both id and text leave one."""
    key, digest = fresh(docs, "_key"), fresh(docs, "_digest")
    stay = exact_duplicates(docs).filter("kept").select(id_key(F.col("doc_id")).alias(key), F.col("text_sha256").alias(digest))
    keyed = docs.withColumns({key: id_key(docs["doc_id"]), digest: text_digest(docs["text"])})
    return keyed.join(stay, [key, digest], "left_semi").dropDuplicates([key, digest]).select(*[keyed[c] for c in docs.columns])
