"""Context-triggered piecewise hashes of documents, and their likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tracemesh.llm.common import id_and_text, small_batches
from tracemesh.session import materialise

#: Bytes that the rolling hash sees.
WINDOW = 7
#: Chunks of a signature at most, the last one not counted.
CHUNKS = 64
SMALLEST = 1
#: Block sizes that a fingerprint has signatures for, each twice the one before.
SIZES = 3
#: Bytes that are hashed at a time.
STRETCH = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of every ``WINDOW`` bytes, at the place of the last; fewer at the beginning of the text."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32) + 1])
    mixed = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        mixed *= np.uint32(0x2C9277B5)
        mixed += padded[k : k + len(data)]
    mixed ^= mixed >> np.uint32(16)
    mixed *= np.uint32(0x7FEB352D)
    return mixed ^ (mixed >> np.uint32(15))


def boundaries(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """``(size, ends, levels)``: the block size, where its chunks end, and how many halvings of the hash each end passes.

    A chunk ends where the rolling hash is 0 modulo the block size.  That is the smallest power of two, ``SMALLEST`` at least,
    with at most ``CHUNKS`` ends, so every text, however long or repetitive, is covered whole by a short signature.
    """
    ends, levels, least = np.zeros(0, np.int64), np.zeros(0, np.int64), SMALLEST.bit_length() - 1
    for start in range(0, len(data), STRETCH):
        # The window reaches back over the cut between two stretches.
        back = max(0, start - WINDOW + 1)
        hashed = rolling(np.frombuffer(data, np.uint8, min(STRETCH, len(data) - start) + start - back, back))[start - back :]
        at = np.flatnonzero((hashed & np.uint32((1 << least) - 1)) == 0)
        low = hashed[at]
        # The lowest set bit of a hash tells all block sizes that it ends a chunk for.
        level = np.where(low == 0, 32, np.log2((low & -low).astype(np.float64) + (low == 0)).astype(np.int64))
        ends, levels = np.concatenate([ends, at + start + 1]), np.concatenate([levels, level])
        while len(ends) > CHUNKS and least < 33:
            least += 1
            ends, levels = ends[levels >= least], levels[levels >= least]
    return 1 << least, ends, levels


def signature(data: bytes, ends: np.ndarray) -> str:
    """Two letters, twelve bits, for each chunk; what is left after the last end is a chunk too."""
    out, start = [], 0
    for end in [*ends.tolist(), len(data)]:
        if end > start:
            h = xxhash.xxh64_intdigest(data[start:end])
            out.append(LETTERS[h & 63] + LETTERS[h >> 6 & 63])
            start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    """``size:signature:signature:signature``, the block size and signatures for it, twice and four times as much.

    Equal texts have equal fingerprints.
    """
    data = text.encode()
    size, ends, levels = boundaries(data)
    first = size.bit_length() - 1
    return ":".join([str(size), *(signature(data, ends[levels >= first + k]) for k in range(SIZES))])


def common_chunks(left: str, right: str) -> int:
    """The length of the longest common subsequence of two signatures, by rows of bits."""
    at: dict[str, int] = {}
    for k in range(0, len(left), 2):
        at[left[k : k + 2]] = at.get(left[k : k + 2], 0) | 1 << (k >> 1)
    n = len(left) // 2
    row = full = (1 << n) - 1
    for k in range(0, len(right), 2):
        hit = row & at.get(right[k : k + 2], 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def _alike(left: str, right: str) -> float:
    """1 less the edit distance, by insertions and deletions, over the chunks of both."""
    chunks = (len(left) + len(right)) // 2
    return 2 * common_chunks(left, right) / chunks if chunks else 1.0


def likeness(left: str, right: str) -> float:
    """0 to 1 for two fingerprints: that of the signatures at block sizes that both have, the best if there are two, else 0."""
    if left == right:
        return 1.0
    own, other = ({int(size) << k: signed for k, signed in enumerate(signatures)} for size, *signatures in (left.split(":"), right.split(":")))
    return max((_alike(own[size], other[size]) for size in own.keys() & other.keys()), default=0.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, fingerprint)``, one row per input row, without a shuffle.

    Null counts as an empty text, whose fingerprint has no chunks; repeated rows and null ids have a row each; an empty
    table gives none; only ``doc_id`` and ``text`` of ``docs`` are read; a long text is hashed whole, in stretches.
    """
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield pa.record_batch([batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return id_and_text(docs).mapInArrow(rows, "doc_id bigint, n_chars bigint, fingerprint string")


@F.pandas_udf(DoubleType())
def likeness_column(left, right):
    """The likeness of two columns of fingerprints."""
    return left.combine(right, lambda a, b: None if a is None or b is None else likeness(a, b))


def edited(text: str, after: str) -> str:
    """``text`` with its last half of code points, rounded down, replaced by the first as many (or all) of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(doc_id: int | None, text: str, mark: str, after: str, after_mark: str) -> dict:
    changed = edited(text, after)
    changed_mark = fingerprint(changed)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": mark,
        "edited_fingerprint": changed_mark, "near_edited": likeness(mark, changed_mark), "near_next": likeness(mark, after_mark),
    }


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document, in descending order of id.

    Returns ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one row per input
    row.  The edited text is that of :func:`edited` with the next document, which after the last one is the first.
    Rows of one id are in the order of a hash of their text, then of the text; null ids come last; null counts as an empty
    text; the only row of a table is its own next; an empty table gives no rows; only ``doc_id`` and ``text`` are read.

    Texts are moved once, into ranges of ids, and each task goes through its range in order with two texts in hand.  The first and
    the last text of each range are kept with the written result, and the last ones are judged in a second step, where
    the first of the next range is joined to them: two texts a range, whatever their number.
    """
    small_batches(docs.sparkSession)
    columns = [c.split(" ")[0] for c in RESULT.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in columns[2:5]], *[(c, pa.float64()) for c in columns[5:]], ("part", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                mark = fingerprint(text)
                if held is None:
                    out.append({"doc_id": doc_id, "fingerprint": mark, "part": part, "role": "first", "text": text})
                else:
                    out.append({**_judged(*held, text, mark), "part": part, "role": "done"})
                held = doc_id, text, mark
            yield pa.RecordBatch.from_pylist(out, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "fingerprint": held[2], "part": part, "role": "last", "text": held[1]}], schema)

    # The place of a row breaks the ties of equal rows, so that any number of them can be cut into ranges.
    rows = id_and_text(docs).withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("_hash"), F.col("text"), F.col("_place")]
    ranged = rows.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("_hash"), F.col("_place")).sortWithinPartitions(*order)
    walked = materialise(ranged.select("doc_id", "text").mapInArrow(walk, f"{RESULT}, part bigint, role string, text string"), "walked")

    first = walked.filter("role = 'first'").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("after_mark"))
    # One narrow row per range.
    parts = walked.filter("role = 'first'").select("part")
    following = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("_next"))
    least = parts.agg(F.min("part").alias("_least"))
    following = following.join(F.broadcast(least)).select("part", F.coalesce("_next", "_least").alias("_next"))
    open_rows = walked.filter("role = 'last'").select("part", "doc_id", "text", "fingerprint").join(following, "part")
    open_rows = open_rows.join(first.withColumnRenamed("part", "_next"), "_next").select("doc_id", "text", "fingerprint", "after", "after_mark")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "fingerprint", "after", "after_mark")), strict=True)
            yield pa.RecordBatch.from_pylist([_judged(*row) for row in given], pa.schema(list(schema)[: len(columns)]))

    return walked.filter("role = 'done'").select(*columns).unionByName(open_rows.mapInArrow(close, RESULT))
