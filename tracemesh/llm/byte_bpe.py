"""Byte-level BPE by reduction over a tree of text halves."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh.llm.common import id_and_text, small_batches

LEAF = 2048
#: A white-space character after any other one begins a new piece, whatever stands before or after.
BORDER = re.compile(r"\S(?=[ \t\r\n])")


class TreeBpe:
    """Encoder and decoder for one rank table and splitting pattern.

    Encoding is a monoid: a text is cut anywhere, both halves are encoded, and the halves are joined by encoding anew
    a window around the cut.  The window grows to both sides until each end is a border, a place
    between a character that is not white space and a blank, tab or line end.  No piece of the pattern reaches over
    a border, and none depends on what is beyond it, so the tokens outside the window are those of the joined text.
    """

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {rank: token for token, rank in table.items()}
        self.size_of = {rank: len(token) for token, rank in table.items()}
        self.leaf = leaf

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf or not BORDER.search(text):
            return self.encoding.encode_ordinary(text)
        cut = len(text) // 2
        return self._join(text, cut, self.encode(text[:cut]), self.encode(text[cut:]))

    def _join(self, text: str, cut: int, left: list[int], right: list[int]) -> list[int]:
        start, end = self._border_before(text, cut), self._border_after(text, cut)
        keep = len(left) - self._tokens(reversed(left), len(text[start:cut].encode()))
        skip = self._tokens(right, len(text[cut:end].encode()))
        return left[:keep] + self.encoding.encode_ordinary(text[start:end]) + right[skip:]

    def _tokens(self, ids: Iterable[int], n_bytes: int) -> int:
        """How many of the first ``ids`` make up ``n_bytes``."""
        count = 0
        for i in ids:
            if n_bytes <= 0:
                break
            n_bytes -= self.size_of[i]
            count += 1
        return count

    @staticmethod
    def _border_before(text: str, cut: int) -> int:
        reach = 32
        while True:
            low = max(0, cut - reach)
            found = [m.end() for m in BORDER.finditer(text, low, cut)]
            if found:
                return found[-1]
            if low == 0:
                return 0
            reach *= 2

    @staticmethod
    def _border_after(text: str, cut: int) -> int:
        found = BORDER.search(text, cut)
        return found.end() if found else len(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def _coder(ranks: bytes, pattern: str) -> TreeBpe:
    return TreeBpe(ranks, pattern)


def read_ranks(spark: SparkSession, path: str):
    """The rank file, read on the driver and broadcast: a vocabulary of fixed size."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, ranks, pattern: str) -> DataFrame:
    """``(doc_id, ids)``, one row per input row; null and empty texts have no ids."""
    small_batches(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern)
        for batch in batches:
            ids = [coder.encode(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(coded, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` with the bytes that the ids stand for; null ids decode to no bytes."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern)
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], batch["ids"], pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id bigint, ids array<int>, decoded binary")


def digests(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the output of :func:`decode`, with ``ids`` if wanted."""
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        *(["ids"] if keep_ids else []),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
