"""Tokens of two tokenizers over the same texts, aligned by as-of merges of their byte ranges."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh.llm.common import id_and_text, small_batches
from tracemesh.llm.token_files import byte_letters
from tracemesh.operators.order import join_counted
from tracemesh.session import materialise

#: Characters of text that are aligned at a time, or one text.
PORTION = 400_000
#: Id pairs, of 25 bytes each, that are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000


class ByteCoder:
    """The first side: a byte-level BPE file, whose tokens are spelled with a letter per byte.

    The merges of such a file are listed in the order of the ids they make, which is checked, so merging by the lowest
    id, as ``tiktoken`` does at several times the speed, gives the ids of the file's own library.
    """

    def __init__(self, tokenizer_json: str, pattern: str):
        file = json.loads(tokenizer_json)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        special = {t["content"] for t in file["added_tokens"]}
        vocab = {t: i for t, i in file["model"]["vocab"].items() if t not in special}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
        if made != sorted(made) or file["normalizer"] is not None or file["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level BPE file")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.encoding = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class PieceCoder:
    """The second side: a sentencepiece model, which puts a space before the text itself."""

    def __init__(self, model: bytes):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        spelled = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)]

    def encode(self, text: str) -> list[int]:
        return self.pieces.encode(text)


class Aligner:
    def __init__(self, tokenizer_json: str, pattern: str, model: bytes):
        self.sides = ByteCoder(tokenizer_json, pattern), PieceCoder(model)
        self.lengths = [np.array([len(t) for t in side.bytes_of], np.int64) for side in self.sides]
        # What follows an id in writing: more of its side, the other side, the next group.
        self.written = [np.array([f"{i}{mark}" for mark in ",|;" for i in range(len(side.bytes_of))], object) for side in self.sides]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both sides; none for a text that either side does not spell out byte by byte."""
        if not text:
            return [], []
        data, ids = (" " + text).encode(), [side.encode(text) for side in self.sides]
        same = all(b"".join([side.bytes_of[i] for i in own]) == data for side, own in zip(self.sides, ids, strict=True))
        return (ids[0], ids[1]) if same else ([], [])

    def align(self, texts: list[str | None]) -> "Aligned":
        coded = [self.tokens(t) for t in texts]
        frames = []
        for side, name in enumerate("ab"):
            doc = np.repeat(np.arange(len(texts)), [len(c[side]) for c in coded])
            ids = np.fromiter((i for c in coded for i in c[side]), np.int64, len(doc))
            size = self.lengths[side][ids]
            end = np.cumsum(size)
            frames.append(pd.DataFrame({"doc": doc, "at": end - size, f"{name}": np.arange(len(doc)), f"{name}_end": end, f"{name}_id": ids}))
        a, b = frames
        # Both sides spell the same bytes, so offsets run through the documents of a batch and are sorted already.
        under = pd.merge_asof(a, b, on="at", by="doc")
        over = pd.merge_asof(b, a, on="at", by="doc")
        begins_alike = a["at"].to_numpy()[over["a"].to_numpy()] == over["at"].to_numpy()
        both = pd.concat([under, over[~begins_alike]], ignore_index=True)
        return Aligned(len(texts), a, b, both, self.written)


@dataclass
class Aligned:
    """Tokens of both sides of some documents, numbered through, and ``overlaps``: all pairs that share a byte."""

    n_docs: int
    a: pd.DataFrame
    b: pd.DataFrame
    overlaps: pd.DataFrame
    written: list[np.ndarray]

    def links(self) -> pd.DataFrame:
        """The overlapping pairs that end together; each ends a group."""
        return self.overlaps[self.overlaps["a_end"] == self.overlaps["b_end"]]

    def groups(self, links: pd.DataFrame) -> list[str]:
        """Per document the ids of its groups, ``a1,a2|b1;a3|b2,b3``."""
        marks, ordinal = [], []
        for frame, name in ((self.a, "a"), (self.b, "b")):
            last = np.zeros(len(frame), np.int64)
            last[links[name].to_numpy()] = 1
            marks.append(last)
            ordinal.append(np.cumsum(last) - last)
        sizes = [np.bincount(o, minlength=len(links)) for o in ordinal]
        before_a = np.cumsum(sizes[1]) - sizes[1]  # tokens of the other side that are written earlier
        place_a = np.arange(len(self.a)) + before_a[ordinal[0]]
        place_b = np.arange(len(self.b)) + np.cumsum(sizes[0])[ordinal[1]]
        texts = np.empty(len(self.a) + len(self.b), object)
        texts[place_a] = self.written[0][self.a["a_id"].to_numpy() + marks[0] * (len(self.written[0]) // 3)]
        texts[place_b] = self.written[1][self.b["b_id"].to_numpy() + marks[1] * 2 * (len(self.written[1]) // 3)]
        ends = np.cumsum(self.counts("a") + self.counts("b"))
        return ["".join(texts[s:e])[:-1] for s, e in zip([0, *ends], ends, strict=False)]

    def counts(self, side: str) -> np.ndarray:
        return np.bincount((self.a if side == "a" else self.b)["doc"], minlength=self.n_docs)


@dataclass(frozen=True)
class Tokenizers:
    """Both files, read on the driver and broadcast: two vocabularies of fixed size."""

    first: object
    pattern: str
    second: object

    def aligner(self) -> Aligner:
        return _aligner(self.first.value, self.pattern, self.second.value)


@lru_cache(maxsize=2)
def _aligner(tokenizer_json: str, pattern: str, model: bytes) -> Aligner:
    return Aligner(tokenizer_json, pattern, model)


def read_tokenizers(spark: SparkSession, tokenizer_json: str, pattern: str, piece_model: str) -> Tokenizers:
    with open(tokenizer_json, encoding="utf-8") as first, open(piece_model, "rb") as second:
        return Tokenizers(spark.sparkContext.broadcast(first.read()), pattern, spark.sparkContext.broadcast(second.read()))


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """The rows of a batch, some ``PORTION`` characters or one text at a time."""
    ids, texts = batch["doc_id"], batch["text"].to_pylist()
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text or "") > PORTION:
            yield ids.slice(start, k - start), texts[start:k]
            start, size = k, 0
        size += len(text or "")
    if texts:
        yield ids.slice(start), texts[start:]


def align(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups, links)``, one row per input row.

    ``groups`` writes the ids between two offsets at which tokens of both sides end, ``a1,a2|b1;a3|b2,b3``; ``links``
    is an array of ``(a, b, times)``, the id pairs whose byte ranges end together and how often they do.  A text that
    is null, empty, or not spelled out by both sides has no tokens; repeated rows and null ids have a row each; an empty
    table gives none; only ``doc_id`` and ``text`` of ``docs`` are read.  A long text is aligned by itself, whole.
    """
    small_batches(docs.sparkSession)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = tokenizers.aligner()
        for batch in batches:
            for ids, texts in _portions(batch):
                found = aligner.align(texts)
                links = found.links().sort_values("a")
                doc = found.a["doc"].to_numpy()[links["a"].to_numpy()]
                width = len(aligner.lengths[1])
                pair = links["a_id"].to_numpy() * width + links["b_id"].to_numpy()
                key, times = np.unique(doc * (len(aligner.lengths[0]) * width) + pair, return_counts=True)
                of_doc, pair = np.divmod(key, len(aligner.lengths[0]) * width)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of_doc, minlength=len(texts)))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(pair // width, pa.int32()), pa.array(pair % width, pa.int32()), pa.array(times, pa.int32())], ["a", "b", "times"])
                yield pa.record_batch(
                    [
                        ids, pa.array(found.counts("a")), pa.array(found.counts("b")), pa.array(np.bincount(doc, minlength=len(texts))),
                        pa.array(found.groups(links), pa.string()), pa.ListArray.from_arrays(pa.array(ends), pairs),
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
                )

    return id_and_text(docs).mapInArrow(
        aligned, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<struct<a:int,b:int,times:int>>"
    )


def token_overlaps(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """``(doc_id, a, b, start, end)``: tokens by their place in the text that share the bytes from start to end, exclusive.

    The same texts as in :func:`align` have no rows.
    """
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = tokenizers.aligner()
        for batch in batches:
            for ids, texts in _portions(batch):
                found = aligner.align(texts)
                o, a, b = found.overlaps, found.a, found.b
                doc = o["doc"].to_numpy()
                first = {s: np.cumsum(found.counts(s)) - found.counts(s) for s in "ab"}
                sizes = np.zeros(len(texts), np.int64)
                np.maximum.at(sizes, a["doc"].to_numpy(), a["a_end"].to_numpy())
                base = np.concatenate([[0], np.maximum.accumulate(sizes)[:-1]])[doc]
                start = np.maximum(a["at"].to_numpy()[o["a"]], b["at"].to_numpy()[o["b"]]) - base
                end = np.minimum(o["a_end"], o["b_end"]).to_numpy() - base
                columns = [o["a"].to_numpy() - first["a"][doc], o["b"].to_numpy() - first["b"][doc], start, end]
                yield pa.record_batch([ids.take(pa.array(doc)), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "a", "b", "start", "end"])

    return id_and_text(docs).mapInArrow(rows, "doc_id bigint, a bigint, b bigint, start bigint, end bigint")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, pair, count, best)``: links of each id pair in all texts, and whether no pair of its ``b`` has more.

    ``pair`` is both ids in one number.
    """
    links = aligned.select(F.explode("links").alias("l")).select("l.*")
    counts = materialise(links.groupBy("a", "b").agg(F.sum("times").alias("count")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))  # at most a row per id of the vocabulary
    best = counts.join(F.broadcast(most), "b").withColumn("best", F.col("count") == F.col("_most"))
    return best.select("a", "b", pair_key(F.col("a"), F.col("b")).alias("pair"), "count", "best")


def pair_key(a, b):
    return F.shiftleft(a.cast("bigint"), 32) + b


def link_scores(aligned: DataFrame) -> DataFrame:
    """The rows of :func:`align` without ``links``, with ``n_links``, ``n_best`` and ``count_sum``.

    ``n_best`` counts links whose id pair is the most frequent of its second id, ties included; ``count_sum`` adds the
    counts of the pairs over all links.  The rows are written once, since they are read three times.

    Counts of up to ``BROADCAST_PAIRS`` pairs are broadcast, so that the links are not shuffled; beyond, the most frequent
    thousand are, and the rest is joined by a shuffle.
    """
    rows = materialise(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(rows), "pairs")
    links = rows.select("_row", F.explode("links").alias("_l")).select("_row", F.col("_l.times").alias("_times"), pair_key(F.col("_l.a"), F.col("_l.b")).alias("pair"))
    table = counts.select("pair", "count", "best")
    if counts.count() <= BROADCAST_PAIRS:
        scored = links.join(F.broadcast(table), "pair")
    else:
        scored = join_counted(links, table, "pair", "count")
    sums = scored.groupBy("_row").agg(
        F.sum("_times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("_times") * F.col("count")).alias("count_sum"),
    )
    names = ["n_links", "n_best", "count_sum"]
    others = [c for c in aligned.columns if c != "links"]
    return rows.join(sums, "_row", "left").select(*others, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names])
