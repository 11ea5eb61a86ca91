"""SimHash fingerprints, linked through the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemesh.llm.common import fresh, id_and_text, small_batches
from tracemesh.llm.components import component_labels
from tracemesh.operators.order import join_counted
from tracemesh.session import materialise

WIDTH = 4
SEED = 42
DISTANCE = 4
#: Rows of one anchor that are compared in one step.
CELL = 4096
#: The blocks of the fingerprint: first bit, bits in the Hamming code, bits taken as they are.
BLOCKS = ((0, 15, 6), (21, 15, 6), (42, 15, 7))
HASHES = 1 << 15


def simhash(text: str, width: int = WIDTH) -> int:
    """The fingerprint of one text, unsigned; 0 without a word."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - width + 1)
    last = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        shingles = zip(ends[at : min(at + HASHES, n)], ends[at + last : min(at + HASHES, n) + last], strict=True)
        h = np.array([digest(joined[s : e - 1], SEED) for s, e in shingles], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)``, one row per input row; ``fp`` holds the 64 bits in a signed integer.

    Null and empty texts have fingerprint 0.  A text is hashed as a whole, in steps of bounded memory.
    """
    small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t, width) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.record_batch([batch["doc_id"], pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(hashed, "doc_id bigint, fp bigint")


@lru_cache(maxsize=1)
def hamming_neighbours() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word its code word, and the up to 8 code words within distance 2, padded with -1.

    The code is the perfect Hamming code: the bits of a code word, counted from 1, that are set have
    positions whose exclusive or is 0.  Every word is within distance 1 of one code word, so the code covers
    with radius 1.
    """
    words = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    home = np.where(syndrome == 0, words, words ^ (1 << np.maximum(syndrome - 1, 0)))
    near = np.full((1 << 15, 8), -1)
    near[:, 0] = home
    # Two flips at positions p and q reach the code if p ^ q is the syndrome.
    column = np.ones(1 << 15, np.int64)
    for p in range(1, 16):
        for q in range(p + 1, 16):
            hit = np.flatnonzero(syndrome == p ^ q)
            near[hit, column[hit]] = hit ^ (1 << (p - 1)) ^ (1 << (q - 1))
            column[hit] += 1
    return home, near


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, home)``: the anchors that each fingerprint is sent to.

    Two fingerprints that differ in at most 4 bits differ in at most 1 bit of one of the 3 blocks.  The anchors of
    a block are the words whose first 15 bits are a code word: they cover it with radius 1.  A fingerprint is sent
    to the anchors within covering radius plus threshold of its block, that is with one of the code
    words within 1 + 1 and the other bits as they are, or its nearest code word and one other bit changed.
    The nearest anchor of one of the two is then among the anchors of the other.
    """
    home_of, near_of = hamming_neighbours()
    values = fps.view(np.uint64)
    rows, keys, homes = [], [], []
    everyone = np.arange(len(fps))
    for number, (first, coded, plain) in enumerate(BLOCKS):
        word = (values >> np.uint64(first) & np.uint64((1 << coded) - 1)).astype(np.int64)
        rest = (values >> np.uint64(first + coded) & np.uint64((1 << plain) - 1)).astype(np.int64)
        key = lambda code, other, n=number: (n << 32) | (other << 15) | code
        home = key(home_of[word], rest)
        for column in near_of[word].T:
            some = np.flatnonzero(column >= 0)
            rows.append(some)
            keys.append(key(column[some], rest[some]))
        for bit in range(plain):
            rows.append(everyone)
            keys.append(key(home_of[word], rest ^ (1 << bit)))
        homes += [keys[k] == home[rows[k]] for k in range(len(homes), len(keys))]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _sent(classes: DataFrame) -> DataFrame:
    """``(anchor, fp, node, home)`` for each distinct fingerprint and anchor."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps, nodes = batch["fp"].to_numpy(np.int64), batch["node"].to_numpy(np.int64)
            row, anchor, home = anchors(fps)
            yield pd.DataFrame({"anchor": anchor, "fp": fps[row], "node": nodes[row], "home": home})

    return classes.select("fp", "node").mapInPandas(send, "anchor bigint, fp bigint, node bigint, home boolean")


def cell_links(fps: np.ndarray, nodes: np.ndarray, home: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join the same nodes as all links between a home row and another row of the cell.

    A home row is linked to one row of each group of rows that it joins, so there are about as many links as
    rows, not as many as pairs.
    """
    values, centres = fps.view(np.uint64), np.flatnonzero(home)
    group = np.arange(len(fps))
    links = []
    for at in range(0, len(centres), 256):
        some = centres[at : at + 256]
        close = np.bitwise_count(values[some, None] ^ values[None, :]) <= distance
        busy = np.flatnonzero(close.sum(axis=1) > 1)
        for k in busy:
            around = np.flatnonzero(close[k])
            met, first = np.unique(group[around], return_index=True)
            if len(met) > 1:
                links += [(int(nodes[some[k]]), int(nodes[around[f]])) for f in first]
                group[np.isin(group, met)] = met[0]
    return links


def link_fingerprints(classes: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Links ``(a, b)`` between the nodes of ``classes(fp, node)``, enough to join all within ``distance`` bits.

    Rows are compared per anchor, those at home there with all.  An anchor with more than ``cell`` rows is cut
    into a grid: its rows and its home rows are dealt into parts, and each cell of the grid compares one part of
    each, so every pair still meets and no task holds more than a cell.
    """
    if distance != DISTANCE:
        raise ValueError("the anchors are laid out for a distance of 4")
    sent = _sent(classes)
    crowded = sent.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("n_home")).filter(F.col("n") > cell)
    crowded = materialise(
        crowded.select("anchor", F.ceil(F.col("n") / cell).cast("int").alias("parts"), F.ceil(F.col("n_home") / cell).cast("int").alias("home_parts")),
        "crowded",
    )
    placed = sent.join(crowded, "anchor", "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    home_part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("home_parts")).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    as_other = F.transform(span(F.col("home_parts")), lambda i: F.struct(i.alias("i"), part.alias("j"), F.lit(False).alias("probe")))
    as_home = F.transform(span(F.col("parts")), lambda j: F.struct(home_part.alias("i"), j.alias("j"), F.lit(True).alias("probe")))
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("probe"))))
    cells = cells.when(F.col("home"), F.concat(as_other, as_home)).otherwise(as_other)
    dealt = placed.select("anchor", "fp", "node", F.explode(cells).alias("c")).select("anchor", "c.i", "c.j", "fp", "node", F.col("c.probe").alias("home"))
    keys = ["anchor", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def linked(part: pd.DataFrame) -> list[tuple[int, int]]:
            fps, nodes, home = part["fp"].to_numpy(np.int64), part["node"].to_numpy(np.int64), part["home"].to_numpy(bool)
            named = part[keys].to_numpy(np.int64)
            borders = np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1
            found = []
            for s, e in zip([0, *borders.tolist()], [*borders.tolist(), len(part)], strict=True):
                if e - s > 1 and home[s:e].any():
                    found += cell_links(fps[s:e], nodes[s:e], home[s:e], distance)
            return found

        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = (held[keys] != held[keys].iloc[-1]).any(axis=1).to_numpy().sum()  # the last cell may go on
            if whole:
                yield pd.DataFrame(linked(held.iloc[:whole]), columns=["a", "b"], dtype="int64")
                held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield pd.DataFrame(linked(held), columns=["a", "b"], dtype="int64")

    links = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a bigint, b bigint")
    return links.filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, cell: int = CELL) -> DataFrame:
    """``(doc_id, fp, component_id, n_links)``, one row per input row.

    Equal fingerprints form a class first, so groups of copies never meet pair by pair; classes are linked at
    4 differing bits or fewer.  ``component_id`` is the smallest id that can be reached.

    Null and empty texts have fingerprint 0 and are linked like any other.  Rows without an id get a fingerprint
    but no component.  Rows that repeat an id are one document.
    """
    rows = materialise(fingerprints(docs, width), "fingerprints")
    classes = rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes, "classes")
    labels = component_labels(link_fingerprints(classes, cell=cell))
    named = classes.join(labels, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id"))
    found = join_counted(rows.filter("doc_id IS NOT NULL"), named, "fp", "n").select("doc_id", "fp", "component_id")
    return found.unionByName(rows.filter("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("bigint")))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: the document with the smallest id of each group, and rows without an id."""
    key = fresh(docs, "_key")
    gone = near_duplicates(docs, width).filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    keyed = docs.withColumn(key, docs["doc_id"].cast("bigint"))
    return keyed.join(gone, key, "left_anti").select(*[keyed[c] for c in docs.columns])


def fingerprint_text(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
