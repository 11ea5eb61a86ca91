"""Quality classifier over learned vectors of hashed words and character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.llm.common import fresh, id_and_text, remainder, small_batches
from tracemesh.session import discard, materialise

BUCKETS = 1 << 17
WIDTH = 8
NGRAMS = (3, 4, 5)
#: Passes over the sample, and steps at least, which takes more passes over a small sample.
EPOCHS, STEPS = 6, 8000
RATE = 0.5
#: At most so many labelled documents, and no further one past so many bytes, are used to fit; every document is scored.
SAMPLE, SAMPLE_BYTES = 5000, 1 << 25
FOLDS, HELD_OUT = 3, 1

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x5851F42D4C957F2D)  # odd


def _scatter(h: np.ndarray, buckets: int) -> np.ndarray:
    """The top bits of a product, as a bucket."""
    return (h * _MULTIPLIER >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all words, steps from one word to the next, and n-grams of bytes inside a word.

    Words are runs of anything but ASCII white space, with a blank before and after as part of the
    n-grams.  A step is the difference of two word hashes, so a word that is said again gives the same step
    whatever the word.  A text without a word has no features.
    """
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    data = raw.astype(np.uint64) + np.uint64(1)
    blank = raw == 32
    found = []
    with np.errstate(over="ignore"):
        # n-grams: blanks only at their ends
        inner = np.concatenate([[0], np.cumsum(blank)])
        for n in NGRAMS:
            count = len(raw) - n + 1
            if count <= 0:
                continue
            h = np.full(count, n, np.uint64)
            for k in range(n):
                h = h * _STEP + data[k : k + count]
            pure = inner[n - 1 : n - 1 + count] == inner[1 : count + 1]
            found.append(_scatter(h[pure], buckets))
        # word hashes: sums over the word of byte * step ** place in the word
        starts = np.flatnonzero(blank[:-1]) + 1
        ends = np.flatnonzero(blank)[1:]
        place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
        table = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()) + 1, _STEP, np.uint64)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(data * table[place], dtype=np.uint64)])
        word = total[ends] - total[starts]
        found.append(_scatter(word, buckets))
        found.append(_scatter(word[1:] - word[:-1] + np.uint64(7), buckets))
    return np.concatenate(found)


@dataclass
class SubwordModel:
    """What the vectors and the softmax come to: a document's log-odds are the mean weight of its features plus a bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        ids = features(text, len(self.weights))
        odds = self.bias + (float(self.weights[ids].mean()) if len(ids) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


class Bags:
    """The different features of documents and how often each occurs.

    All are in one buffer, five or six bytes a feature, so that a worker holds no text but that of the batch it reads, and gives the memory back.
    """

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.data = buckets, bytearray()
        self.at: list[tuple[int, int, np.dtype]] = []

    def add(self, texts: Iterable[str]) -> None:
        for text in texts:
            ids, counts = np.unique(features(text, self.buckets), return_counts=True)
            small = np.min_scalar_type(counts.max(initial=0))
            self.at.append((len(self.data), len(ids), small))
            self.data += ids.astype(np.int32).tobytes()
            self.data += counts.astype(small).tobytes()

    def sort(self, keys: Sequence[int]) -> np.ndarray:
        """Put the documents in the order of ``keys``, and return that order."""
        order = np.argsort(np.asarray(keys, np.int64), kind="stable")
        self.at = [self.at[k] for k in order]
        return order

    def __getitem__(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        start, n, small = self.at[d]
        counts = np.frombuffer(self.data, small, n, start + 4 * n) if n else np.zeros(0, small)
        return np.frombuffer(self.data, np.int32, n, start) if n else np.zeros(0, np.int32), counts.astype(np.int64)


def train(texts: Iterable[str], labels: Sequence[int], buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> SubwordModel:
    """The model of some texts; see :func:`descend`."""
    bags = Bags(buckets)
    bags.add(texts)
    return descend(bags, labels, width, epochs, rate, seed)


def descend(bags: Bags, labels: Sequence[int], width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> SubwordModel:
    """Stochastic gradient descent, one document a step, classes weighed alike, the rate falling to zero.

    The vectors of a document's features are averaged and go through a softmax over two classes.
    """
    rng, buckets = np.random.default_rng(seed), bags.buckets
    vectors = (rng.random((buckets, width), dtype=np.float32) - np.float32(0.5)) / np.float32(width)
    output, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    y = np.asarray(labels, np.int64)
    present = [k for k in (0, 1) if (y == k).any()]
    if len(present) < 2:  # nothing to tell apart
        return SubwordModel(np.zeros(buckets, np.float32), float({(): 0.0, (0,): -3.0, (1,): 3.0}[tuple(present)]))
    balance = len(y) / (2 * np.bincount(y, minlength=2))
    epochs = max(epochs, -(-STEPS // len(y)))
    steps, at = epochs * len(y), 0
    for _ in range(epochs):
        for d in rng.permutation(len(y)):
            step = rate * (1 - at / steps) * balance[y[d]]
            at += 1
            ids, counts = bags[d]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            hidden = share @ vectors[ids]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            back = output @ p
            output -= step * np.outer(hidden, p)
            bias -= step * p
            # The step of a vector is not divided by the length of the document, so that rare features learn too.
            vectors[ids] -= (step * np.minimum(share * 20, 1))[:, None] * back
    side = output[:, 1] - output[:, 0]
    return SubwordModel((vectors @ side).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def _sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int, sample_bytes: int) -> DataFrame:
    """``(doc_id, text, y)``: one row per labelled document of the sample, however many rows share its id."""
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = marked.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Combined before the shuffle: an id on a third of all rows sends one row per task.
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = materialise(rows, "sample")
    earlier = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text")).over(earlier), F.lit(0))
    within = rows.select("doc_id", before.alias("before")).filter(F.col("before") < sample_bytes).select("doc_id")
    return rows.join(F.broadcast(within), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> SubwordModel:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, drawn by a hash of their id.

    In that order, documents that begin past ``sample_bytes`` bytes of text are left out of the sample.  The fitting runs as one task on that
    bounded sample; the model that comes back has a fixed size.  Null labels and rows without an id are left out; of several labels of a
    document the largest counts, of several texts the smallest.  Without a labelled document every score is a half.
    """
    rows = _sampled(docs, labels, label, sample, sample_bytes)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags, ids, y = Bags(), [], []
        for batch in batches:
            bags.add(batch["text"])
            ids += batch["doc_id"].tolist()
            y += batch["y"].tolist()
        model = descend(bags, np.array(y, np.int64)[bags.sort(ids)])
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    small_batches(docs.sparkSession)
    row = rows.repartition(1).mapInPandas(fitted, "weights binary, bias double").first()
    discard(rows)
    return SubwordModel(np.frombuffer(row["weights"], np.float32), row["bias"]) if row else train([], [])


def _scored(rows: DataFrame, text: str, out: str, model: SubwordModel) -> DataFrame:
    small_batches(rows.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in texts], dtype="float64")

    return rows.withColumn(out, score(F.col(f"`{text}`")))


def score_quality(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, repeated ones too; null and empty texts get the score of the bias.

    Rows without an id are scored and are not held out.  Texts may be of any length.  An empty table gives an empty result.
    """
    rows = _scored(id_and_text(docs), "text", "score", model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns.

    Rows without an id, repeated rows, and null or empty texts are judged like any other.  An empty table gives an empty result.
    """
    score = fresh(docs, "_score")
    return _scored(docs, "text", score, model).filter(F.col(score) >= 0.5).drop(score)
