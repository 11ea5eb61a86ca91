"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemesh.llm.common import id_and_text, labelled, remainder, small_batches
from tracemesh.session import materialise

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Strength of the prior of a token, in occurrences.
PRIOR = 4.0
#: Lengths in characters of the beginnings that pass their rate on to longer ones.
STEMS = (4, 5, 6)
#: What every token costs, so that chance passages stay short.
DRIFT = 1.0
#: Labelled documents to learn from at most, about, chosen by a hash of their id.  It bounds the entries of the model, all of which are kept.
LEARNED = 400_000
#: What an entry must differ by from what it would inherit, in log-odds.
GAIN = 0.25
#: Occurrences of a token, or beginning, that it takes to have an entry.
SUPPORT = 3
#: A text is toxic if chance makes its passages as good as that with at most this probability.
SIGNIFICANT = 0.002

#: What str.split() takes for white space.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def tokens_of(text: str) -> list[str]:
    """Lower-cased words without ASCII punctuation at their ends; what is punctuation only remains as an empty token."""
    return [w.strip(_EDGES) for w in text.lower().split()]


class OddsTable:
    """Log-odds by name, in two sorted arrays of 16 bytes an entry; a name stands under its 64-bit hash."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], odds[order]

    def __len__(self) -> int:
        return len(self.keys)

    def get(self, name: str) -> float | None:
        key = np.int64(xxhash.xxh64_intdigest(name.encode(), seed=42) - (1 << 63)) ^ np.int64(-1 << 63)
        at = self.keys.searchsorted(key)
        return float(self.odds[at]) if at < len(self.keys) and self.keys[at] == key else None


@dataclass
class ToxicModel:
    """Log-odds of tokens and beginnings, the two numbers of the extreme-value law, and what clean texts exceed it by."""

    odds: dict[str, float] | OddsTable
    decay: float = 1.0
    rate: float = 1.0
    shift: float = 0.0
    known: dict[str, float] = field(default_factory=dict)

    def token(self, token: str) -> float:
        """The entry of the token or of its longest known beginning, less the drift."""
        found = self.odds.get(token)
        for n in reversed(STEMS):
            if found is not None:
                break
            found = self.odds.get(token[:n] + "*") if len(token) >= n else None
        return (found or 0.0) - DRIFT

    def scores(self, tokens: Sequence[str]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        try:
            return np.array([known[t] for t in tokens])
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = self.token(t)
            return np.array([known[t] for t in tokens])

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]], np.ndarray]:
        """Number of tokens, ``(first, end, score)`` of every maximal passage in token positions, and the token scores.

        The passages are those of the scores as they are.  Inside a passage the k-th time that it says the same telling
        token counts for a k-th, and its score is that of the best stretch in it: a passage that is one word over
        and over has said it once, and takes nothing from what else it says.
        """
        tokens = tokens_of(text)
        scores = self.scores(tokens)
        found = []
        for first, end, score in maximal_segments(scores):
            said: dict[str, int] = {}
            own = scores[first:end].copy()
            for i in np.flatnonzero(own > 0).tolist():
                said[tokens[first + i]] = k = said.get(tokens[first + i], 0) + 1
                if k > 1:
                    own[i] = (own[i] + DRIFT) / k - DRIFT
            if any(k > 1 for k in said.values()):
                total = np.concatenate([[0.0], np.cumsum(own)])
                score = float((total[1:] - np.minimum.accumulate(total)[:-1]).max())
            found.append((first, end, score))
        return len(scores), found, scores

    def normal(self, n: int, score: float) -> float:
        """The score of a passage in units in which chance puts ``exp(-x)`` passages beyond ``x`` into ``n`` tokens."""
        return self.decay * score - math.log(max(self.rate * n, 1e-300))

    def evidence(self, n: int, scores: Sequence[float]) -> float:
        """Minus the logarithm of how likely chance makes passages as good as the best ones of a text.

        The best ``r`` together: the sum of their normal scores exceeds ``t`` with probability
        ``exp(-t) t^(r-1) / (r! (r-1)!)``; every ``r`` is tried, at the price of a factor ``2^r``.
        """
        best, total = -50.0, 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            x = self.normal(n, score)
            if r > 1 and x <= 0:
                break
            total += x
            law = total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2)
            best = max(best, law)
        return best

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text, one half where chance reaches ``SIGNIFICANT``, and its significant passages.

        A passage is significant alone, or as one of those with a positive normal score in a text that is beyond one half.
        """
        n, found, _ = self.passages(text)
        over = self.evidence(n, [s for *_, s in found]) - self.shift + math.log(SIGNIFICANT)
        weighed = [(s, e, self.normal(n, score)) for s, e, score in found]
        return 1 / (1 + math.exp(-min(max(over, -50.0), 50.0))), [p for p in weighed if over >= 0 and p[2] > 0]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, end, score)`` in linear time.

    A run keeps the candidates so far with the running total before and after each.  A new positive token joins
    back to the last candidate that begins lower, unless that one ends at least as high.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, before, after, place of the last candidate that begins lower
    for k in np.flatnonzero(scores > 0).tolist():
        first, end, before, after = k, k + 1, total[k], total[k + 1]
        while True:
            lower = len(stack) - 1
            while lower >= 0 and stack[lower][2] >= before:
                lower = stack[lower][4]
            if lower < 0 or stack[lower][3] >= after:
                stack.append((first, end, before, after, lower))
                break
            first, before = stack[lower][0], stack[lower][2]
            del stack[lower:]
    return [(s, e, float(after - before)) for s, e, before, after, _ in stack]


def token_counts(rows: DataFrame) -> DataFrame:
    """``(token, toxic, clean)``: documents of either class that have the token, from ``(text, y)``.

    Documents, not occurrences: a word that one text says a hundred times says no more than one said once.
    """
    tokens = F.array_distinct(F.transform(F.split(F.lower("text"), _BLANKS), lambda w: F.trim(w, F.lit(_EDGES))))
    return rows.select(F.explode(tokens).alias("token"), "y").filter("token <> ''").groupBy("token").agg(
        F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")
    )


def log_odds(counts: DataFrame) -> OddsTable:
    """Log-odds of tokens and beginnings against the corpus, all that differ by ``GAIN`` or more from what they inherit.

    A beginning of 4 characters has a Dirichlet prior with the toxic share of all tokens, one of 5 characters a prior
    with the posterior share of its first 4, and so on to the token itself.  An entry that says
    what its parent says is not needed.
    """
    counts = materialise(counts, "token-counts")
    all_ = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not all_["toxic"] or not all_["clean"]:
        return OddsTable(np.zeros(0, np.int64), np.zeros(0))
    base = all_["toxic"] / (all_["toxic"] + all_["clean"])
    logit = lambda p: F.log(p / (1 - p))
    share = lambda prior: (F.col("toxic") + PRIOR * prior) / (F.col("toxic") + F.col("clean") + PRIOR)
    table, parent = [], None
    for n in (*STEMS, None):
        name = F.concat(F.substring("token", 1, n), F.lit("*")) if n else F.col("token")
        level = counts.filter(F.length("token") >= n) if n else counts
        level = level.groupBy(name.alias("name")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        level = level.filter(F.col("toxic") + F.col("clean") >= SUPPORT)
        if parent is None:
            level = level.withColumn("prior", F.lit(base))
        else:
            # The longest shorter beginning that has a share of its own.
            shorter = [k for k in STEMS if n is None or k < n]
            level = level.withColumn("up", F.concat(F.substring("name", 1, shorter[-1]), F.lit("*")))
            level = level.join(parent, "up", "left").withColumn("prior", F.coalesce("share", F.lit(base))).drop("up", "share")
        level = level.withColumn("share", share(F.col("prior")))
        if n:
            parent = materialise(level.select(F.col("name").alias("up"), "share"), "stems")
        gain = F.abs(logit(F.col("share")) - logit(F.col("prior")))
        table.append(level.select("name", (logit(F.col("share")) - logit(F.lit(base))).alias("odds"), gain.alias("gain")))
    everything = table[0]
    for level in table[1:]:
        everything = everything.unionByName(level)
    told = everything.filter(F.col("gain") >= GAIN).select(F.xxhash64("name").alias("key"), "odds").toArrow()
    return OddsTable(told["key"].to_numpy(), told["odds"].to_numpy())


def calibrate(model: ToxicModel, clean: DataFrame) -> ToxicModel:
    """Fit the extreme-value law of the best passage to the texts of ``clean`` documents.

    The decay solves ``sum p(s) exp(decay * s) = 1`` over the token scores of clean text; given it, the
    rate is the maximum-likelihood one for the best scores and lengths.  Last, the evidence is shifted so that no more than a
    share ``SIGNIFICANT`` of the clean texts is beyond one half.  Only sums come back from the tasks.
    """

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                n, found, scores = model.passages(text)
                bins, counts = np.unique(np.round(scores * 4).astype(np.int64), return_counts=True)
                rows.append((n, sorted((s for *_, s in found), reverse=True), bins.tolist(), counts.tolist()))
            types = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["n", "best", "bins", "counts"])

    small_batches(clean.sparkSession)
    seen = clean.select("text").mapInArrow(passages, "n bigint, best array<double>, bins array<bigint>, counts array<bigint>").filter("n > 0")
    seen = materialise(seen, "calibration")
    bins = seen.select(F.explode(F.arrays_zip("bins", "counts")).alias("b")).groupBy("b.bins").agg(F.sum("b.counts").alias("n"))
    histogram = [(r["bins"] / 4, r["n"]) for r in bins.collect()]  # scores lie between fixed bounds, so do the bins
    everything = sum(n for _, n in histogram)
    if not everything:
        return model
    low, high = 0.05, 3.0  # the decay is looked for in these bounds
    for _ in range(60):
        middle = (low + high) / 2
        if sum(n * math.exp(middle * s) for s, n in histogram) > everything:
            high = middle
        else:
            low = middle
    model.decay = low
    top = F.coalesce(F.get("best", F.lit(0)), F.lit(0.0))
    sums = seen.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("n") * F.exp(-model.decay * top)).alias("mass")).first()
    model.rate = sums["docs"] / max(sums["mass"], 1e-9)

    @F.pandas_udf("double")
    def evidence(n: pd.Series, best: pd.Series) -> pd.Series:
        return pd.Series([model.evidence(k, b) for k, b in zip(n, best, strict=True)], dtype="float64")

    edge = seen.agg(F.percentile_approx(evidence("n", "best"), 1 - SIGNIFICANT, 10_000).alias("edge")).first()["edge"]
    model.shift = max(0.0, edge + math.log(SIGNIFICANT))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicModel:
    """Learn from all labelled documents outside the held-out fold.

    One further fold of them is left out of the counts and calibrates the passages.  Null labels and rows without an id are
    left out; of several labels of a document the largest counts.  Without labels of both classes nothing is toxic.
    Of more than ``LEARNED`` labelled documents, a share of about so many is learned from.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("y")).filter(~held_out(F.col("doc_id")))
    n = marked.count()
    if n > LEARNED:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < LEARNED)
    rows = labelled(docs, marked).withColumn("fold", remainder(F.col("doc_id"), FOLDS))
    model = ToxicModel(log_odds(token_counts(rows.filter(F.col("fold") != CALIBRATION))))
    if not model.odds:
        return model
    return calibrate(model, rows.filter((F.col("fold") == CALIBRATION) & (F.col("y") == 0)))


def toxic_passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``(doc_id, score, passages)`` for every row; a passage has its first token, its end and minus the logarithm of its E-value.

    Null and empty texts have no passage and a score below one half; a text is scanned as a whole.
    """
    small_batches(docs.sparkSession)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
        for batch in batches:
            found = [model.judge(t) for t in batch["text"].to_pylist()]
            passages = [[{"first": s, "end": e, "evidence": x} for s, e, x in p] for _, p in found]
            yield pa.record_batch([batch["doc_id"], pa.array([f[0] for f in found], pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return id_and_text(docs).mapInArrow(judged, "doc_id bigint, score double, passages array<struct<first:int,end:int,evidence:double>>")


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_passages)``, one row per input row."""
    found = toxic_passages(docs, model)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("bigint").alias("n_passages")
    )
