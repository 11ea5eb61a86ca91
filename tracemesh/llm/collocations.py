"""Collocations from an FM-index per shard over word ids, summed across the shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.llm.common import small_batches
from tracemesh.operators.order import join_counted, number_rows
from tracemesh.session import discard, materialise

#: Words of a shard, or one text.
SHARD = 1 << 20
#: Places in the marks of frequent phrases: a prime just below 2^27, so the marks take 16 MB at any size of the input.
MARKS = (1 << 27) - 39
SPLIT = b".,;:!?\n\x0b\x0c\r"
_PIECE_END = bytes.maketrans(SPLIT, b"\xff" * len(SPLIT))  # a byte that UTF-8 never has


# --- the index of one shard


def _sorted_by(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order by several columns of non-negative numbers, packed into one key as far as they fit."""
    key, most = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if most * width >= 1 << 62:
            kinds, key = np.unique(key, return_inverse=True)
            most = len(kinds)
        key, most = key * width + column, most * width
    return np.argsort(key, kind="stable")


class _Order:
    """One direction of the index: the word beyond each row of the sorted text, and where that word's rows are."""

    def __init__(self, words: np.ndarray, step: int, depth: int, starts: np.ndarray):
        rows = _sorted_by([np.roll(words, -step * k) for k in range(depth)])
        self.beyond = np.roll(words, step)[rows].astype(np.int64)
        self.starts = starts
        at = np.argsort(self.beyond, kind="stable")
        self.found = self.beyond[at] * len(words) + at
        self.n = len(words)

    def lead_to(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The first row that begins with ``word`` and goes on as rows from ``row`` on do: one step of backward search."""
        return np.searchsorted(self.found, word * self.n + row)


@dataclass
class Intervals:
    """Phrases, a row of ``words`` each, with their first rows in both directions and how many rows they have."""

    words: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray

    def filter(self, kept: np.ndarray) -> "Intervals":
        return Intervals(self.words[kept], self.forward[kept], self.backward[kept], self.size[kept])


class ShardIndex:
    """A bidirectional FM-index over word ids, in which 0 stands between pieces.

    The text is sorted by its next ``depth`` words, and by its previous ones, which is all that phrases of up to ``depth``
    words need: their rows stand together in both orders, and a step of backward search leads from those of a
    phrase to those of the phrase one word longer.
    """

    def __init__(self, words: np.ndarray, depth: int):
        words = np.concatenate([[0], words, [0]]).astype(np.int64)
        self.counts = np.bincount(words)
        starts = np.cumsum(self.counts) - self.counts
        self.starts = starts
        self.width = len(starts)
        self.forward, self.backward = _Order(words, 1, depth, starts), _Order(words, -1, depth, starts)

    def single_words(self) -> Intervals:
        words = np.flatnonzero(self.counts)
        words = words[words > 0]
        return Intervals(words[:, None], self.starts[words], self.starts[words], self.counts[words])

    def extend(self, phrases: Intervals, right: bool) -> Intervals:
        """Every phrase that is one word longer on the given side, with its rows; pieces end phrases."""
        order = self.backward if right else self.forward
        own, other = (phrases.backward, phrases.forward) if right else (phrases.forward, phrases.backward)
        begins = np.cumsum(phrases.size) - phrases.size
        rows = np.repeat(own - begins, phrases.size) + np.arange(int(phrases.size.sum()))
        keys = np.sort(np.repeat(np.arange(len(own)), phrases.size) * self.width + order.beyond[rows])
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        size = np.diff(first, append=len(keys))
        parent, word = np.divmod(keys[first], self.width)
        # Rows of a phrase are sorted by the new word in the other direction, behind those of smaller words.
        moved = other[parent] + first - begins[parent]
        kept = word > 0
        parent, word, size, moved = parent[kept], word[kept], size[kept], moved[kept]
        led = order.lead_to(word, own[parent])
        old = phrases.words[parent]
        grown = np.hstack([old, word[:, None]] if right else [word[:, None], old])
        return Intervals(grown, moved, led, size) if right else Intervals(grown, led, moved, size)

    def phrases(self, length: int, allowed: Callable[[np.ndarray, int], np.ndarray]) -> Intervals:
        """All phrases of ``length`` words whose phrases of each smaller length are ``allowed``, grown right and left by turns."""
        found = self.single_words()
        for k in range(2, length + 1):
            found = self.extend(found, right=k % 2 == 0)
            if k > 2:
                found = found.filter(allowed(found.words[:, :-1], k - 1))
                found = found.filter(allowed(found.words[:, 1:], k - 1))
        return found


# --- shards of a corpus


class _Ids(dict):
    """Numbers of words in the order of first use; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(numbers, "<i4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def word_shards(docs: DataFrame) -> DataFrame:
    """``(shard, lang, n_words, ids, words, counts)``: the texts of a task in shards of one language each.

    ``ids`` is a compressed array of word numbers, 0 between pieces; ``words`` and ``counts`` belong to the numbers
    from 1 on.  No text leaves its task, and a language may have any number of shards.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        part, done = TaskContext.get().partitionId(), 0

        def close(lang: str) -> pa.RecordBatch:
            nonlocal done
            ids, parts = held.pop(lang)
            del sizes[lang]
            numbers = np.concatenate(parts)
            counts = np.bincount(numbers, minlength=len(ids))
            words = [w.decode() for w in list(ids)[1:]]
            row = {"shard": part << 24 | done, "lang": lang, "n_words": int(counts[1:].sum()), "ids": _packed(numbers), "words": words, "counts": counts[1:].tolist()}
            done += 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids, parts = held.setdefault(lang, (_Ids({b"\xff": 0}), []))
                words = text.encode().lower().translate(_PIECE_END).replace(b"\xff", b" \xff ").split()
                parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                parts.append(np.zeros(1, np.int32))
                sizes[lang] = sizes.get(lang, 0) + len(words) + 1
                if sizes[lang] >= SHARD:
                    yield close(lang)
                elif sum(sizes.values()) >= 2 * SHARD:
                    yield close(max(sizes, key=sizes.get))
        for lang in list(held):
            yield close(lang)

    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, "shard bigint, lang string, n_words bigint, ids binary, words array<string>, counts array<bigint>")


def frequent_words(shards: DataFrame, least: int) -> DataFrame:
    """``(lang, word, count, g)`` of the words found ``least`` times or more in their language, numbered by ``g`` from 1."""
    each = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    counted = each.groupBy("lang", "word").agg(F.sum("c").alias("count")).filter(F.col("count") >= least)
    return number_rows(counted, ["lang", "word"], "g")


def keep_words(shards: DataFrame, words: DataFrame) -> DataFrame:
    """``(shard, ids, gs)``: shards in which only ``words`` are left, numbered anew, others end pieces; ``gs`` tells their ``g``."""
    own = shards.select("shard", "lang", F.posexplode("words").alias("local", "word"))
    mapped = own.join(words.select("lang", "word", "g"), ["lang", "word"]).select(F.col("shard").alias("of"), "local", "g")

    def renumber(shard: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if shard.empty:
            return pd.DataFrame({"shard": [], "ids": [], "gs": []})
        numbers = _unpacked(shard["ids"].iloc[0])
        known = known.sort_values("g")
        new = np.zeros(int(numbers.max(initial=0)) + 1, np.int32)
        new[known["local"].to_numpy() + 1] = np.arange(1, len(known) + 1)
        numbers = new[numbers]
        numbers = numbers[(numbers != 0) | (np.roll(numbers, 1) != 0)]
        return pd.DataFrame({"shard": [shard["shard"].iloc[0]], "ids": [_packed(numbers)], "gs": [known["g"].to_numpy(np.int64).tobytes()]})

    # A group is one shard with its own words.
    return shards.select("shard", "ids").groupBy("shard").cogroup(mapped.groupBy("of")).applyInPandas(renumber, "shard bigint, ids binary, gs binary")


def _names(length: int, start: int = 1) -> list[str]:
    return [f"g{k}" for k in range(start, start + length)]


def _mark(words, places: int):
    """The place of a phrase in the marks, for columns and arrays alike; the products stay below 2^58."""
    h = words[0] % places
    for w in words[1:]:
        h = (h * 1_000_003 + w) % places
    return h


def marks_of(phrases: DataFrame, length: int) -> np.ndarray:
    """A bit for each phrase at a hash of its words, 16 MB in all.  Others may fall on a bit; none of the phrases is missed."""
    place = _mark([F.col(c) for c in _names(length)], MARKS)
    cut = phrases.select(place.alias("h")).groupBy(F.shiftright("h", 15).alias("bucket"))
    marks = np.zeros((MARKS >> 15) + 1 << 12, np.uint8)
    for row in cut.agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("bits")).toLocalIterator():
        marks[row.bucket << 12 : row.bucket + 1 << 12] = np.frombuffer(row.bits, np.uint8)
    return marks


def count_phrases(kept: DataFrame, length: int, least: int, marks: list) -> DataFrame:
    """``(g1, ..., count)`` of all phrases of ``length`` words found ``least`` times or more.

    ``marks`` are those of the frequent phrases of 2 to ``length - 1`` words: a phrase is only as frequent as the phrases
    inside it, so each shard grows no others.  Each shard is indexed in a task and tells its counts, which are summed.
    """
    names, places = _names(length), MARKS

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, gs in zip(batch["ids"].to_pylist(), batch["gs"].to_pylist(), strict=True):
                g = np.concatenate([[0], np.frombuffer(gs, np.int64)])

                def allowed(words: np.ndarray, k: int) -> np.ndarray:
                    at = _mark([g[words[:, j]] for j in range(k)], places)
                    return marks[k - 2].value[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0

                found = ShardIndex(_unpacked(ids), length).phrases(length, allowed)
                for start in range(0, len(found.size), 1 << 18):
                    some = slice(start, start + (1 << 18))
                    columns = [pa.array(g[found.words[some, j]]) for j in range(length)]
                    yield pa.record_batch([*columns, pa.array(found.size[some], pa.int64())], [*names, "c"])

    counted = kept.select("ids", "gs").mapInArrow(grow, ", ".join(f"{c} bigint" for c in [*names, "c"]))
    return counted.groupBy(*names).agg(F.sum("c").alias("count")).filter(F.col("count") >= least)


# --- collocations


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000, cover: int = 50) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the phrases of 2 to ``max_words`` words that hold together best.

    Texts are lower-cased (A-Z) and split into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs.
    A phrase is found ``a`` times, ``least`` or more, in the texts of its language, which have ``n`` words.  Of the cuts in two
    the one with the lowest score ``floor(1000000 a a / (l r))`` counts, the first of equal ones, where ``l`` and ``r`` count the two sides.
    Left out are phrases inside a longer one that is found ``cover`` percent of their times or more.  The first ``top`` of a language are
    kept, by score, then ``a``, descending, then the bytes of the phrase.

    A null language is ``und``; a null text has no words; repeated rows count each; an empty table gives no rows; only
    ``lang`` and ``text`` of ``docs`` are read.  Counts are exact; a text is never cut, so a long one may be a shard by itself.
    """
    spark = docs.sparkSession
    shards = materialise(word_shards(docs), "shards")
    words = materialise(frequent_words(shards, least), "frequent-words")
    kept = materialise(keep_words(shards, words), "kept-words")
    counts = {1: words.select(F.col("g").alias("g1"), "count")}
    marks = []
    for length in range(2, max_words + 1):
        counts[length] = materialise(count_phrases(kept, length, least, marks), "phrases")
        if length < max_words:
            marks.append(spark.sparkContext.broadcast(marks_of(counts[length], length)))
    scored = None
    for length in range(2, max_words + 1):
        some = _scored(counts, words, length).join(_covered(counts, length, max_words), _names(length), "left")
        some = some.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < cover * F.col("a")))
        some = some.select("lang", F.array(*_names(length)).alias("gs"), "a", "l", "r", "score")
        scored = some if scored is None else scored.unionByName(some)
    by_lang = Window.partitionBy("lang")
    # Equal scores and counts at the border all stay until their words are known.
    best = scored.withColumn("_n", F.rank().over(by_lang.orderBy(F.desc("score"), F.desc("a")))).filter(F.col("_n") <= top).drop("_n")
    best = materialise(best, "best")
    spelled = best.select("gs", F.posexplode("gs").alias("k", "g")).join(words.select("g", "word"), "g")
    spelled = spelled.groupBy("gs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    ranked = best.join(spelled, "gs").withColumn("rank", F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint"))
    result = ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    result = materialise(result, "collocations")
    discard(shards, words, kept, best, *(counts[k] for k in range(2, max_words + 1)))
    for m in marks:
        m.unpersist()
    return result


def _scored(counts: dict[int, DataFrame], words: DataFrame, length: int) -> DataFrame:
    """Phrases of ``length`` words with ``(lang, a, l, r, score)`` of their lowest-scoring cut."""
    rows, names = counts[length].withColumnRenamed("count", "a"), _names(length)
    rows = join_counted(rows, words.select(F.col("g").alias("g1"), "lang", F.col("count").alias("l1")), "g1", "l1")
    cuts = []
    for k in range(1, length):
        if k > 1:
            rows = rows.join(counts[k].withColumnRenamed("count", f"l{k}"), names[:k])
        rest = counts[length - k].select(*[F.col(c).alias(names[k + j]) for j, c in enumerate(_names(length - k))], F.col("count").alias(f"r{k}"))
        rows = join_counted(rows, rest, names[-1], f"r{k}") if k == length - 1 else rows.join(rest, names[k:])
        cuts.append(F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return rows.withColumn("_cut", F.array_min(F.array(*cuts))).select(*names, "lang", "a", "_cut.l", "_cut.r", "_cut.score")


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 a a / (l r))`` in whole decimals, exact for counts of up to fourteen digits."""
    a, left, right = (c.cast("decimal(14,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def _covered(counts: dict[int, DataFrame], length: int, max_words: int) -> DataFrame:
    """For phrases of ``length`` words inside frequent longer ones, how often the most frequent of those is found."""
    inside = counts[length].select(*_names(length), F.lit(None).cast("bigint").alias("count")).limit(0)
    for longer in range(length + 1, max_words + 1):
        for start in range(1, longer - length + 2):
            inside = inside.unionByName(counts[longer].select(*[F.col(f"g{start + j}").alias(f"g{1 + j}") for j in range(length)], "count"))
    return inside.groupBy(*_names(length)).agg(F.max("count").alias("_longer"))
