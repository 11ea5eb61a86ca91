"""Quality rules that vote or abstain, weighed by expectation-maximisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemesh.llm.common import SPACE, id_and_text, let
from tracemesh.session import materialise

GOOD, ABSTAIN, BAD = 1, 0, -1
ROUNDS = 15
#: The share of good documents that a rule for bad ones may vote on by mistake.
STRAY = 0.02


def repeated_window_words(words: Column) -> Column:
    """How many words lie in a three-word window that the text has twice or more, the first one included.

    Windows are compared by a 64-bit hash.  Texts without a repeated window, found by counting
    distinct hashes, are done; in the others the windows are sorted and compared with their neighbours.
    """

    def covered(hashes: Column) -> Column:
        indexed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(all_: Column) -> Column:
            same = lambda x, j: ((j > 0) & (F.get(all_, j - 1)["h"] == x["h"])) | (F.get(all_, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(all_, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

        def words_in(starts: Column) -> Column:
            reach = F.transform(starts, lambda p, k: F.least(F.coalesce(F.get(starts, k + 1) - p, F.lit(3)), F.lit(3)))
            return F.aggregate(reach, F.lit(0).cast("bigint"), lambda total, n: total + n)

        return let(let(indexed, twice), words_in)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(counted)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and what the rules look at, one row per input row; null texts have no words."""
    text = F.col("text")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("bigint")
    texts = id_and_text(docs).withColumns({"words": words, "lines": lines})
    return texts.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        left(SPACE).alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(r"[.!?]['\"»”)]*\s*$"))).cast("bigint").alias("n_sentence_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        left(r"\P{Lu}+").alias("n_upper"),
        left(r"\P{L}+").alias("n_letters"),
    )


def rules() -> dict[str, tuple[int, Column]]:
    """Each rule's vote and the condition on which it is cast; where that does not hold, or is null, the rule abstains."""
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    some, many = F.col("n_words") > 0, F.col("n_words") >= 20
    length, symbols = part("word_chars", "n_words"), part("n_symbols", "n_words")
    upper, letters = part("n_upper", "n_letters"), part("n_letters", "word_chars")
    repeats, duplicate = part("n_repeat_words", "n_words"), part("n_dup_lines", "n_lines")
    # With more words, more of them occur again in any prose; the root keeps the rule from punishing length.
    variety = F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    even = length.between(3, 12) & (symbols < 0.02) & (upper < 0.1) & (letters > 0.8) & (repeats < 0.35)
    uneven = ~length.between(2, 15) | (symbols > 0.05) | (upper > 0.2) | (letters < 0.7) | (repeats > 0.45)
    return {
        "odd word length": (BAD, some & ((length < 2) | (length > 15))),
        "symbols": (BAD, some & (symbols > 0.1)),
        "capitals": (BAD, many & (upper > 0.3)),
        "few letters": (BAD, some & (letters < 0.6)),
        "repeated windows": (BAD, many & (repeats > 0.45)),
        "repeated lines": (BAD, (F.col("n_lines") >= 4) & (duplicate > 0.3)),
        "few different words": (BAD, (F.col("n_words") >= 50) & (variety < 1.5)),
        "uneven prose": (BAD, many & uneven),
        "even prose": (GOOD, many & even),
        "sentences": (GOOD, many & (part("n_sentence_lines", "n_lines") >= 0.5)),
        "varied words": (GOOD, (F.col("n_words") >= 50) & (variety > 5)),
    }


def posterior(votes: Column, rates: list[tuple[float, float]], prior: float) -> Column:
    """The probability that a document with these votes is good; an abstention counts for neither side."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, (in_good, in_bad) in enumerate(rates):
        odds = odds + F.when(votes[j] != ABSTAIN, math.log(in_good / in_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, sides: list[int], rounds: int = ROUNDS) -> tuple[list[tuple[float, float]], float]:
    """Expectation-maximisation over the distinct vote patterns ``(votes, n)``.

    Estimates how often each rule votes on good and on bad documents, and the share of good ones, starting from
    "one bad vote makes a document bad".  A rule for bad documents is taken to vote on at most ``STRAY`` of the good
    ones, and every rule to be no worse than chance.  There are at most 2 ** rules patterns,
    whatever the size of the corpus; each round is one aggregate over them.
    """
    good = F.when(F.array_contains("votes", BAD), 0.05).otherwise(0.95)
    rates, prior = [], 0.5
    for _ in range(rounds):
        weighed = patterns.withColumn("g", good)
        sums = []
        for weight in (F.col("g"), 1 - F.col("g")):
            sums.append(F.sum(F.col("n") * weight))
            sums += [F.sum(F.when(F.col("votes")[j] != ABSTAIN, F.col("n") * weight).otherwise(0.0)) for j in range(len(sides))]
        row = [x or 0.0 for x in weighed.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()]
        n_good, *of_good = row[: len(sides) + 1]
        n_bad, *of_bad = row[len(sides) + 1 :]
        prior = min(max((n_good + 1) / (n_good + n_bad + 2), 0.01), 0.99)
        rates = []
        for side, g, b in zip(sides, of_good, of_bad, strict=True):
            in_good, in_bad = (g + 0.1) / (n_good + 1), (b + 0.1) / (n_bad + 1)
            if side == BAD:
                in_good = min(in_good, STRAY)
                in_bad = max(in_bad, in_good)
            else:
                in_bad = min(in_bad, in_good)
            rates.append((in_good, in_bad))
        good = posterior(F.col("votes"), rates, prior)
    return rates, prior


def judge(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Measures, votes, posterior and verdict, one row per input row.

    ``base_failed`` marks fewer than 50 words or more than half of the words in repeated windows; such
    documents are not kept.  Any other document is kept if its posterior is at least one half.
    Null texts count as empty and fail; null ids and repeated rows are rows like any other;
    an empty table gives an empty result.
    """
    cast = rules().values()
    votes = F.array(*[F.when(condition, side).otherwise(ABSTAIN).cast("int") for side, condition in cast])
    measured = materialise(measures(docs).withColumn("votes", votes), "measures")
    patterns = materialise(measured.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    rates, prior = fit(patterns, [side for side, _ in cast], rounds)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measured.withColumn("base_failed", failed).withColumn("quality", posterior(F.col("votes"), rates, prior))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def quality_rules(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The measures and verdict of :func:`judge` in a flat row."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judge(docs, rounds).select(*columns)
