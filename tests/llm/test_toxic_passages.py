"""Passages of a text that says the same words again."""

import collections
import math
import random

import numpy as np
import pytest

from tracemesh.llm import toxicity

WORDS = [f"bad{k}" for k in range(10)]


def model():
    return toxicity.ToxicModel({w: 4.0 for w in WORDS}, decay=1.0, rate=0.01)


def test_every_repeat_of_a_passage_is_found():
    text = " ".join((WORDS + ["plain"] * 60) * 6)
    score, found = model().judge(text)
    assert score > 0.5
    assert [(s, e) for s, e, _ in found] == [(70 * k, 70 * k + 10) for k in range(6)]
    assert len({round(x, 6) for *_, x in found}) == 1


def test_words_said_singly_before_take_nothing_from_a_passage():
    single = [t for w in WORDS for t in [w, *["plain"] * 20]]
    for text in (single * 5 + WORDS, WORDS + ["plain"] * 20 + single * 5):
        first = 0 if text[1] == WORDS[1] else len(text) - 10
        found = {(s, e): x for s, e, x in model().passages(" ".join(text))[1]}
        assert found[(first, first + 10)] == pytest.approx(30.0)


def test_words_repeated_inside_a_passage_count_less():
    _, found, _ = model().passages("bad0 bad0 bad0 bad0")
    assert [(s, e) for s, e, _ in found] == [(0, 4)]
    assert found[0][2] == pytest.approx(4 * (1 + 1 / 2 + 1 / 3 + 1 / 4) - 4)


def test_a_word_over_and_over_hides_no_passage_beside_it():
    spam = toxicity.ToxicModel({**{w: 4.0 for w in WORDS}, "odd": 1.5}, decay=1.0, rate=0.01)
    assert spam.judge("odd " * 500)[0] < 0.5
    for text in ("odd " * 500 + " ".join(WORDS), " ".join(WORDS) + " odd" * 500):
        assert spam.judge(text)[0] > 0.5 and len(spam.judge(text)[1]) == 1


def plain_odds(rows):
    """``{name: log-odds}`` of all entries, document by document."""
    counts = collections.defaultdict(lambda: [0, 0])
    for text, y in rows:
        for token in {t for t in toxicity.tokens_of(text) if t}:
            counts[token][1 - y] += 1
    toxic, clean = (sum(c[k] for c in counts.values()) for k in (0, 1))
    base = toxic / (toxic + clean)
    logit = lambda p: math.log(p / (1 - p))
    found, share = {}, {}
    for n in (4, 5, 6, None):
        level = collections.defaultdict(lambda: [0, 0])
        for token, c in counts.items():
            if n is None or len(token) >= n:
                own = level[token if n is None else token[:n] + "*"]
                own[0], own[1] = own[0] + c[0], own[1] + c[1]
        own_share = {}
        for name, (bad, good) in level.items():
            if bad + good < 3:
                continue
            up = {4: None, 5: 4, 6: 5, None: 6}[n]
            prior = share.get(name[:up] + "*", base) if up else base
            own_share[name] = (bad + 4.0 * prior) / (bad + good + 4.0)
            if abs(logit(own_share[name]) - logit(prior)) >= 0.25:
                found[name] = logit(own_share[name]) - logit(base)
        share = own_share
    return found


def test_all_entries_by_plain_counting(spark):
    rng = random.Random(7)
    words = [rng.choice(["abcd", "abce", "xyz", "gift", "über"]) + rng.choice(["", "ef", "efg", "efgh", "z", "zz1"]) for _ in range(60)]
    rows = [(" ".join(rng.choice(words[20 * (k % 2) : 40 + 20 * (k % 2)]) + rng.choice(["", ".", "!"]) for _ in range(rng.randrange(40))), k % 2) for k in range(300)]
    table = toxicity.log_odds(toxicity.token_counts(spark.createDataFrame(rows, "text string, y int")))
    expected = plain_odds(rows)
    assert len(table) == len(expected) > 10
    for name, odds in expected.items():
        assert table.get(name) == pytest.approx(odds)
    assert table.get("never") is None and toxicity.OddsTable(np.zeros(0, np.int64), np.zeros(0)).get("x") is None


def test_every_passage_counts_in_the_verdict():
    """The joint law over all passages; ninety weak ones tell more than fifty of them."""
    weak = toxicity.ToxicModel({w: 4.0 for w in WORDS}, decay=1.0, rate=0.001)
    text = " ".join((["bad0", "bad1"] + ["plain"] * 10) * 90)
    n, found, _ = weak.passages(text)
    assert len(found) == 90
    total, best = 0.0, -50.0
    for r in range(1, 91):
        total += found[0][2] - math.log(0.001 * n)
        best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    assert weak.evidence(n, [s for *_, s in found]) == pytest.approx(best)
    assert best > weak.evidence(n, [s for *_, s in found[:50]]) + 1
    score, significant = weak.judge(text)
    assert score == pytest.approx(1 / (1 + math.exp(-min(best + math.log(toxicity.SIGNIFICANT), 50)))) and len(significant) == 90


def test_more_labels_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEARNED", 100)
    docs = spark.createDataFrame([(k, "awful vile words" if k % 2 else "calm kind words") for k in range(1000)], "doc_id bigint, text string")
    model = toxicity.fit_toxicity(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert model.odds.get("vile") > 0 > model.odds.get("calm")
