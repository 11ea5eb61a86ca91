"""Collocations against plain counting, the index against all phrases of a text."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, awkward_rows

from tracemesh.llm import collocations as co
from tracemesh.llm.common import load

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_collocations(given, max_words=3, least=10, top=2000, cover=50):
    found = collections.defaultdict(collections.Counter)
    for text, lang in given:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                found["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    rows = []
    for lang, f in found.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in candidates.items():
            inside = any(100 * c >= cover * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, c in candidates.items() if len(h) > len(g))
            if not inside:
                score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                kept.append((score, a, " ".join(g), left, right))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, i, phrase, a, left, right, n, score) for i, (score, a, phrase, left, right) in enumerate(kept[:top], 1)]
    return sorted(rows)


def babble(seed, n, kinds=8):
    rng = random.Random(seed)
    return "".join(rng.choice(["New", "york", "The", "of", "é", "a", "ИЯ", " x", "b"][:kinds]) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", " \r\n"]) for _ in range(n))


def frame(spark, given):
    width = len(SCHEMA.split(",")) - 3
    return spark.createDataFrame([(k, t, lang, *[None] * width) for k, (t, lang) in enumerate(given)], SCHEMA)


@pytest.mark.parametrize("settings", [{}, {"max_words": 4, "least": 3}, {"max_words": 2, "least": 1, "top": 7}, {"top": 5, "least": 4, "cover": 90}])
@pytest.mark.parametrize("shard", [40, co.SHARD])
def test_small(spark, monkeypatch, settings, shard):
    monkeypatch.setattr(co, "SHARD", shard)
    given = [(babble(k, 150), ["en", "de", None, "und"][k % 4]) for k in range(12)] + [(r[1], r[2]) for r in awkward_rows() if r[0] not in (13, 15)] + [("New York city. " * 60, "en")]
    docs = frame(spark, given).repartition(3)
    assert sorted(map(tuple, co.collocations(docs, **settings).collect())) == plain_collocations(given, **settings)


def test_full_marks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "MARKS", 3)
    given = [(babble(k, 400, 9), "en") for k in range(4)]
    assert sorted(map(tuple, co.collocations(frame(spark, given), max_words=4, least=2).collect())) == plain_collocations(given, 4, 2)


def test_tables(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    given = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert sorted(map(tuple, co.collocations(docs).collect())) == plain_collocations(given)


def test_empty(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert co.collocations(frame(spark, [(None, None), ("", "en"), (" . ", "en")])).collect() == []


def test_index():
    rng = np.random.default_rng(1)
    for words in (rng.integers(0, 6, 400), np.zeros(5, int), np.ones(50, int), np.array([], int), np.array([3])):
        index, depth = co.ShardIndex(words, 4), 4
        text = [0, *words.tolist(), 0]
        for turns in ((True, True, True), (False, False, False), (True, False, True), (False, True, True)):
            found = index.single_words()
            for right in turns:
                found = index.extend(found, right)
                k = found.words.shape[1]
                want = collections.Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if 0 not in text[i : i + k])
                assert dict(zip(map(tuple, found.words.tolist()), found.size.tolist(), strict=True)) == want
        assert found.words.shape[1] == depth


def test_packed_keys_and_ranks_sort_alike():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 5, 300) for _ in range(4)]
    wide = [np.array([7, 3, 1 << 40, 9, 2])[c] for c in columns]
    ranked = [np.argsort(np.argsort([7, 3, 1 << 40, 9, 2]))[c] for c in columns]
    assert (co._sorted_by(wide) == np.lexsort(ranked[::-1])).all()


def test_scores_beyond_64_bits(spark):
    (row,) = spark.createDataFrame([(10**13, 10**13 + 1, 10**13 + 7)], "a bigint, l bigint, r bigint").select(co._score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert row[0] == 10**6 * 10**26 // ((10**13 + 1) * (10**13 + 7))
