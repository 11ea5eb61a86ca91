"""Near copies by five-word shingles, against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import awkward, empty, prose, same_columns, texts_of  # noqa: F401

from tracemesh.llm import exact_dedup, shingles, simhash
from tracemesh.llm.common import load


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """``{id: smallest id reachable}`` over all pairs with Jaccard similarity 0.8, from ``[(id, text)]``."""
    sets = [(i, plain_set(t)) for i, t in texts if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, s in sets:
        for b, t in sets:
            if a < b and 10 * len(s & t) >= 8 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


def edited(text, rng, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"other{rng.randrange(10**6)}"
    return " ".join(words)


def copies(n, seed=5):
    """Two texts of 300 words, and copies of them in which 1 to 8 words are replaced."""
    rng = random.Random(seed)
    bases = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(300)) for _ in range(2)]
    return list(enumerate(bases)) + [(k, edited(bases[k % 2], rng, 1 + k % 8)) for k in range(2, n)]


def test_pipeline_drops_copies_whose_fingerprints_are_far_apart(spark):
    rng = random.Random(8)
    rows = []
    for k in range(0, 40, 2):
        base = " ".join(f"w{rng.randrange(10**5)}" for _ in range(120))
        rows += [(k, base), (k + 1, edited(base, rng, 2))]
    assert all(10 * len(plain_set(a) & plain_set(b)) >= 8 * len(plain_set(a) | plain_set(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_pipeline_near_stage_on_tables(spark):
    docs = exact_dedup.drop_exact_duplicates(load(spark, "/root/testdata/sf0.01", "documents"))
    want = {i for i, c in plain_groups(texts_of(docs)).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == want
    assert len(want) < docs.count()


def test_drop_similar(awkward, empty):  # noqa: F811
    kept = shingles.drop_similar(awkward)
    same_columns(kept, awkward)
    want = {i for i, c in plain_groups(texts_of(awkward)).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want | {None}
    assert kept.filter("doc_id IS NULL").count() == 3
    assert shingles.drop_similar(empty).count() == 0


@pytest.mark.parametrize("cell", [7, 512])
@pytest.mark.parametrize("size", [3000, 1 << 20])
def test_groups_larger_than_a_cell(spark, cell, size):
    rows = copies(60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = docs.select("doc_id", F.lit(0).cast("bigint").alias("root"))
    links = [tuple(r) for r in shingles.link_similar(docs, groups, cell=cell, shingles=size).collect()]
    want = plain_groups(rows)
    assert all(want[a] == want[b] for a, b in links)
    root = dict(want)
    for a in root:
        root[a] = a
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert root == want and len(set(want.values())) < len(rows)


@pytest.mark.parametrize("cell", [4, 40])
def test_large_groups_are_compared_by_bucket(spark, cell):
    """Templates that chain into one group of buckets, near copies of each, and copies that differ in case and blanks only."""
    rng = random.Random(9)
    text, rows = " ".join(f"w{rng.randrange(10**5)}" for _ in range(120)), []
    for k in range(240):
        if k % 12 == 0:  # the next template keeps most of the last one, but is no near copy of it
            text = edited(text, rng, 4)
        rows.append((1000 - k, edited(text, rng, k % 3)))
        if k % 4 == 0:
            rows.append((2000 + k, rows[-1][1].upper().replace(" ", "  ")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.node: r.root for r in shingles.similar_documents(docs, cell=cell, most_parts=1).collect()}
    want = plain_groups(rows)
    assert {i: got.get(i, i) for i in want} == want
    assert 2 < len(set(want.values())) < 200
    groups, equal = shingles.candidate_groups(docs)
    assert groups.select("root").distinct().count() < 60  # so that groups are larger than what is similar
    assert groups.count() <= 240 and equal.count() >= 60  # of equal sets one is compared


def test_equal_sets_are_not_compared(spark):
    """300 copies of one text that differ in case go to no bucket; null ids are left out and repeated rows are one document."""
    rows = [(k, "Some Words of one Text".upper() if k % 2 else "some words OF one text") for k in range(300)] + [(None, "some words of one text"), (7, "SOME WORDS OF ONE TEXT")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups, equal = shingles.candidate_groups(docs)
    assert groups.isEmpty() and equal.count() == 299
    assert sorted(tuple(r) for r in shingles.similar_documents(docs).collect()) == [(k, 0) for k in range(300)]


def test_links_of_one_cell():
    rng = random.Random(4)
    for _ in range(60):
        universe = [rng.getrandbits(64) for _ in range(14)]
        sets = [np.array(sorted(rng.sample(universe, rng.randrange(0, 14))), np.uint64) for _ in range(25)]
        links = shingles.similar_links(sets, np.arange(25))
        near = lambda a, b: 10 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 8 * len(set(sets[a].tolist()) | set(sets[b].tolist()))
        assert all(near(a, b) for a, b in links)
        name = list(range(25))
        for a, b in links:
            name = [name[a] if x == name[b] else x for x in name]
        assert all(name[a] == name[b] for a in range(25) for b in range(25) if near(a, b))


def test_fingerprints_propose_groups(spark, monkeypatch):
    """Copies within 4 bits meet through their SimHash fingerprints, whatever the buckets say; the sets decide."""
    rng = random.Random(3)
    rows = []
    for k in range(0, 30, 2):
        words = [f"w{rng.randrange(10**5)}" for _ in range(1500)]
        rows += [(k, " ".join(words)), (k + 1, " ".join([*words[:-1], "other"]))]
    prints = {i: shingles.fingerprint(shingles.shingle_set(t)) for i, t in rows}
    assert all((prints[k] ^ prints[k + 1]).bit_count() <= 4 for k in range(0, 30, 2))
    assert shingles.fingerprint(shingles.shingle_set("")) == 0
    text = " ".join(f"w{k}" for k in range(200))
    assert shingles.fingerprint(shingles.shingle_set(text)) == simhash.simhash(text, 5)  # no shingle twice
    none = iter(range(10**6))
    monkeypatch.setattr(shingles, "buckets", lambda s: np.array([next(none) + int(s[0] >> np.uint64(24))], np.int64))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups, _ = shingles.candidate_groups(docs)
    assert {r.doc_id for r in groups.collect()} == set(prints)
    assert sorted(r.doc_id for r in shingles.drop_similar(docs).collect()) == list(range(0, 30, 2))
