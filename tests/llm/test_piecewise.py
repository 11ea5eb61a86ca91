"""Piecewise fingerprints against a plain restatement."""

import functools
import hashlib
import random

import pytest
import xxhash
from test_operators import SCHEMA, awkward_rows, prose

from tracemesh.llm import piecewise
from tracemesh.llm.common import load
from tracemesh.llm.queries import op12_piecewise


def plain_fingerprint(text):
    """One byte at a time: a rolling hash, chunks that end where it is a multiple of the block size."""
    data, mask = text.encode(), (1 << 32) - 1
    hashes = []
    for i in range(len(data)):
        h = 0
        for k in range(i - 6, i + 1):
            h = (h * 0x2C9277B5 + (data[k] + 1 if k >= 0 else 0)) & mask
        h ^= h >> 16
        h = h * 0x7FEB352D & mask
        hashes.append(h ^ h >> 15)
    size = 1
    while sum(h % size == 0 for h in hashes) > 64:
        size *= 2
    signed = []
    for block in (size, 2 * size, 4 * size):
        chunks, start = [], 0
        for i, h in enumerate(hashes):
            if h % block == 0:
                chunks.append(data[start : i + 1])
                start = i + 1
        chunks += [data[start:]] if start < len(data) else []
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        signed.append("".join(letters[x % 64] + letters[x // 64 % 64] for x in map(xxhash.xxh64_intdigest, chunks)))
    return ":".join([str(size), *signed])


def plain_likeness(left, right):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(before[j - 1] if x == y else 1 + min(before[j], row[-1]))
        return row[-1]

    if left == right:
        return 1.0
    best = 0.0
    (s, *a), (t, *b) = left.split(":"), right.split(":")
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if int(s) << i == int(t) << j:
                x2, y2 = [x[k : k + 2] for k in range(0, len(x), 2)], [y[k : k + 2] for k in range(0, len(y), 2)]
                best = max(best, 1 - distance(x2, y2) / (len(x2) + len(y2)) if x2 or y2 else 1.0)
    return best


def plain_rows(given):
    """``given`` is (doc_id, text); rows of one id come in any order that the result may have, so they are sorted by hash."""
    made = functools.cache(plain_fingerprint)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t, seed=42)) - (h >> 63 << 64)
    rows = sorted(((i, t or "") for i, t in given), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]), r[1]))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), made(text), made(new), plain_likeness(made(text), made(new)), plain_likeness(made(text), made(after))))
    return sorted(out, key=repr)


def rounded(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_awkward(spark, partitions):
    given = [r for r in awkward_rows() if r[0] != 13] + [(50, "x" * 4000, *[None] * (len(SCHEMA.split(",")) - 2))] * 9
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = piecewise.compare_with_next(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert rounded(found) == rounded(plain_rows([r[:2] for r in given]))


def test_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    found = op12_piecewise(spark, sf_dir).collect()
    assert rounded(found) == rounded(plain_rows([(r.doc_id, r.text) for r in docs.collect()]))
    near, following = sorted(r.near_edited for r in found), sorted(r.near_next for r in found)
    assert near[len(near) // 20] > 0.3 and following[-len(following) // 20] < 0.2


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id int, text string")
    (row,) = piecewise.compare_with_next(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0
    assert piecewise.compare_with_next(spark.createDataFrame([], SCHEMA)).collect() == []
    assert piecewise.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_edits_keep_what_is_far(spark):
    rng = random.Random(3)
    text = prose(5, 3000)
    for _ in range(20):
        at = rng.randrange(len(text))
        assert piecewise.likeness(piecewise.fingerprint(text), piecewise.fingerprint(text[:at] + "#!" + text[at:])) > 0.9


def test_stretches_and_repeats(monkeypatch):
    texts = [prose(9, 2000), "ab" * 3000, "x" * 3000, "", "\U0001f600é" * 700, "abc"]
    whole = [piecewise.fingerprint(t) for t in texts]
    monkeypatch.setattr(piecewise, "STRETCH", 97)
    assert [piecewise.fingerprint(t) for t in texts] == whole == [plain_fingerprint(t) for t in texts]
    assert all(len(f.split(":")[1]) <= 130 for f in whole)


def test_columns(spark):
    docs = spark.createDataFrame([(1, prose(1, 200)), (2, None)], "doc_id int, text string")
    made = piecewise.fingerprints(docs)
    both = made.crossJoin(made.selectExpr("doc_id as other", "fingerprint as theirs"))
    for r in both.withColumn("alike", piecewise.likeness_column("fingerprint", "theirs")).collect():
        assert r.alike == pytest.approx(plain_likeness(r.fingerprint, r.theirs))
