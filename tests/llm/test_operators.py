"""Operators against plain restatements, on awkward rows and on the given tables."""

import base64
import collections
import datetime
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemesh.llm import byte_bpe, components, exact_dedup, mixing, pii, quality_rules, simhash, subword, token_files, toxicity, url_lists
from tracemesh.llm.common import load
from tracemesh.llm.oracle import ORACLE
from tracemesh.llm.queries import QUERIES, RANKS, WORD_TOKENIZER
from tracemesh.plans.check import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ["_key", "_digest", "salt", "recipe", "chunks", "fp", "node", "size", "_copies", "_place", "score", "_score", "ids", "words", "TEXT_", "y", "anchor"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "river", "of", "stone", "runs", "Über", "señor", "slowly", "near", "a", "hill", "at", "dawn"]) + rng.choice(["", "", ",", "."]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(n))


def awkward_rows():
    near = prose(1, 300)
    texts = [
        (1, prose(0, 80), "a"), (2, prose(0, 80), "a"), (3, prose(0, 80), None), (4, None, "a"), (5, "", "b"), (6, " \n\t ", "b"),
        (None, prose(2, 40), None), (None, prose(2, 40), "a"), (None, None, None), (7, near, "b"), (8, near.replace("river", "brook", 1), "b"),
        (9, near + " end", "c"), (10, "one", "c"), (11, "one two", "é"), (12, "one two three four", "é"), (12, "one two three four", "é"),
        (13, prose(3, 20_000), "a"), (14, "x" * 30_000, "a"), (15, "ab." * 5000, "\U0001f600"), (16, "ONE TWO", "c"), (17, "  \U0001f600   é́", ""),
        (18, "Bob's 'tis they'll\r\n\n  x\t\ty   ", "a"),
    ]
    return [(i, t, None if i == 3 else "en", s, None, *[str(i)] * len(CLASHING)) for i, t, s in texts]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same_columns(found, docs):
    assert found.columns == docs.columns and found.dtypes == docs.dtypes


# --- exact deduplication


def test_exact_duplicates(awkward):
    groups = collections.defaultdict(list)
    for i, t in texts_of(awkward):
        groups[t].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: i != keep)):
            want[(i, keep, len(ids), k == 0, sha(t))] += 1
    assert collections.Counter(map(tuple, exact_dedup.exact_duplicates(awkward).collect())) == want


def test_drop_exact_duplicates(awkward, empty):
    kept = exact_dedup.drop_exact_duplicates(awkward)
    same_columns(kept, awkward)
    texts = [t or "" for _, t in texts_of(kept)]
    assert sorted(texts) == sorted({t for _, t in texts_of(awkward)})
    assert {i for i, _ in texts_of(kept)} >= {3, 12, 6}
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_clashing_chunk_identifiers(spark):
    chunk = lambda i, s: {"id": i, "sha": bytearray(s)}
    rows = [(1, "x", [chunk(5, b"a")], 0), (2, "y", [chunk(5, b"b")], 1), (3, "x", [chunk(5, b"a")], 2)]
    recipes = spark.createDataFrame(rows, "doc_id bigint, text_sha256 string, chunks array<struct<id:bigint,sha:binary>>, row bigint")
    found = {r.doc_id: [bytes(x) for x in r.recipe] for r in exact_dedup.verified_lists(recipes).collect()}
    assert found[1] == found[3] != found[2]


def test_chunks_follow_content_in_any_script(spark):
    """An insertion in the middle of a text without blanks changes few of its many chunks."""
    rng = random.Random(12)
    scripts = [(0x4E00, 3000), (0x0E01, 46), (0x0430, 32), (0xAC00, 2000), (0x1F600, 60)]
    texts = ["".join(chr(low + rng.randrange(n)) for _ in range(40_000)) for low, n in scripts]
    texts.append("".join(f'{{"id":{rng.randrange(10**6)},"name":"{rng.choice(["alpha", "beta", "gamma"])}{rng.randrange(99)}"}},' for _ in range(1500)))
    for text in texts:
        at = rng.randrange(1000, 30_000)
        for changed in ("x" + text, text[:at] + "一y" + text[at:]):
            docs = spark.createDataFrame([(1, text), (2, changed)], "doc_id bigint, text string")
            before, after = ([bytes(c.sha) for c in r.chunks] for r in exact_dedup.recipes(docs).orderBy("doc_id").collect())
            assert len(before) > 8 and len(set(after) - set(before)) <= 3


def test_repeated_rows_meet_in_many_parts(spark):
    docs = spark.createDataFrame([(7, "same text")] * 500 + [(3, "same text")] * 5 + [(None, "same text"), (9, "other")], "doc_id int, text string").repartition(4)
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in rows if r.kept and r.doc_id != 9] == [(7, 7, 506)]
    assert len(rows) == 507 and exact_dedup.drop_exact_duplicates(docs).count() == 2


def test_chunks_follow_content(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("acekmstuw") for _ in range(rng.randrange(2, 9))) for _ in range(4000))
    rows = [(1, text), (2, text[:5000] + " some inserted words " + text[5000:])]
    before, after = (r.chunks for r in exact_dedup.recipes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert len(before) > 20
    assert len({c.id for c in before} & {c.id for c in after}) >= len(before) - 3


# --- mixing


def fill(sizes, weights, limit):
    left, free, target = float(sum(sizes.values())), set(sizes), {}
    while free:
        total = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / total > limit * sizes[k]]
        if not over:
            return target | {k: left * weights[k] / total for k in free}
        for k in over:
            target[k] = limit * sizes[k]
            free.discard(k)
            left -= target[k]
    return target


def test_targets_and_copies(spark, small):
    docs = load(spark, small, "documents")
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(WORD.findall(t)) for i, t in texts_of(docs)}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    weights = {k: (5, 2, 1)[n % 3] for n, k in enumerate(sorted(sizes))}
    target = fill(sizes, weights, 3)
    taken, number = collections.Counter(), collections.defaultdict(list)
    rows = mixing.mixture(docs).collect()
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]])
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        number[source[r.doc_id]].append(r.taken // max(r.size, 1))
    for k, n in target.items():
        rate = n / sizes[k]
        assert abs(sum(number[k]) - rate * len(number[k])) <= 1  # once per whole number passed
        assert set(number[k]) <= {int(rate), int(rate) + 1}
        assert abs(taken[k] - n) <= max(v for i, v in size.items() if source[i] == k)
    assert sorted(rows) == sorted(mixing.mixture(docs.repartition(7)).collect())


def test_mixed_documents(awkward, empty):
    plan = collections.Counter()
    for r in mixing.mix_plan(awkward).collect():
        plan[(r.doc_id, r.source_key, r["size"])] += r.copies
    mixed = mixing.mixed_documents(awkward)
    same_columns(mixed, awkward)
    found = collections.Counter((r.doc_id, "b" if r.source is None else "a" + r.source, len(WORD.findall(r.text or ""))) for r in mixed.collect())
    assert found == +plan
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_one_source_without_words(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string").withColumn("source", F.lit("s"))
    assert sorted(tuple(r) for r in mixing.mixture(docs).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mixed_documents(docs).count() == 2


# --- SimHash


def plain_simhash(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps):
    """``{id: smallest id reachable}`` from ``{id: fingerprint}``."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in fps}


def test_near_duplicates(awkward, empty):
    texts = texts_of(awkward)
    want = plain_components({i: plain_simhash(t) for i, t in texts if i is not None})
    found = simhash.near_duplicates(awkward).select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("f"), "component_id").collect()
    assert collections.Counter((r.doc_id, r.f) for r in found) == collections.Counter((i, f"{plain_simhash(t):016x}") for i, t in texts)
    assert all(r.component_id == want.get(r.doc_id) for r in found)
    kept = simhash.drop_near_duplicates(awkward)
    same_columns(kept, awkward)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_fingerprint_equals_spark_hash(spark):
    row = spark.createDataFrame([("one two three four",)], "s string").select(F.xxhash64("s")).first()[0]
    assert row & (1 << 64) - 1 == plain_simhash("One two  THREE\nfour") == simhash.simhash("one two three four")


def test_long_text_is_hashed_in_steps(monkeypatch):
    text = prose(5, 3000)
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "HASHES", 100)
    assert simhash.simhash(text) == whole == plain_simhash(text)


def test_hamming_code_covers():
    home, near = simhash.hamming_neighbours()
    code = np.unique(home)
    assert len(code) == 1 << 11
    for word in range(0, 1 << 15, 371):
        distance = np.bitwise_count((code ^ word).astype(np.uint16))
        assert distance.min() <= 1 and home[word] == code[distance.argmin()]
        assert {c for c in near[word] if c >= 0} == set(code[distance <= 2].tolist())


def test_pairs_within_distance_share_an_anchor():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        row, anchor, home = simhash.anchors(np.array([a, b], np.uint64).view(np.int64))
        homes = {x for r, x, h in zip(row, anchor, home, strict=True) if r == 0 and h}
        assert len(homes) == 3 and homes & set(anchor[row == 1])


@pytest.mark.parametrize("cell", [4, 100_000])
def test_links_of_crowded_anchors(spark, cell):
    rng = random.Random(7)
    fps = {}
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(40):
            value = centre
            for bit in rng.sample(range(64), rng.randrange(6)):
                value ^= 1 << bit
            fps.setdefault(value, len(fps))
    rows = [(int(np.uint64(f).astype(np.int64)), i) for f, i in fps.items()]
    classes = spark.createDataFrame(rows, "fp bigint, node bigint")
    labels = components.component_labels(simhash.link_fingerprints(classes, cell=cell))
    want = {i: c for i, c in plain_components({i: f for f, i in fps.items()}).items()}
    found = {r.node: r.root for r in labels.collect()}
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 70)] + [(200, k) for k in range(201, 260)] + [(300, 300), (400, 401), (401, 400)]
    found = {r.node: r.root for r in components.component_labels(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {k: 1 for k in range(1, 71)} | {k: 200 for k in range(200, 260)} | {400: 400, 401: 400}
    assert found == want


# --- quality rules


def plain_measures(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(awkward, empty):
    rows = quality_rules.quality_rules(awkward).collect()
    found = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert found == collections.Counter((i, *plain_measures(t)) for i, t in texts_of(awkward))
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    assert quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("text", ["a b a b a b a", "x x x x", "a b c d a b c", "p q r s t p q r\np q r\n\np q r", "a b", "# a | b\n# a | b"])
def test_measures_of_repeats(spark, text):
    row = quality_rules.measures(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == plain_measures(text)


def test_verdicts_on_labelled_documents(spark, small):
    judged = quality_rules.quality_rules(load(spark, small, "documents")).join(load(spark, small, "labels").withColumnRenamed("quality", "label"), "doc_id").filter("NOT base_failed")
    right = judged.agg(F.avg((F.col("kept") == (F.col("label") == 1)).cast("double"))).first()[0]
    assert right > 0.97


# --- token files


def test_token_files(spark, awkward, empty, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER))
    tokenizer.encode_special_tokens = True
    manifest = token_files.write_tokens(awkward, f"file://{tmp_path}/t", public_tokenizers.path(WORD_TOKENIZER), partitions=4)
    rows = token_files.read_tokens(manifest, rows_a_batch=2).collect()
    start, want = 0, []
    for i, t in sorted(texts_of(awkward), key=lambda r: (r[0] is not None, r[0], r[1])):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in rows], key=lambda r: r[1]) == want
    parts = manifest.collect()
    assert sum(p.n_tokens for p in parts) == start and len(parts) > 1
    for p in parts:
        assert np.memmap(p.offsets_path.removeprefix("file://"), "<u8", mode="r")[-1] == p.n_tokens
        assert len(np.memmap(p.ids_path.removeprefix("file://"), "<u2", mode="r")) == p.n_tokens
    nothing = token_files.write_tokens(empty, f"file://{tmp_path}/e", public_tokenizers.path(WORD_TOKENIZER))
    assert token_files.read_tokens(nothing).count() == 0


def test_token_files_in_another_session(spark, awkward, tmp_path):
    folder = f"{tmp_path}/plain"
    written = token_files.write_tokens(awkward, folder, public_tokenizers.path(WORD_TOKENIZER), partitions=3)
    assert all(p.ids_path.startswith("file:///") for p in written.collect())  # a path without a scheme lies where Spark puts it
    (tmp_path / "plain" / "part-000001-lost.ids").write_bytes(b"\x01")  # a lost attempt
    found = token_files.read_manifest(spark.newSession(), folder)
    assert sorted(found.collect()) == sorted(written.collect())
    assert token_files.read_tokens(found).count() == awkward.count()
    with pytest.raises(Exception, match="(?i)already exists"):
        token_files.write_tokens(awkward, folder, public_tokenizers.path(WORD_TOKENIZER))


def test_token_files_of_one_id(spark, tmp_path):
    docs = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE 7 END AS doc_id", "concat('text ', id) AS text")
    manifest = token_files.write_tokens(docs, f"{tmp_path}/hot", public_tokenizers.path(WORD_TOKENIZER), partitions=6)
    parts = manifest.collect()
    assert len(parts) == 6 and max(p.n_docs for p in parts) < 300  # neither the null id nor id 7 is a part of its own
    rows = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 300 + [7] * 600
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER))
    texts = sorted(f"text {i}" for i in range(900) if i % 3 == 0) + sorted(f"text {i}" for i in range(900) if i % 3)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_words_as_the_library_encodes_them():
    coder = token_files.WordCoder(open(public_tokenizers.path(WORD_TOKENIZER), encoding="utf-8").read())
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER))
    tokenizer.encode_special_tokens = True
    rng = random.Random(11)
    alphabet = "abcXYZéÀßñİſǅªº'.,-!?09½²́̇  ‍\U0001f600漢字ΣςАЯ<|>\x00\x1c"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    words += ["<|endoftext|>", "don't.", "We'll,", "...", ",a.", "a,.", "STRASSE.", "é.", "é.", "x" * 5000]
    for at in range(0, len(words), 10):
        text = rng.choice([" ", "\n", "\t \r"]).join(words[at : at + 10])
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(coder.encode(text), coder.dtype).tolist() == ids, text


# --- classifiers


def test_subword_features():
    assert len(subword.features("")) == len(subword.features(" \n")) == 0
    twice = subword.features("abc abc abc")
    other = subword.features("xyzw xyzw")
    assert twice[-1] == twice[-2] == other[-1]  # saying a word again is the same step for every word
    assert len(subword.features("ab")) == 3 + 1  # " ab", "ab ", " ab ", the word, and no step
    assert set(subword.features("abc")) <= set(subword.features("zz abc"))


def test_quality_classifier(spark, small, awkward, empty):
    docs, labels = load(spark, small, "documents"), load(spark, small, "labels")
    model = subword.fit_quality(docs, labels)
    again = subword.fit_quality(docs.repartition(5), labels)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    rows = subword.score_quality(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    scored = subword.score_quality(awkward, model).collect()
    assert len(scored) == awkward.count() and all(0 <= r.score <= 1 for r in scored)
    kept = subword.keep_quality(awkward, model)
    same_columns(kept, awkward)
    assert kept.count() == sum(r.predicted for r in scored)
    assert subword.score_quality(empty, model).count() == 0
    nothing = subword.fit_quality(empty, labels)
    assert nothing.score("any text") == 0.5


def test_quality_sample(spark):
    """One row an id, the smallest text; documents in the order of their hash until the bytes are used up."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (5, None), (None, 1)], "doc_id bigint, quality int")
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    hot = ids[0]
    rows = [(i, f"text {i:03d} é") for i in range(45)] + [(hot, f"z{k}") for k in range(500)] + [(None, "none"), (ids[1], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    whole = {r.doc_id: (r.text, r.y) for r in subword._sampled(docs, labels, "quality", 100, 1 << 20).collect()}
    assert whole == {i: ("" if i == ids[1] else f"text {i:03d} é", i % 2) for i in ids}
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id bigint").orderBy(F.xxhash64("doc_id")).collect()]
    few = subword._sampled(docs, labels, "quality", 10, 1 << 20).collect()
    assert sorted(r.doc_id for r in few) == sorted(order[:10])
    used, want = 0, []
    for i in order:
        if used < 50:
            want.append(i)
        used += len(whole[i][0].encode())
    bound = subword._sampled(docs, labels, "quality", 100, 50).collect()
    assert sorted(r.doc_id for r in bound) == sorted(want) and len(want) < len(ids)


def plain_segments(scores):
    """Maximal segments by their definition: all prefixes and suffixes are positive, and no larger segment is like that."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    n = len(scores)
    good = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if all(total[i] < total[k] for k in range(i + 1, j + 1)) and all(total[k] < total[j] for k in range(i, j))]
    return sorted(g for g in good if not any(h != g and h[0] <= g[0] and g[1] <= h[1] for h in good))


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(200):
        scores = np.array([rng.choice([-3, -2, -1, -1, 0, 1, 2, 4]) for _ in range(rng.randrange(0, 25))], float)
        found = toxicity.maximal_segments(scores)
        assert [(s, e) for s, e, _ in found] == plain_segments(scores)
        assert all(v == pytest.approx(scores[s:e].sum()) for s, e, v in found)


def test_toxicity(spark, small, awkward, empty):
    docs, labels = load(spark, small, "documents"), load(spark, small, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    clean = [r for r in rows if r.held_out and r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    bad = [r for r in rows if r.held_out and r.toxic == 1]
    assert sum(r.predicted for r in bad) >= 0.5 * len(bad)
    scored = toxicity.score_toxicity(awkward, model).collect()
    assert len(scored) == awkward.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == 0 for r in scored if r.doc_id in (4, 5, 6))
    assert toxicity.score_toxicity(empty, model).count() == 0
    unfitted = toxicity.fit_toxicity(docs, labels.limit(0))
    assert unfitted.judge("any text at all")[0] < 0.5


def test_a_word_said_over_and_over_is_no_passage():
    model = toxicity.ToxicModel({"awful": 6.0, "vile": 6.0, "odd": 1.5}, decay=1.0, rate=0.01)
    assert model.judge("odd " * 500)[0] < 0.5
    once, twice = model.judge("so awful as it was then"), model.judge("so awful as vile was then")
    assert once[0] < twice[0] and len(twice[1]) == 1


# --- byte-level BPE


@pytest.fixture(scope="module")
def plain_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(RANKS), "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_reduction(plain_bpe):
    ranks = open(public_tokenizers.path(RANKS), "rb").read()
    rng = random.Random(4)
    alphabet = ["a", "b", "re", "'", "'s", "'ll", " ", " ", "  ", "\n", "\t", "\r\n", "1", "23", ".", "!!", "é", "é", "漢", "\U0001f600", " ", " ", "\x1c", "\x85", "word"]
    for leaf in (1, 3, 7, 50):
        coder = byte_bpe.TreeBpe(ranks, public_tokenizers.PATTERN, leaf)
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120)))
            ids = coder.encode(text)
            assert ids == plain_bpe.encode_ordinary(text), repr(text)
            assert coder.decode(ids) == text.encode()


def test_encode_and_decode(spark, awkward, empty, plain_bpe):
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    decoded = byte_bpe.decode(byte_bpe.encode(awkward, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    found = collections.Counter(map(tuple, byte_bpe.digests(decoded).collect()))
    want = collections.Counter()
    for i, t in texts_of(awkward):
        ids = plain_bpe.encode_ordinary(t)
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(t))] += 1
    assert found == want
    assert byte_bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


# --- personal data


def plain_luhn(number):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def only_digits(value):
    return re.sub("[^0-9]", "", value)


PLAIN_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only_digits(m)) <= 19 and plain_luhn(only_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only_digits(m)) <= 15),
]


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, check in PLAIN_KINDS for m in re.finditer(p, text) if check(m[0])]


def test_base_spans(spark, awkward):
    rng = random.Random(6)
    parts = ["a@b.c", "x.y%z@d-e.f.g", "@", "_", ".", "..", "-", "1.2.3.4", "256.1.1.1", "001.002.003.0255", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (555) 555-0100", "+1", "+49 30.1234567", "++12345678", " ", " ", "\n", "é", "\U0001f600", "word", "7", "12", "a@b", "c.d@e.f_g@h.i", "5555555555554444"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    texts += ["1 " * 2000 + "a@b.c", "a@b.cc " * 1500, "9" * 20_000, "a" * 50_000 + "@", "a." * 20_000 + "x@y.z", "+1" + " " * 9000 + "2345678", "1." * 9000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    for r in pii.pii_digest(pii.personal_data(docs)).collect():
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(spans)), (texts[r.doc_id][:200], spans[:5], r.spans[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k, *_ in PLAIN_KINDS]
        assert r.spans.startswith(",".join(spans))
    assert pii.personal_data(awkward).count() == awkward.count()


def test_added_spans(spark):
    texts = {
        1: "pay to GB82 WEST 1234 5698 7654 32 now", 2: "pay to GB83 WEST 1234 5698 7654 32 now", 3: "my SSN is 123-45-6789.", 4: "part 123-45-6789.",
        5: "Amex card 378282246310005", 6: "number 378282246310005", 7: "SSN 000-45-6789",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added] for r in pii.personal_data(docs).collect()}
    assert found == {1: [("iban", "GB82 WEST 1234 5698 7654 32")], 2: [], 3: [("ssn", "123-45-6789")], 4: [], 5: [("shortcard", "378282246310005")], 6: [], 7: []}


# --- URL lists


def test_url_lists_as_of(spark):
    day = lambda n: datetime.date(2024, 1, n)
    entries = [
        ("host:bad.example.com", "a", day(5), True), ("host:bad.example.com", "a", day(10), False), ("host:bad.example.com", "a", day(15), True),
        ("host:example.org", "a", day(3), True), ("url:http://x.net/p", "b", day(8), True), ("host:x.net", "a", day(9), True),
        ("host:same.day", "a", day(4), True), ("host:same.day", "a", day(4), False), (None, "a", day(1), True), ("host:un.dated", "a", None, True),
    ]
    urls = ["http://bad.example.com/1", "https://u:p@WWW.Bad.Example.com:80/x", "http://sub.example.org", "http://x.net/p", "http://x.net/q", "http://same.day/", "http://un.dated/", "no url", "http://example.com/", None]
    captures = [(k * 100 + d, u, day(d) if d else None) for k, u in enumerate(urls) for d in (0, 1, 4, 5, 9, 10, 12, 15, 20)]
    captures += captures[:5]

    def plain(url, at):
        if url is None or at is None:
            return (0, None, None)
        host = re.match(r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url)
        labels = host[1].lower().split(".") if host else []
        keys = {f"url:{url}"} | {"host:" + ".".join(labels[i:]) for i in range(max(len(labels) - 1, 1)) if labels}
        hits = []
        for key, name in {(e[0], e[1]) for e in entries if e[0] in keys}:
            last = max((e[2] for e in entries if e[:2] == (key, name) and e[2] and e[2] <= at), default=None)
            if last and any(e[3] for e in entries if e[:3] == (key, name, last)):
                hits.append((key, last))
        return (len(hits), min((k for k, _ in hits), default=None), min((s for _, s in hits), default=None))

    found = url_lists.judge_captures(
        spark.createDataFrame(captures, "capture_id bigint, url string, fetch_day date"), spark.createDataFrame(entries, "key string, list string, day date, listed boolean")
    )
    want = collections.Counter((i, u, d, *plain(u, d)) for i, u, d in captures)
    assert collections.Counter(map(tuple, found.collect())) == want
    assert sum(n for (*_, hits, _, _), n in want.items() if hits) > 10
    no_entries = url_lists.judge_captures(spark.createDataFrame(captures, "capture_id bigint, url string, fetch_day date"), spark.createDataFrame([], "key string, list string, day date, listed boolean"))
    assert no_entries.filter("n_lists > 0").count() == 0


# --- registered queries


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    good, note = compare(spark, connect(sf_dir), sf_dir, name, QUERIES[name], ORACLE[name])
    assert good, note


def test_base_measures_match_sql(spark, sf_dir):
    sql = r"""SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM documents"""
    con = connect(sf_dir)
    want = sorted(con.execute(sql).fetchall())
    assert isinstance(con, duckdb.DuckDBPyConnection)
    assert sorted(tuple(r) for r in QUERIES["op5_quality_rules"](spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols").collect()) == want
