"""Alignment of two tokenizers against the libraries and a plain restatement."""

import collections
import hashlib
import json

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import SCHEMA, awkward_rows
from tokenizers import Tokenizer

from tracemesh.llm import align
from tracemesh.llm.common import load
from tracemesh.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, op13_alignment
from tracemesh.llm.token_files import byte_letters

ODD = ["a▁b", "<|endoftext|> <s></s> <unk> <0x41>", "ﬁ   x", "\u0000", "\t\n x \r\n", "日本語のテキスト", "🙂👩‍👩‍👧 é é", "   lead", "trail   "]


def files():
    return public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.PATTERN, public_tokenizers.path(PIECE_MODEL)


@pytest.fixture(scope="module")
def tokenizers(spark):
    return align.read_tokenizers(spark, *files())


@pytest.fixture(scope="module")
def plain():
    """Ids and token bytes of a text by both libraries, or nothing where the bytes differ."""
    first = Tokenizer.from_file(files()[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=files()[2])
    letters = {c: b for b, c in byte_letters().items()}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    def coded(text):
        if not text:
            return [], []
        a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in second.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return coded


def spans(tokens):
    at, found = 0, []
    for i, data in tokens:
        found.append((i, at, at + len(data)))
        at += len(data)
    return found


def plain_alignment(coded, texts):
    parts, counts = [], collections.Counter()
    for text in texts:
        a, b = map(spans, coded(text))
        n_a, n_b = len(a), len(b)
        ending = collections.defaultdict(list)
        for y in b:
            ending[y[2]].append(y[0])
        links = [(x[0], y, x[2]) for x in a for y in ending[x[2]]]
        ends = [0, *sorted({e for _, _, e in links})]
        written = []
        for low, high in zip(ends, ends[1:], strict=False):
            sides = []
            for side in (a, b):
                own = []
                while side and side[0][2] <= high:
                    own.append(str(side.pop(0)[0]))
                sides.append(",".join(own))
            assert low < high
            written.append("|".join(sides))
        groups = ";".join(written)
        parts.append((n_a, n_b, len(ends) - 1, groups, links))
        counts.update((x, y) for x, y, _ in links)
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(counts[x, y] == most[y] for x, y, _ in links), sum(counts[x, y] for x, y, _ in links), hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
        for n_a, n_b, n_groups, groups, links in parts
    ]


def digest(found):
    whole = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return align.link_scores(found.select("doc_id", "n_a", "n_b", "n_groups", whole, "links"))


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [align.BROADCAST_PAIRS, 0])
def test_awkward(spark, tokenizers, plain, most, monkeypatch):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", most)
    monkeypatch.setattr(align, "PORTION", 500)
    width = len(SCHEMA.split(","))
    given = [r for r in awkward_rows() if r[0] not in (13, 14, 15)] + [(100 + k, t, *[None] * (width - 2)) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    texts = [r.text for r in docs.collect()]
    expected = plain_alignment(plain, texts)
    want = sorted([(r.doc_id, *w) for r, w in zip(docs.collect(), expected, strict=True)], key=repr)
    assert rows_of(digest(align.align(docs, tokenizers))) == want
    assert any(t and not w[0] for t, w in zip(texts, expected, strict=True))


def test_documents(spark, sf_dir, plain):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = sorted([(r.doc_id, *w) for r, w in zip(docs, plain_alignment(plain, [r.text for r in docs]), strict=True)], key=repr)
    assert rows_of(op13_alignment(spark, sf_dir)) == want


def test_first_side_is_the_library(sf_dir):
    coder = align.ByteCoder(open(files()[0], encoding="utf-8").read(), files()[1])
    library = Tokenizer.from_file(files()[0])
    library.encode_special_tokens = True
    import pandas as pd

    for text in [*pd.read_parquet(f"{sf_dir}/documents.parquet").text, *ODD, "x" * 5000, "a1b2" * 500]:
        assert coder.encode(text) == library.encode(" " + text, add_special_tokens=False).ids


def test_overlaps(spark, tokenizers, plain):
    texts = ["tokenizers align unevenly", "日本語 naïve", "", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = set()
    for k, t in enumerate(texts):
        a, b = map(spans, plain(t))
        want |= {(k, i, j, max(x[1], y[1]), min(x[2], y[2])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]}
    found = [tuple(r) for r in align.token_overlaps(docs, tokenizers).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_empty_table_and_long_text(spark, tokenizers):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(digest(align.align(empty, tokenizers))) == []
    long = spark.createDataFrame([(1, "word and more " * 200_000)], "doc_id int, text string")
    row = align.align(long, tokenizers).select("n_a", "n_b", "n_groups").first()
    assert row.n_a >= 600_000 and row.n_groups > 0


def test_refuses_other_files(spark):
    with pytest.raises(ValueError):
        align.ByteCoder(json.dumps({**json.load(open(files()[0], encoding="utf-8")), "normalizer": {"type": "Lowercase"}}), files()[1])
