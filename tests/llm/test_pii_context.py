"""Context words and written forms of the added kinds."""

import random
import re
import time

from pyspark.sql import functions as F

from tracemesh.llm import pii


def added(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(pii.personal_data(docs).collect(), key=lambda r: r.doc_id)
    return [[(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added] for r in rows]


def test_context_of_lists_and_after_the_match(spark):
    pad = "x" * 30 + " "
    found = added(spark, [
        "SSN: 123-45-6789, 234-56-7890", "123-45-6789 is my SSN", "SSN " + pad * 2 + "123-45-6789", "123-45-6789 " + pad * 2 + "SSN",
        "Amex 378282246310005, 371449635398431", "é\U0001f600 SSN 123-45-6789 or 000-45-6789 or 234-56-7890",
    ])
    assert found == [
        [("ssn", "123-45-6789"), ("ssn", "234-56-7890")], [("ssn", "123-45-6789")], [], [],
        [("shortcard", "378282246310005"), ("shortcard", "371449635398431")], [("ssn", "123-45-6789"), ("ssn", "234-56-7890")],
    ]


def test_numbers_followed_by_other_words_and_digits(spark):
    found = added(spark, [
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 I think", "IBAN DE89370400440532013000X",
        "Amex 378282246310005 12/27", "Amex 3782 822463 10005 12/27", "card 4222222222222 12/27", "card 4111 1111 1111 1111",
    ])
    amex = [("shortcard", "378282246310005")], [("shortcard", "3782 822463 10005")], [("shortcard", "4222222222222")]
    assert found == [[("iban", "DE89 3704 0044 0532 0130 00")], [("iban", "DE89370400440532013000")], [], *amex, []]


def test_surroundings_are_those_of_the_text(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["12", "345", "é", " ", "x" * 50, "\U0001f600", "9 ", ", ", "card "]) for _ in range(rng.randrange(80))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = F.struct(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0)).alias("values"), F.split("text", "[0-9]{2,}", -1).alias("gaps"))
    numbers = F.sequence(F.lit(1), F.size("found.values"))
    near = F.when(F.size("found.values") > 0, F.transform(numbers, lambda i: F.struct(*(c.alias(n) for n, c in zip("ba", pii._surroundings(F.col("found"), i), strict=True)))))
    for r in docs.withColumn("found", found).select("text", near.alias("near")).collect():
        want = [(r.text[max(0, m.start() - pii.NEAR) : m.start()], r.text[m.end() : m.end() + pii.NEAR]) for m in re.finditer("[0-9]{2,}", r.text)]
        assert [tuple(x) for x in r.near or []] == want


def test_time_grows_with_the_length(spark):
    """A text of nothing but e-mails; the square of the length would take four times as long for twice of it."""
    took = []
    for size in (10_000, 10_000, 20_000, 40_000):
        text = " ".join(f"user{k}@mail{k}.example.com" for k in range(size))
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        began = time.time()
        (row,) = pii.pii_digest(pii.personal_data(docs)).collect()
        took.append(time.time() - began)
        assert row.n_email == size
    print([round(t, 1) for t in took])
    assert took[3] < 3 * took[2] + 2
