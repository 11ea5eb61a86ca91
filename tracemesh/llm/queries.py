"""The operators on their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh.llm import align, byte_bpe, collocations, exact_dedup, mixing, pii, piecewise, quality_rules, simhash, subword, token_files, toxicity, url_lists
from tracemesh.llm.common import load

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, load(spark, sf, "labels")))


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(load(spark, sf, "documents"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf, "documents"))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_rules(load(spark, sf, "documents"))


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    manifest = token_files.write_tokens(load(spark, sf, "documents"), folder, public_tokenizers.path(WORD_TOKENIZER))
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return subword.score_quality(docs, subword.fit_quality(docs, load(spark, sf, "labels")))


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    encoded = byte_bpe.encode(load(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN))


def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pii_digest(pii.personal_data(load(spark, sf, "documents")))


def captures_of(pages: DataFrame) -> DataFrame:
    """Every page as a capture; the tables have no fetch times, so page n was fetched on day n modulo 366 of 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("fetch_day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts and URLs of the pages.

    A hash of the key chooses them: one host in 4 is listed at some day of the first half year, one in 8 leaves the
    list 60 days later, one in 16 is listed again 60 days after; of the URLs one in 32 is listed at some day of the year.
    """
    code = lambda key: F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    hosts = pages.select(F.concat(F.lit("host:"), url_lists.host_of(F.col("url"))).alias("key")).distinct().withColumn("h", code(F.col("key")))
    first = (F.floor(F.col("h") / 16) % 180).cast("int")
    event = lambda every, days, listed: F.when(F.col("h") % every == 0, F.struct(F.date_add(start, first + days).alias("day"), F.lit(listed).alias("listed")))
    events = F.explode(F.filter(F.array(event(4, 0, True), event(8, 60, False), event(16, 120, True)), lambda e: e.isNotNull()))
    of_hosts = hosts.select("key", F.lit("hosts").alias("list"), events.alias("e")).select("key", "list", "e.day", "e.listed")
    urls = pages.select(F.concat(F.lit("url:"), F.col("url")).alias("key")).distinct().withColumn("h", code(F.col("key")))
    chosen = urls.filter("h % 32 = 0").select("key", F.lit("urls").alias("list"), F.date_add(start, (F.floor(F.col("h") / 32) % 366).cast("int")).alias("day"), F.lit(True).alias("listed"))
    return of_hosts.unionByName(chosen)


def op10_url_lists(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", "url")
    judged = url_lists.judge_captures(captures_of(pages), entries_of(pages))
    return judged.select(F.col("capture_id").alias("page_id"), "fetch_day", "n_lists", "matched_key", "listed_since")


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(load(spark, sf, "documents"))


def op12_piecewise(spark: SparkSession, sf: str) -> DataFrame:
    return piecewise.compare_with_next(load(spark, sf, "documents"))


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    tokenizers = align.read_tokenizers(spark, public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.PATTERN, public_tokenizers.path(PIECE_MODEL))
    found = align.align(load(spark, sf, "documents"), tokenizers)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return align.link_scores(found.select("doc_id", "n_a", "n_b", "n_groups", digest, "links"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_mixing, op3_simhash, op4_exact_dedup, op5_quality_rules, op6_token_files, op7_quality_classifier,
        op8_byte_bpe, op9_pii, op10_url_lists, op11_collocations, op12_piecewise, op13_alignment,
    )
}
