"""Provenance records: what was collected, by whom, how large, and what may be in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh.functions.predicates import is_email
from tracemesh.sources.logs import count_events

# --- fixed values: record schema and allowed words --------------------------
RECORD_SCHEMA = """
entry STRUCT<timestamp: STRING, author: STRING, `processing type`: STRING, `processing description`: STRING>,
`data facts` STRUCT<
  description: STRING,
  storage: STRUCT<`source location`: STRING, location: STRING, `location other`: STRING,
                  retention: STRUCT<deadline: STRING, `removal policy`: STRING>>,
  metrics: STRUCT<`start time`: STRING, `end time`: STRING, `collection time`: STRING, size: VARIANT,
                  `event count`: VARIANT, `other metrics`: ARRAY<STRING>>,
  rights: STRUCT<license: STRING, `other license`: STRING,
                 owner: STRUCT<`owner name`: STRING, `contact name`: STRING, `contact email`: STRING,
                               `contact phone`: STRING, `contact other`: STRING, citation: STRING>>,
  PII: STRUCT<sanitation: STRING, `may contain`: ARRAY<STRING>, `may contain other`: ARRAY<STRING>,
              `confirmed to contain`: ARRAY<STRING>, `confirmed to contain other`: ARRAY<STRING>>>
"""
PROCESSING_TYPES = (
    "identification",
    "collection",
    "manual transformation",
    "automatic transformation",
    "audit",
    "analysis",
    "destruction",
    "other",
)
REMOVAL_POLICIES = ("delete", "delete and notify", "return and delete")
SANITATION_LEVELS = ("raw", "pseudonymized", "anonymized")
MAY_CONTAIN = ("system identifiers", "user identifiers", "IP addresses")

_DATE = r"\A\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_CLOCK = r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?"


def _date(value: Column) -> Column:
    return value.rlike(_DATE + r"\z") & F.substring(value, 1, 10).try_cast("date").isNotNull()


def _date_time(value: Column) -> Column:
    form = value.rlike(_DATE + r"[Tt ]" + _CLOCK + r"([Zz]|[+-]\d{2}:?\d{2})\z")
    return form & F.substring(value, 1, 10).try_cast("date").isNotNull()


def validate_records(records: DataFrame) -> DataFrame:
    """Rule violations ``(<id columns>, path, rule, value)`` of records given as ``json`` text.

    A field that is missing violates nothing; a text that is not JSON violates ``json``.
    """
    ids = [name for name in records.columns if name != "json"]
    parsed = records.withColumn("r", F.from_json("json", RECORD_SCHEMA, {"mode": "PERMISSIVE"}))
    parsed = parsed.withColumn("_json", F.try_parse_json("json"))

    def text(path: str) -> Column:
        return F.col("r." + ".".join(f"`{part}`" for part in path.split("/")))

    def word(path: str, allowed: tuple[str, ...]):
        return path, "enum", text(path), ~text(path).isin(*allowed)

    def form(path: str, rule: str, test):
        return path, rule, text(path), text(path).isNotNull() & ~test(text(path))

    def whole(path: str):
        number = text(path)
        kind = F.schema_of_variant(number)
        as_text = F.to_json(number)
        return path, "integer", as_text, ~(kind.isin("BIGINT", "VOID") | as_text.rlike(r"\A-?\d+(\.0+)?\z"))

    metrics = "data facts/metrics/"
    rules = [
        form("entry/timestamp", "date-time", _date_time),
        word("entry/processing type", PROCESSING_TYPES),
        form("data facts/storage/retention/deadline", "date", _date),
        word("data facts/storage/retention/removal policy", REMOVAL_POLICIES),
        form(metrics + "start time", "date-time", _date_time),
        form(metrics + "end time", "date-time", _date_time),
        form(metrics + "collection time", "date-time", _date_time),
        whole(metrics + "size"),
        whole(metrics + "event count"),
        form("data facts/rights/owner/contact email", "email", is_email),
        word("data facts/PII/sanitation", SANITATION_LEVELS),
    ]
    broken = [
        F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"), value.alias("value")))
        for path, rule, value, bad in rules
    ]
    not_json = F.struct(F.lit("").alias("path"), F.lit("json").alias("rule"), F.col("json").alias("value"))
    found = F.when(F.col("_json").isNull(), F.array(not_json)).otherwise(F.array_compact(F.array(*broken)))
    return parsed.select(*ids, F.explode(found).alias("v")).select(*ids, "v.*")


def make_records(
    facts: DataFrame,
    author: str,
    as_of: str,
    system: Column,
    owner: str = "",
    contact: str = "",
    citation: str = "",
    license_note: str = "see the place of origin",
    collected: str = "Logs collected from",
    described: str = "Log file of",
    caution: str = "not checked for sensitive content",
) -> DataFrame:
    """Collection records as ``json`` text from ``(location, source, size, events)``.

    ``collected`` and ``described`` come before the system in the two descriptions; ``license_note`` and ``caution`` are taken as they are.
    """

    def named(**parts) -> Column:
        return F.struct(*[value.alias(name.replace("_", " ")) for name, value in parts.items()])

    blank, now = F.lit(""), F.lit(as_of)
    none = F.array().cast("array<string>")
    file = F.element_at(F.split("location", "/"), -1)
    record = F.struct(
        named(
            timestamp=now,
            author=F.lit(author),
            processing_type=F.lit("collection"),
            processing_description=F.concat(F.lit(f"{collected} "), system),
        ).alias("entry"),
        named(
            description=F.concat(F.lit(f"{described} "), system, F.lit(": "), file),
            storage=named(
                source_location=F.col("source"),
                location=F.col("location"),
                location_other=blank,
                retention=named(deadline=blank, removal_policy=F.lit("delete")),
            ),
            metrics=named(
                start_time=blank,
                end_time=blank,
                collection_time=now,
                size=F.col("size"),
                event_count=F.col("events"),
                other_metrics=none,
            ),
            rights=named(
                license=F.lit("other"),
                other_license=F.lit(license_note),
                owner=named(
                    owner_name=F.lit(owner),
                    contact_name=blank,
                    contact_email=blank,
                    contact_phone=blank,
                    contact_other=F.lit(contact),
                    citation=F.lit(citation),
                ),
            ),
            PII=named(
                sanitation=F.lit("pseudonymized"),
                may_contain=F.array(*map(F.lit, MAY_CONTAIN)),
                may_contain_other=F.array(F.lit(caution)),
                confirmed_to_contain=none,
                confirmed_to_contain_other=none,
            ),
        ).alias("data facts"),
    )
    return facts.select("location", F.to_json(record).alias("json"))


def build_records(spark: SparkSession, path: str, author: str, as_of: str, source: str = "", **about: str) -> DataFrame:
    """One collection record per file below ``path``; the folder of a file names its system."""
    facts = count_events(spark, path).select("location", F.lit(source).alias("source"), "size", "events")
    system = F.element_at(F.split("location", "/"), -2)
    return make_records(facts, author, as_of, system, **about)
