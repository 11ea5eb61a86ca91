"""The given tables seen as logs, entries, identity rows and records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh.functions import node_key
from tracemesh.session import shared_folder, spread

#: Texts, and whole pages, that one task may search.
TASK_ROWS, TASK_PAGES = 50_000, 2_000
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tracemesh/files/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return _events(load(spark, sf, "events"))


def _events(table: DataFrame) -> DataFrame:
    return table.select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """One log line per event, ``(line, text)``, in the style of a login service."""
    user, k = F.col("user_id"), F.col("k")
    head = _text(F.date_format("ts", "MMM dd HH:mm:ss"), " host", k, " sshd[", user, "]: ")
    address = _text("10.0.", user, ".", k)
    seconds = F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)")
    two = lambda number: F.lpad((number % 100).cast("string"), 2, "0")
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", _text(head, "Failed password for invalid user u", user, " from ", address, " port ", k + 20000))
        .when(kind == "click", _text(head, "Accepted publickey for u", user, " from ", address, " tty=pts/", k, " mac 02:00:5e:10:", two(user), ":", two(k)))
        .when(
            kind == "view",
            _text(
                head, "GET http://www.site", k, ".example.com/u", user, "?k=", k, ' {"host": "host', k, '.example.org"} at ',
                F.date_format("ts", "yyyy-MM-dd"), "T", F.date_format("ts", "HH:mm:ss"), ".000Z",
            ),
        )
        .when((kind == "signup") & (k % 2 == 0), _text(user + 100, " Main Street"))
        .when(
            kind == "signup",
            _text(head, "User u", user, "@mail", k, ".example.org from pts/", k, " PID:", user, " call +1 555-010-", F.lpad(k.cast("string"), 4, "0")),
        )
        .otherwise(
            _text(
                head, "Invalid user u", user, " from ", address, " at ", seconds, " on ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                " mac 02005e10", F.lpad((user % 10000).cast("string"), 4, "0"), " .",
            )
        )
    )
    return spread(events(spark, sf), "event_id", TASK_ROWS).select(F.col("event_id").alias("line"), text.alias("text"))


def all_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of the tables and the event log: ``(src, id, text)``."""
    parts = [
        event_log(spark, sf).select(F.lit("log").alias("src"), F.col("line").alias("id"), "text"),
        spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", TASK_ROWS).select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text"),
        load(spark, sf, "pages").select(F.lit("url").alias("src"), F.col("page_id").alias("id"), F.col("url").alias("text")),
        spread(load(spark, sf, "pages").select("page_id", "html"), "page_id", TASK_PAGES).select(F.lit("html").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text")),
        load(spark, sf, "conversations").select(F.lit("chat").alias("src"), F.col("conv_id").alias("id"), "text"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All texts split into lines: ``(src, id, line, text)``."""
    lines = all_text(spark, sf).select("src", "id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.withColumn("line", (F.col("line") + 1).cast("bigint"))


def values(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of all texts, the whole log lines, and the terminals of the events."""
    words = all_text(spark, sf).select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("value"))
    terminals = events(spark, sf).select(_text("/dev/pts", F.col("k")).alias("value"))
    return words.unionByName(event_log(spark, sf).select(F.col("text").alias("value"))).unionByName(terminals).distinct()


def event_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Four entries per event: user, address, event type and host."""
    rows = [
        ("Username", _text("u", F.col("user_id"))),
        ("IP", _text("10.0.", F.col("user_id"), ".", F.col("k"))),
        ("Event", F.col("event_type")),
        ("Hostname", _text("host-", F.col("k"))),
    ]
    found = F.array(*[F.struct(F.lit(name).alias("type"), value.alias("value")) for name, value in rows])
    return events(spark, sf).select(
        F.col("event_id").alias("line"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "user_id",
        F.posexplode(found).alias("pos", "e"),
    ).select("line", F.col("pos").cast("bigint").alias("pos"), "timestamp", "e.type", "e.value", F.col("user_id").alias("group_id"))


def user_entries(spark: SparkSession, sf: str) -> DataFrame:
    """All entries with the user as the group, for the reports on given groups."""
    return event_entries(spark, sf).withColumn("node", node_key(F.col("type"), F.col("value")))


def day_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Users and hosts of one day: ``u3@2024-01-05`` on ``host-0-4@2024-01-05``, in three separate nets a day.

    Nets begin as several groups that merge as the day goes on.  Every seventh host is not recorded; its
    users are on a line of their own.
    """
    day, user, k = F.date_format("ts", "yyyy-MM-dd"), F.col("user_id"), F.col("k")
    alone = k % 7 == 0
    who = F.struct(F.lit("Username").alias("type"), F.when(alone, _text("lone", user % 5, "@", day)).otherwise(_text("u", user % 12, "@", day)).alias("value"))
    host = F.struct(F.lit("Hostname").alias("type"), _text("host-", user % 3, "-", k % 5, "@", day).alias("value"))
    return events(spark, sf).select(
        F.col("event_id").alias("line"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.posexplode(F.when(alone, F.array(who)).otherwise(F.array(who, host))).alias("pos", "e"),
    ).select("line", F.col("pos").cast("bigint").alias("pos"), "timestamp", "e.type", "e.value")


def order_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers as entries of their order."""
    found = F.array(
        F.struct(F.lit("part").alias("type"), _text("p", F.col("l_partkey")).alias("value")),
        F.struct(F.lit("supp").alias("type"), _text("s", F.col("l_suppkey")).alias("value")),
    )
    rows = spread(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])
    return rows.select(F.col("l_orderkey").alias("line"), F.explode(found).alias("e")).select("line", "e.*")


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Identity rows: event number, time, event type, user."""
    return event_identities(load(spark, sf, "events"))


def event_identities(table: DataFrame) -> DataFrame:
    """The identity rows of a table or stream of events."""
    return _events(table).select(
        F.col("event_id").alias("row_number"), "ts", F.col("event_type").alias("type"), _text("u", F.col("user_id")).alias("value"), "user_id"
    )


def event_records(spark: SparkSession, sf: str) -> DataFrame:
    """Structured log records ``(rec, json)`` of the events."""
    fields = F.struct(
        F.col("user_id").alias("user"),
        F.col("event_type").alias("Event"),
        "k",
        F.expr(f"cast(timestampdiff(SECOND, {EPOCH}, ts) as string)").alias("when"),
    )
    return spread(events(spark, sf), "event_id", TASK_ROWS).select(F.col("event_id").alias("rec"), F.to_json(fields).alias("json"))


def order_records(spark: SparkSession, sf: str) -> DataFrame:
    """Structured log records of the orders, which share some texts with each other but not with the events."""
    fields = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("user"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("rec"), F.to_json(fields).alias("json"))


def document_records(spark: SparkSession, sf: str) -> DataFrame:
    """Provenance records derived from the documents: ``(doc_id, json)``, many of them faulty."""
    sized = F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("double") + 0.5).otherwise(F.col("n_chars").cast("double"))
    record = F.struct(
        F.struct(
            F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("timestamp"),
            F.col("source").alias("author"),
            F.when(F.col("lang") == "en", "collection").otherwise(F.col("lang")).alias("processing type"),
        ).alias("entry"),
        F.struct(
            F.struct(
                F.struct(
                    F.concat(F.lit("2030-02-"), F.lpad((F.col("doc_id") % 31).cast("string"), 2, "0")).alias("deadline"),
                    F.when(F.col("doc_id") % 3 == 0, "keep").otherwise("delete").alias("removal policy"),
                ).alias("retention")
            ).alias("storage"),
            F.struct(sized.alias("size"), F.col("n_chars").alias("event count")).alias("metrics"),
            F.struct(F.struct(F.concat("source", F.lit("@example.org")).alias("contact email")).alias("owner")).alias("rights"),
            F.struct(F.when(F.col("doc_id") % 5 == 0, "clean").otherwise("raw").alias("sanitation")).alias("PII"),
        ).alias("data facts"),
    )
    return load(spark, sf, "documents").select("doc_id", F.to_json(record).alias("json"))
