"""Writers.  Results stay distributed: one folder of files per result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemesh.operators.sessions import session_collect, session_rows, session_summary


def write_stats(stats: DataFrame, summary: DataFrame, path: str) -> None:
    """One JSON object: the summary row and the category list (at most ten entries)."""
    order = F.struct((-F.col("cnt")).alias("k"), "category", F.col("cnt").alias("count"), "percentage")
    listed = stats.agg(F.array_sort(F.collect_list(order)).alias("c")).select(
        F.transform("c", lambda x: F.struct(x["category"].alias("category"), x["count"].alias("count"), x["percentage"].alias("percentage"))).alias("categories")
    )
    summary.select(F.struct(*summary.columns).alias("summary"), listed.scalar().alias("categories")).write.mode("overwrite").json(path)


def write_entries(entries: DataFrame, path: str) -> None:
    """Entries or the entries of an identity as JSON lines; a null identity is left out."""
    kept = [name for name in ("line", "timestamp", "type", "value", "identity") if name in entries.columns]
    entries.select(*kept).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_sessions(sessions: DataFrame, path: str, ts: str = "ts", pos: str = "row_number") -> None:
    """Sessions as three JSON tables: ranges, identities, rows.  A session may be too long for one object."""
    session_summary(sessions, ts=ts).write.mode("overwrite").json(f"{path}/sessions")
    session_collect(sessions, ts=ts, pos=pos).write.mode("overwrite").json(f"{path}/identities")
    session_rows(sessions, ts=ts, pos=pos).write.mode("overwrite").json(f"{path}/rows")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """The token dictionary; a later run reads it and adds to it at another path."""
    dictionary.select("token_text", "token", "cnt").write.mode("overwrite").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Provenance records, one JSON object per line."""
    records.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
