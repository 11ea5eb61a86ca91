"""URL filters with dated lists: every capture is judged by the entries in force when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.operators.order import join_counted

SALTS = 8


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def keys_of(url: Column) -> Column:
    """What a list may name to reach this URL: the URL itself, its host and every parent domain with a dot."""
    labels = F.split(host_of(url), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("url:"), url)), F.when(host_of(url) != "", parents).otherwise(F.array())))


def validity(entries: DataFrame) -> DataFrame:
    """``(key, list, valid_from, valid_to)`` from dated entries ``(key, list, day, listed)``.

    An entry holds from its day until the day before the next entry of the same key and list; only those that
    list the key become intervals.  Of entries of one day a listing outweighs a removal.  Entries
    without a key or day are no entries.
    """
    daily = entries.filter("key IS NOT NULL AND day IS NOT NULL").groupBy("key", "list", "day").agg(F.max("listed").alias("listed"))
    following = F.lead("day").over(Window.partitionBy("key", "list").orderBy("day"))
    dated = daily.withColumn("valid_to", following)
    return dated.filter("listed").select("key", "list", F.col("day").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``(capture_id, url, fetch_day, n_lists, matched_key, listed_since)``, one row per capture ``(capture_id, url, fetch_day)``.

    ``n_lists`` is the number of distinct (key, list) intervals that hold on the fetch day; ``matched_key`` the first of
    their keys and ``listed_since`` the earliest day they hold from.  Captures are reduced to distinct (URL, day)
    and their keys to distinct (key, day) before the list is looked up, so a host with a third of all captures
    is looked up once a day; the way back is a join with the most frequent keys split off, and a salted one.

    A null URL or fetch day matches no entry.  Repeated captures each get their row; empty tables are fine.
    """
    captures = captures.select(F.col("capture_id"), F.col("url"), F.col("fetch_day"))
    distinct = captures.filter("url IS NOT NULL AND fetch_day IS NOT NULL").groupBy("url", "fetch_day").agg(F.count(F.lit(1)).alias("n"))
    keyed = distinct.select("url", "fetch_day", F.explode(keys_of(F.col("url"))).alias("key")).withColumn("look", F.concat_ws("@", F.col("fetch_day").cast("string"), "key"))
    wanted = keyed.groupBy("look", "key", "fetch_day").agg(F.count(F.lit(1)).alias("n"))
    held = validity(entries)
    as_of = (F.col("valid_from") <= F.col("fetch_day")) & (F.col("valid_to").isNull() | (F.col("fetch_day") < F.col("valid_to")))
    active = wanted.join(held, "key").filter(as_of)
    active = active.groupBy("look").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("lists"), F.min("valid_from").alias("since"))
    hits = join_counted(keyed, active, "look", "n").groupBy("url", "fetch_day").agg(
        F.sum("lists").alias("n_lists"), F.min("key").alias("matched_key"), F.min("since").alias("listed_since")
    )
    salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_salt = captures.withColumn("salt", F.pmod(F.hash("capture_id"), F.lit(SALTS)))
    judged = with_salt.join(salted, ["url", "fetch_day", "salt"], "left")
    return judged.select("capture_id", "url", "fetch_day", F.coalesce("n_lists", F.lit(0)).cast("bigint").alias("n_lists"), "matched_key", "listed_since")
