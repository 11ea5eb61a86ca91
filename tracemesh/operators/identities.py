"""Identities: which lines belong together because they share values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemesh.functions import vkey
from tracemesh.operators.entries import filter_types
from tracemesh.operators.forest import components, to_roots
from tracemesh.operators.order import join_counted, number_rows, previous_value
from tracemesh.operators.stats import qualifying_values
from tracemesh.session import materialise


def _qualified(entries: DataFrame, types, max_freq: float, greedy: bool) -> DataFrame:
    keep = qualifying_values(entries, types, max_freq, greedy).select("type", "value")
    return filter_types(entries, types).join(keep, ["type", "value"], "left_semi")


def _components(entries: DataFrame, types, max_freq: float) -> DataFrame:
    """Line to the smallest line of its component; lines that share nothing stand alone."""
    pairs = _qualified(entries, types, max_freq, greedy=False).select("type", "value", "line")
    pairs = materialise(pairs, "value-lines")
    # One edge from each line to the first line of the value links the same lines as all pairs would.
    first = pairs.groupBy("type", "value").agg(F.min("line").alias("src"))
    edges = pairs.join(first, ["type", "value"]).select("src", F.col("line").alias("dst")).filter("src <> dst")
    labels = components(materialise(edges, "links"))
    smallest = labels.groupBy("root").agg(F.min("node").alias("start"), F.count(F.lit(1)).alias("_n"))
    linked = join_counted(labels, smallest, "root", "_n").select(F.col("node").alias("line"), "start")
    lines = entries.select("line").distinct()
    return lines.join(linked, "line", "left").select("line", F.coalesce("start", "line").alias("start"))


def _greedy(entries: DataFrame, types, max_freq: float) -> DataFrame:
    """Line to the place ``(line, pos)`` where its identity began, for the ordered one-pass rule.

    In one pass over the entries a new value takes the identity its line has at that
    moment, which is the identity of the qualifying value just before it on the line.
    So each value points to that earlier value, or begins an identity; following the
    pointers gives the identity of every value, and a line ends with that of its last value.
    """
    kept = _qualified(entries, types, max_freq, greedy=True)
    kept = kept.select("line", "pos", vkey(F.col("type"), F.col("value")).alias("vkey"))
    kept = previous_value(materialise(kept, "kept"), "line", "pos", F.col("vkey"), "_before")
    place = F.struct("line", "pos")
    values = materialise(
        kept.groupBy("vkey").agg(F.min(place).alias("c"), F.min_by("_before", place).alias("_before")), "values"
    )
    begun = values.select(F.col("vkey").alias("_before"), F.col("c").alias("_parent"))
    hooks = values.join(begun, "_before", "left").select("c", F.coalesce("_parent", "c").alias("parent"), "vkey")
    roots = to_roots(hooks).select("vkey", F.col("parent").alias("start"))
    last = kept.groupBy("line").agg(F.max_by("vkey", "pos").alias("vkey"))
    return last.join(roots, "vkey").select("line", "start")


def identities(
    entries: DataFrame, types: str | Iterable[str] | None = None, max_freq: float = 10.0, mode: str = "greedy"
) -> DataFrame:
    """Entries with ``identity`` = ``1..n``, numbered by where the identity begins.

    ``mode='greedy'`` is the ordered one-pass rule; ``mode='components'`` joins all lines
    that share a qualifying value, directly or through others.  Entries on lines without
    an identity keep null.
    """
    if mode not in ("greedy", "components"):
        raise ValueError("mode is 'greedy' or 'components'")
    find = _greedy if mode == "greedy" else _components
    lines = materialise(find(entries, types, max_freq), "line-identity")
    starts = lines.groupBy("start").agg(F.count(F.lit(1)).alias("_n"))
    if mode == "greedy":
        starts = starts.select("start", "_n", F.col("start.line").alias("_line"), F.col("start.pos").alias("_pos"))
        numbered = number_rows(starts, ["_line", "_pos"], "identity").drop("_line", "_pos")
    else:
        numbered = number_rows(starts, ["start"], "identity")
    return entries.join(join_counted(lines, numbered, "start", "_n").select("line", "identity"), "line", "left")


def _is_value(value: str):
    return (F.col("value") == value) | (vkey(F.col("type"), F.col("value")) == value)


def search_identity(tagged: DataFrame, value: str, cap: int | None = None) -> DataFrame:
    """All entries of the identity that holds a value, given as ``value`` or ``type:value``.

    Empty if the value does not occur, occurs more than ``cap`` times or has no identity;
    of several identities the first is taken.
    """
    hits = tagged.filter(_is_value(value)).agg(F.count(F.lit(1)).alias("n"), F.min("identity").alias("identity"))
    if cap is not None:
        hits = hits.filter(F.col("n") <= cap)
    return tagged.join(F.broadcast(hits.select("identity")), "identity").transform(_named)


def search_outcome(tagged: DataFrame, value: str, cap: int | None = None) -> DataFrame:
    """One row: how often a value occurs and what a search for it finds."""
    hits = tagged.agg(
        F.count(F.when(_is_value(value), 1)).alias("cnt"), F.min(F.when(_is_value(value), F.col("identity"))).alias("identity")
    )
    frequent = F.lit(False) if cap is None else F.col("cnt") > cap
    outcome = (
        F.when(F.col("cnt") == 0, "not found")
        .when(frequent, "too frequent")
        .when(F.col("identity").isNull(), "no identity")
        .otherwise("found")
    )
    return hits.select(F.lit(value).alias("value"), "cnt", outcome.alias("outcome"), F.when(outcome == "found", F.col("identity")).alias("identity"))


def trace_identity(tagged: DataFrame, number: int) -> DataFrame:
    """The entries of one identity, tagged with its name."""
    return tagged.filter(F.col("identity") == number).transform(_named)


def _named(entries: DataFrame) -> DataFrame:
    return entries.withColumn("identity", F.concat(F.lit("Identity_"), F.col("identity").cast("string")))
