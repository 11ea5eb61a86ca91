"""Results that are kept between sessions and grow with new input: stop list, dictionary, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemesh.functions import vkey
from tracemesh.operators.forest import components
from tracemesh.operators.order import join_counted, join_lookup
from tracemesh.operators.search import stoplist_toggle
from tracemesh.operators.templates import build_dictionary
from tracemesh.session import discard, materialise
from tracemesh.sources.kept import KeptTables, Snapshot


def toggle_stop_value(kept: KeptTables, value: str) -> Snapshot:
    """Take ``value`` off the kept stop list if it is on it, else add it; toggles of several writers all count."""

    def change(now: Snapshot):
        known = now.read("stoplist")
        if known is None:
            known = kept.spark.createDataFrame([], "value string")
        return {"stoplist": stoplist_toggle(known, value)}, {}

    return kept.update(change)


def grow_dictionary(kept: KeptTables, records: DataFrame) -> Snapshot:
    """Add the tokens of ``records`` to the kept dictionary; tokens never change, whoever writes first numbers first.

    ``cnt`` of a version is how often a token occurs in the records that made it.
    """
    return kept.update(lambda now: ({"dictionary": build_dictionary(records, existing=now.read("dictionary"))}, {}))


def add_lines(kept: KeptTables, entries: DataFrame) -> Snapshot:
    """Take new entries ``(line, type, value)`` into the kept identities: lines that share a value, directly or through others.

    Only identities that the new entries touch are worked on: the new lines and the identities of their known values make a
    small graph, whose components are the new identities.  Kept are ``lines(line, born)`` and ``values(vkey, born)``, to which rows
    are added only, and ``moves(born, start)``, which says what an identity has been merged into; an identity is named by its first
    line.  Entries of known lines are taken, repeated ones change nothing, and a null value only makes its line known.
    """
    pairs = materialise(entries.select(F.col("line").cast("bigint").alias("line"), vkey(F.col("type"), F.col("value")).alias("vkey")).distinct(), "delta")

    def change(now: Snapshot):
        old_lines, old_values, moves = now.read("lines"), now.read("values"), now.read("moves")
        spark = kept.spark
        if moves is None:
            old_lines = spark.createDataFrame([], "line bigint, born bigint")
            old_values = spark.createDataFrame([], "vkey string, born bigint")
            moves = spark.createDataFrame([], "born bigint, start bigint")

        def named(rows: DataFrame, key: str) -> DataFrame:
            """``(key, start)``: identities as of this version."""
            moved = join_lookup(rows, moves, "born", [key], "left")
            return materialise(moved.select(key, F.coalesce("start", "born").alias("start")), f"known-{key}")

        lines = pairs.select("line").distinct()
        firsts = pairs.filter("vkey IS NOT NULL").groupBy("vkey").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
        firsts = materialise(firsts, "first-lines")
        known_lines = named(old_lines.join(lines, "line", "left_semi"), "line")
        known_values = named(old_values.join(firsts, "vkey", "left_semi"), "vkey")
        links = (
            lines.select(F.col("line").alias("src"), F.col("line").alias("dst"))
            .unionByName(join_counted(pairs, firsts, "vkey", "n").select(F.col("first").alias("src"), F.col("line").alias("dst")))
            .unionByName(known_values.join(firsts, "vkey").select(F.col("first").alias("src"), F.col("start").alias("dst")))
            .unionByName(known_lines.select(F.col("line").alias("src"), F.col("start").alias("dst")))
        )
        found = components(materialise(links.distinct(), "links"))
        starts = found.groupBy("root").agg(F.min("node").alias("start"), F.count(F.lit(1)).alias("n"))
        labels = materialise(join_counted(found, starts, "root", "n").select("node", "start"), "labels")
        # A node that was an identity and is not the first line of its component has been merged.
        identities = known_values.select("start").unionByName(known_lines.select("start")).distinct()
        merged = labels.filter("node <> start").join(identities.withColumnRenamed("start", "node"), "node", "left_semi")
        merged = materialise(merged.select(F.col("node").alias("born"), "start"), "merged")
        onwards = merged.select(F.col("born").alias("start"), F.col("start").alias("_to"))
        moves_on = join_lookup(moves, onwards, "start", ["born"], "left").select("born", F.coalesce("_to", "start").alias("start"))
        new_lines = lines.join(known_lines, "line", "left_anti").join(labels, lines["line"] == labels["node"]).select("line", F.col("start").alias("born"))
        new_values = firsts.join(known_values, "vkey", "left_anti").join(labels, F.col("first") == F.col("node")).select("vkey", F.col("start").alias("born"))
        return {"moves": moves_on.unionByName(merged)}, {"lines": new_lines, "values": new_values}

    done = kept.update(change)
    discard(pairs)
    return done


def kept_identities(now: Snapshot) -> DataFrame:
    """``(line, start)`` of every line; ``start`` is the first line of its identity."""
    moved = join_lookup(now.read("lines"), now.read("moves"), "born", ["line"], "left")
    return moved.select("line", F.coalesce("start", "born").alias("start"))
