"""Search over nodes and groups, details by key, and the editable stop list."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemesh.operators.people import Groups, group_entries


#: A quoted time, or a text, a blank and a quoted time; of several quoted parts the first counts, without its last character.
_FORMS = re.compile(r'(?s)"(?:(?P<only>.*)")?|(?P<text>.*?) "(?P<time>.*?)(?:. ".*)?"')


@dataclass
class Term:
    """A search term: text, a quoted time, or text followed by a quoted time."""

    text: str | None
    time: str | None

    @classmethod
    def read(cls, term: str) -> "Term":
        form = _FORMS.fullmatch(term)
        if form is None:
            return cls(term.lower(), None)
        return cls(None, form["only"] or "") if form["text"] is None else cls(form["text"].lower(), form["time"])

    def matches(self) -> Column:
        """Whether an entry matches: its value without regard to case, its timestamp as written."""
        parts = []
        if self.text is not None:
            parts.append(F.lower("value").contains(self.text))
        if self.time is not None:
            parts.append(F.col("timestamp").contains(self.time))
        return parts[0] if len(parts) == 1 else parts[0] & parts[1]


#: Fixed value: what marks a date in the caption of a filtered entry; own entries use a hyphen.
FILTERED_DATE_MARK = "."


def _time_caption(time: str, date_mark: str = "-") -> str:
    has_date, has_clock = date_mark in time, ":" in time
    if has_date and has_clock:
        return "Full timestamp match"
    return "Date match" if has_date else "Time match" if has_clock else "Timestamp match"


def search(routed: DataFrame, stats: DataFrame, groups: Groups, term: str, sizes: DataFrame | None = None) -> DataFrame:
    """``(node_id, display_text, match_type)``, one row per node or group, own values first.

    A node matches by its own value, else by its earliest matching entry, else by a
    filtered entry on one of its lines; a group by the latter two.  Filtered entries are
    reduced to one per line before they meet the nodes, so no line is paired up.  ``sizes(group_id, _size)`` are
    counted from the members unless given.
    """
    wanted = Term.read(term)
    hit = wanted.matches()
    named = stats.select("node", F.col("type").alias("_type"), F.col("value").alias("_value"))
    caption = F.concat(F.col("_type"), F.lit(": "), F.col("_value"))
    found: list[DataFrame] = []

    def add(df: DataFrame, rank: int, kind: str, text: Column) -> None:
        found.append(df.select("node_id", text.alias("display_text"), F.lit(kind).alias("match_type"), F.lit(rank).alias("_rank")))

    if wanted.text is not None:
        own = named.filter(F.lower("_value").contains(wanted.text)).withColumn("node_id", F.col("node"))
        add(own, 0, "primary", caption)

    def first_entry(df: DataFrame, key: str, order: list[str]) -> DataFrame:
        return df.groupBy(key).agg(F.min_by(F.struct("timestamp", "value"), F.struct(*order)).alias("_e"))

    def entry_text(caption_: Column, node_id: Column, kind: Column, is_group: bool) -> Column:
        if wanted.text is None:
            if is_group:
                return F.concat(node_id, F.lit(" (Match in group)"))
            return F.concat(caption_, F.lit(f" ({_time_caption(wanted.time)}: "), F.col("_e.timestamp"), F.lit(")"))
        if wanted.time is not None:
            return F.concat(
                kind, F.lit(": "), node_id, F.lit(" (Combined match: "), F.lower("_e.value"), F.lit(" at "), F.col("_e.timestamp"), F.lit(")")
            )
        return F.concat(node_id, F.lit(" (part of group)"))

    nodes = routed.filter("route = 'node'")
    by_entry = first_entry(nodes.filter(hit), "node", ["timestamp", "line", "pos"]).join(named, "node")
    by_entry = by_entry.withColumn("node_id", F.col("node"))
    add(by_entry, 1, "entry", entry_text(caption, F.col("node_id"), F.col("_type"), False))

    in_group = first_entry(group_entries(routed, groups).filter(hit), "group_id", ["line", "pos"])
    in_group = in_group.withColumn("node_id", F.concat(F.lit("ID_"), F.col("group_id").cast("string")))
    add(in_group, 1, "entry", entry_text(F.lit("Group"), F.col("node_id"), F.lit("Group"), True))

    per_line = routed.filter("route = 'filtered'").filter(hit).groupBy("line").agg(F.min(F.struct("timestamp", "pos")).alias("_m"))
    seen = nodes.select("line", "node").distinct().join(per_line, "line")
    if sizes is None:
        sizes = groups.members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_size"))

    def filtered_text(caption_: Column) -> Column:
        if wanted.text is None:
            return F.concat(caption_, F.lit(f" ({_time_caption(wanted.time, FILTERED_DATE_MARK)}: "), F.col("_m.timestamp"), F.lit(" (filtered entry))"))
        if wanted.time is not None:
            return F.concat(caption_, F.lit(f" (Combined match: {wanted.text} at {wanted.time} in filtered)"))
        return F.concat(caption_, F.lit(" (found in filtered entries)"))

    by_filtered = seen.groupBy("node").agg(F.min("_m").alias("_m")).join(named, "node").withColumn("node_id", F.col("node"))
    add(by_filtered, 2, "filtered", filtered_text(caption))
    group_filtered = seen.join(groups.members, "node").groupBy("group_id").agg(F.min("_m").alias("_m")).join(sizes, "group_id")
    group_filtered = group_filtered.withColumn("node_id", F.concat(F.lit("ID_"), F.col("group_id").cast("string")))
    add(group_filtered, 2, "filtered", filtered_text(F.concat(F.lit("Group: "), F.col("_size").cast("string"), F.lit(" entries"))))

    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    best = Window.partitionBy("node_id").orderBy("_rank")
    kept = every.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return kept.orderBy(F.col("_rank") != 0, "display_text", "node_id").select("node_id", "display_text", "match_type")


def node_details(stats: DataFrame, key: str) -> DataFrame:
    """A node by key; a trailing ``-N`` is ignored and ``-`` equals ``_``, the exact key winning."""
    bare = re.sub(r"-\d+\Z", "", key)
    exact = F.when(F.col("node") == key, 0).when(F.col("node") == bare, 1).otherwise(2)
    same = F.translate("node", "-", "_") == bare.replace("-", "_")
    return stats.filter((F.col("node") == key) | same).orderBy(exact, "node").limit(1)


def line_details(entries: DataFrame, group_id: int, line: int) -> DataFrame:
    """The entries of a group on one line."""
    return entries.filter((F.col("group_id") == group_id) & (F.col("line") == line))


def stoplist_toggle(stoplist: DataFrame, value: str) -> DataFrame:
    """The stop list without ``value`` if it was in it, else with it."""
    value = value.strip()
    if not value or "\n" in value or "\r" in value or len(value) > 500:
        raise ValueError("a stop value is one line of 1 to 500 characters")
    spark = stoplist.sparkSession
    kept = stoplist.filter(F.col("value") != value)
    present = stoplist.filter(F.col("value") == value)
    added = spark.range(1).select(F.lit(value).alias("value")).join(present, "value", "left_anti")
    return kept.unionByName(added)
