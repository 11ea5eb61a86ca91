"""Nodes, the groups they form by sharing lines, and the log of how each group came about."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemesh.functions import node_key, node_label, normalise_type, strip_query
from tracemesh.functions.labels import KEY_PREFIX
from tracemesh.functions.patterns import PERSONAL_TYPES
from tracemesh.functions.times import parse_ts
from tracemesh.operators.forest import Forest, spanning_forest
from tracemesh.operators.order import join_counted, join_lookup, number_rows
from tracemesh.session import materialise

SPECIAL_TYPES = ("Example", "Example2")
LINK_ORDER = ["line", "pos_a", "pos_b"]


def route_entries(
    entries: DataFrame,
    stoplist: DataFrame | None = None,
    exclude: Iterable[str] = (),
    special_types: Iterable[str] = SPECIAL_TYPES,
    normalise_types: bool = True,
    unknown_types: str = "keep",
    by: str = "key",
) -> DataFrame:
    """Add ``route`` (``node`` or ``filtered``) and, for nodes, ``node``.

    What the user excludes, by value or by type, is filtered; stop-listed values, special
    types and personal types become nodes; the rest is filtered.  ``normalise_types=False``
    keeps spellings that the grouping does not know.  ``unknown_types='drop'`` loses nodes whose
    type has no prefix.  ``by='label'`` tells apart values that share a cleaned key.
    """
    exclude = list(exclude)
    special = [name for name in special_types if name not in exclude]
    known = entries.filter((F.col("type") != "") & (F.col("value") != "")).withColumn("type", F.trim("type"))
    if normalise_types:
        known = known.withColumn("type", normalise_type(F.col("type")))
    stopped = F.lit(False)
    if stoplist is not None:
        stops = stoplist.select("value").distinct().withColumn("_stop", F.lit(True))
        known = join_lookup(known, stops, "value", ["line", "pos"], "left")
        stopped = F.coalesce("_stop", F.lit(False))
    type_, value = F.col("type"), F.col("value")
    excluded = type_.isin(exclude) | value.isin(exclude) if exclude else F.lit(False)
    route = F.when(excluded, "filtered").when(stopped | type_.isin(special + list(PERSONAL_TYPES)), "node").otherwise("filtered")
    name = node_key(type_, value) if by == "key" else node_label(type_, value)
    routed = known.withColumn("route", route).withColumn("node", F.when(F.col("route") == "node", name)).drop("_stop")
    if unknown_types == "drop":
        prefixes = [name for name in KEY_PREFIX if normalise_types or name != "MAC"]
        routed = routed.filter((F.col("route") != "node") | type_.isin(prefixes))
    return routed


def line_links(routed: DataFrame) -> DataFrame:
    """``(src, dst, line, pos_a, pos_b)``: the first node of a line with each later one, first occurrence only.

    These connect exactly what all pairs of a line connect, and replayed in the order
    (line, pos_a, pos_b) they change the groups at exactly the same steps, because after its
    links from the first node a line is in one group.  A node twice on a line links to itself.
    """
    nodes = materialise(routed.filter("route = 'node'").select("line", "pos", "node"), "line-nodes")
    first = nodes.groupBy("line").agg(F.min("pos").alias("pos_a"), F.min_by("node", "pos").alias("src"))
    pairs = nodes.join(first, "line").filter("pos > pos_a")
    # Unordered: a later link in the other direction changes nothing.
    ends = [F.least("src", "node").alias("_x"), F.greatest("src", "node").alias("_y")]
    # A line has one first node, so once a node is on a line once, the line alone tells which link is earliest.
    once = pairs.groupBy("line", "pos_a", "src", "node").agg(F.min("pos").alias("pos_b"))
    earliest = once.groupBy(*ends).agg(
        F.min("line").alias("line"),
        *[F.min_by(name, "line").alias(name) for name in ("pos_a", "pos_b")],
        F.min_by(F.col("src") <= F.col("node"), "line").alias("_up"),
    )
    src, dst = F.when(F.col("_up"), F.col("_x")).otherwise(F.col("_y")), F.when(F.col("_up"), F.col("_y")).otherwise(F.col("_x"))
    return earliest.select(src.alias("src"), dst.alias("dst"), "line", "pos_a", "pos_b")


@dataclass
class Groups:
    """``members(node, group_id)`` with the links and the forest they came from.

    ``numbered(node, group_id, c, first)`` adds the numbers of the forest; ``changes`` keeps what :func:`merge_events` has written.
    """

    members: DataFrame
    links: DataFrame
    forest: Forest
    numbered: DataFrame | None = None
    changes: DataFrame | None = None

    def count(self) -> DataFrame:
        return self.members.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("n"))


def person_groups(links: DataFrame) -> Groups:
    """Connected nodes as groups ``1..n``, numbered by the link that began them."""
    links = materialise(links, "links")
    forest = spanning_forest(links, LINK_ORDER)
    roots = forest.nodes.groupBy("r").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("_n"))
    roots = number_rows(roots, ["first"], "group_id").select("r", "group_id", "_n")
    numbered = join_counted(forest.nodes, roots, "r", "_n").select("node", "group_id", "c", "first")
    numbered = materialise(numbered, "members")
    return Groups(numbered.select("node", "group_id"), links, forest, numbered)


def merge_events(groups: Groups) -> DataFrame:
    """The links that changed a group, ``(group_id, event, src, dst, new_member, line, pos_a, pos_b, seq, level, a)``.

    ``seq`` is the number of the link, ``level`` the round that picked it (null for self links), ``a`` the number of ``src``.

    A link changes something exactly if it is in the minimum spanning forest, or if it is
    the self link that first registers a node.  A node is new to a link if no earlier
    link touches it, which tells forming (both new), adding (one new) and merging apart.
    """
    if groups.changes is None:
        columns = ["src", "dst", *LINK_ORDER, "seq", "a", "b"]
        selfs = groups.forest.links.filter("a = b").select(*columns, F.lit(None).cast("int").alias("level"))
        changes = groups.forest.edges.select(*columns, "level").unionByName(selfs)
        a = groups.numbered.select(F.col("c").alias("a"), F.col("first").alias("_fa"), "group_id")
        b = groups.numbered.select(F.col("c").alias("b"), F.col("first").alias("_fb"))
        seen = changes.join(a, "a").join(b, "b")
        new_a, new_b = F.col("_fa") == F.col("seq"), F.col("_fb") == F.col("seq")
        event = F.when(new_a & new_b, "FORMED").when(new_a | new_b, "ADDED").otherwise("MERGED")
        seen = seen.withColumn("event", event).filter((F.col("a") != F.col("b")) | (F.col("event") == "FORMED"))
        new_member = F.when(F.col("event") == "ADDED", F.when(new_a, F.col("src")).otherwise(F.col("dst")))
        seen = seen.withColumn("new_member", new_member)
        groups.changes = materialise(seen.select("group_id", "event", "src", "dst", "new_member", *LINK_ORDER, "seq", "level", "a"), "events")
    return groups.changes


def merge_log(groups: Groups, stats: DataFrame, added: str = "ADDED") -> DataFrame:
    """The log of each group in link order, with shown values (URLs without their query).

    Steps are numbered in time order.  ``added='JOINED'`` names and orders the pair of an
    addition the way the map view does, with the known member first.
    """
    steps = number_rows(merge_events(groups).drop("seq", "level", "a"), LINK_ORDER, "step", within=["group_id"])
    shown = materialise(stats.select("node", strip_query(F.col("value"), F.col("type")).alias("shown")), "shown")
    named = (
        steps.join(shown.toDF("src", "a_value"), "src")
        .join(shown.toDF("dst", "b_value"), "dst")
        .withColumn("event", F.when(F.col("event") == "ADDED", F.lit(added)).otherwise(F.col("event")))
    )
    if added == "JOINED":
        swap = (F.col("event") == "JOINED") & (F.col("new_member") == F.col("src"))
        named = named.withColumn("_a", F.when(swap, F.col("b_value")).otherwise(F.col("a_value"))).withColumn(
            "b_value", F.when(swap, F.col("a_value")).otherwise(F.col("b_value"))
        ).drop("a_value").withColumnRenamed("_a", "a_value")
    return named.select("group_id", "step", "event", "src", "dst", "a_value", "b_value", "new_member", *LINK_ORDER)


def singleton_groups(routed: DataFrame, groups: Groups) -> DataFrame:
    """Nodes that never shared a line, numbered after the formed groups in name order."""
    alone = routed.filter("route = 'node'").select("node").distinct().join(groups.members, "node", "left_anti")
    numbered = number_rows(alone, ["node"], "group_id")
    return numbered.withColumn("group_id", F.col("group_id") + groups.count().scalar())


def technical_counts(routed: DataFrame) -> DataFrame:
    """``(node, filtered)``: filtered entries a node is given by its lines, once per occurrence.

    Counted per line as occurrences times filtered entries, without pairing them up.
    """
    filtered = routed.filter("route = 'filtered'").groupBy("line").agg(F.count(F.lit(1)).alias("_f"))
    seen = routed.filter("route = 'node'").groupBy("line", "node").agg(F.count(F.lit(1)).alias("_n"))
    return seen.join(filtered, "line").groupBy("node").agg(F.sum(F.col("_n") * F.col("_f")).alias("filtered"))


def technical_entries(routed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The filtered entries given to a selection of nodes (one node, or the members of a group).

    One row per entry; ``times`` is how often the selection occurs on its line.
    """
    lines = (
        routed.filter("route = 'node'").join(nodes.select("node"), "node", "left_semi")
        .groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    )
    return routed.filter("route = 'filtered'").join(lines, "line").select("line", "pos", "timestamp", "type", "value", "times")


def _first_last(order, readable):
    """First and last timestamp in input order, ``N/A`` unless one of them can be read."""
    known = F.bool_or(readable)
    return [
        F.when(known, F.min_by("timestamp", order)).otherwise("N/A").alias("first_seen"),
        F.when(known, F.max_by("timestamp", order)).otherwise("N/A").alias("last_seen"),
    ]


def node_stats(routed: DataFrame, year: int) -> DataFrame:
    """Per node: type and value of its first entry, entries, first and last seen."""
    order = F.struct("line", "pos")
    readable = parse_ts(F.col("timestamp"), year).isNotNull()
    return routed.filter("route = 'node'").groupBy("node").agg(
        F.min_by("type", order).alias("type"),
        F.min_by("value", order).alias("value"),
        F.count(F.lit(1)).alias("cnt"),
        *_first_last(order, readable),
    )


def group_entries(routed: DataFrame, groups: Groups) -> DataFrame:
    """The entries of each group's members."""
    nodes = routed.filter("route = 'node'").select("line", "pos", "timestamp", "type", "value", "node")
    return nodes.join(groups.members, "node")


def group_stats(routed: DataFrame, groups: Groups, year: int) -> DataFrame:
    """Per group: members, entries with the filtered ones, first and last timestamp by line."""
    order = F.struct("line", "pos")
    readable = parse_ts(F.col("timestamp"), year).isNotNull()
    seen = group_entries(routed, groups).groupBy("group_id").agg(F.count(F.lit(1)).alias("entries"), *_first_last(order, readable))
    members = (
        groups.members.join(technical_counts(routed), "node", "left")
        .groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("filtered"), F.lit(0)).alias("filtered"))
    )
    return members.join(seen, "group_id").select(
        "group_id", "members", (F.col("entries") + F.col("filtered")).alias("cnt"), "first_seen", "last_seen"
    )


def group_summary(routed: DataFrame, groups: Groups, year: int) -> DataFrame:
    """The group list: entries, distinct (value, type) nodes, first and last timestamp."""
    shown = node_stats(routed, year).select("node", "value", "type").join(groups.members, "node")
    nodes = shown.groupBy("group_id").agg(F.countDistinct("value", "type").alias("nodes"))
    return group_stats(routed, groups, year).join(nodes, "group_id").select("group_id", "cnt", "nodes", "first_seen", "last_seen")


def node_relationships(routed: DataFrame, groups: Groups, log: DataFrame) -> dict[str, DataFrame]:
    """Per group: distinct values of each line, last entry of each value, and the pairs of the log."""
    entries = group_entries(routed, groups)
    last = F.max_by(F.struct("line", "timestamp", "type"), F.struct("line", "pos")).alias("_e")
    return {
        "line_values": entries.select("group_id", "line", "value").distinct(),
        "last_entries": entries.groupBy("group_id", "value").agg(last).select("group_id", "value", "_e.*"),
        "pairs": log.select("group_id", "step", "a_value", "b_value", "event"),
    }


def exclusion_catalogue(
    routed: DataFrame, stoplist: DataFrame | None = None, special_types: Iterable[str] = SPECIAL_TYPES
) -> DataFrame:
    """Every value a user can switch off: stop list, filtered values next to a node, special types; sorted."""
    nodes = routed.filter("route = 'node'")
    beside = routed.filter("route = 'filtered'").join(nodes.select("line").distinct(), "line", "left_semi")
    values = beside.select("value").union(nodes.filter(F.col("type").isin(list(special_types))).select("value"))
    if stoplist is not None:
        values = values.union(stoplist.select("value"))
    return values.distinct().orderBy("value")
