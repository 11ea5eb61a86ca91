"""How a group was formed, as a graph of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemesh.functions import strip_query
from tracemesh.operators.forest import highest_ancestor
from tracemesh.operators.order import previous_value
from tracemesh.operators.people import LINK_ORDER, Groups, merge_events
from tracemesh.session import materialise


def formation_steps(groups: Groups) -> DataFrame:
    """Every change of a group with ``seq``, the number of its link, and ``parent``, the next change of the same group.

    The steps of one group form a tree that can be as deep as the group is large, so it is
    not replayed.  A component of a contraction round is left by its first link to the outside, so what happens inside it
    before that link comes later than the links of its parts is one chain of steps, and that link follows the last of them.  A step
    belongs to the first component on its way up that is left after it, so it rises once a round and is never searched for.
    """
    steps = merge_events(groups)
    # First link leaving each component, by number.
    rounds = [r.select("c", "parent", F.col("pick").alias("leave")) for r in groups.forest.rounds]
    base = len(rounds) + 1

    def chained(df: DataFrame, number: int, top: Column) -> DataFrame:
        return df.select("seq", (F.col("c") * base + number).alias("chain"), top.alias("top"))

    rising, placed = steps.filter("level is not null").select("seq", "level", F.col("a").alias("c")), []
    for number, r in enumerate(rounds):
        # A component that is not in the round has no link to the outside: its group is whole.
        stays = F.coalesce((F.col("level") < number) & (F.col("seq") < F.col("leave")), F.col("parent").isNull())
        risen = materialise(rising.join(r, "c", "left").withColumn("stays", stays), "rise")
        placed.append(chained(risen.filter("stays"), number, F.col("leave")))
        rising = risen.filter("not stays").select("seq", "level", F.col("parent").alias("c"))
    chains = chained(rising, len(rounds), F.lit(None).cast("bigint"))
    for part in placed:
        chains = chains.unionByName(part)
    # Counted back, the row before is the next one.
    chains = materialise(chains.withColumn("back", -F.col("seq")), "chains")
    parents = previous_value(chains, "chain", "back", F.col("seq"), "next").select("seq", F.coalesce("next", "top").alias("parent"))
    if rounds:
        # A self link comes before every other link of its node.
        selfs = steps.filter("level is null").select("seq", F.col("a").alias("c")).join(rounds[0].select("c", "leave"), "c", "left")
        parents = parents.unionByName(selfs.select("seq", F.col("leave").alias("parent")))
    return steps.drop("level", "a").join(parents, "seq", "left")


def formation_graph(groups: Groups, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step nodes ``(group_id, step, event, a_value, b_value, new_member)`` and the edges between them.

    An edge leads from a step to the next step of the same group, labelled with the pair
    that made the next step; a merge has two incoming edges.
    """
    steps = formation_steps(groups).select("seq", "parent", *LINK_ORDER, "group_id")
    numbered = materialise(log.join(steps, ["group_id", *LINK_ORDER]), "formation")
    after = numbered.select(
        F.col("seq").alias("parent"), F.col("step").alias("to_step"), F.col("a_value").alias("via_a"), F.col("b_value").alias("via_b")
    )
    edges = numbered.select("group_id", F.col("step").alias("from_step"), "parent").join(after, "parent")
    nodes = numbered.select("group_id", "step", "event", "a_value", "b_value", "new_member", "line", "seq", "parent")
    return nodes, edges.select("group_id", "from_step", "to_step", "via_a", "via_b")


def step_members(groups: Groups, steps: DataFrame, seq: int) -> DataFrame:
    """The nodes that are in the group right after step ``seq``: those whose first step leads up to it."""
    target = F.broadcast(materialise(steps.filter(F.col("seq") == seq).select("group_id"), "target"))
    steps = materialise(steps.join(target, "group_id", "left_semi").select("seq", "parent", "src", "dst"), "steps-of-group")
    ends = steps.select("seq", F.explode(F.array("src", "dst")).alias("node"))
    first = ends.groupBy("node").agg(F.min("seq").alias("at"))
    found = highest_ancestor(steps.select("seq", "parent"), first.withColumn("below", F.lit(seq + 1)))
    return found.filter(F.col("ancestor") == seq).select("node")


def step_entries(entries: DataFrame, members: DataFrame) -> DataFrame:
    """The first entry of each distinct value (URLs without query) among a step's members."""
    shown = strip_query(F.col("value")).alias("shown")
    kept = entries.join(materialise(members.select("node"), "step-members"), "node", "left_semi")
    first = F.min(F.struct("line", "pos", "timestamp", "type", "value")).alias("_e")
    return kept.groupBy(shown).agg(first).select("shown", "_e.*")


def tuple_provenance(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Where both values of a pair ``(group_id, a_value, b_value)`` come from, two rows per pair.

    The first line with both values counts; otherwise each value's own first entry.  The
    lines of the rarer value are looked up, never those of the more frequent one, so a
    value on a third of all lines costs nothing extra.
    """
    values = entries.withColumn("value", strip_query(F.col("value")))
    on_line = values.groupBy("group_id", "value", "line").agg(F.min(F.struct("pos", "timestamp", "type")).alias("e"))
    on_line = materialise(on_line, "value-lines")
    counts = on_line.groupBy("group_id", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("line", "e")).alias("first")
    )
    keyed = pairs.select("group_id", "a_value", "b_value").distinct()
    keyed = keyed.withColumn("ka", strip_query(F.col("a_value"))).withColumn("kb", strip_query(F.col("b_value")))
    a = counts.select("group_id", F.col("value").alias("ka"), F.col("n").alias("na"), F.col("first").alias("fa"))
    b = counts.select("group_id", F.col("value").alias("kb"), F.col("n").alias("nb"), F.col("first").alias("fb"))
    sized = keyed.join(a, ["group_id", "ka"], "left").join(b, ["group_id", "kb"], "left")
    a_rarer = F.coalesce("na", F.lit(0)) <= F.coalesce("nb", F.lit(0))
    sized = sized.withColumn("rare", F.when(a_rarer, F.col("ka")).otherwise(F.col("kb"))).withColumn(
        "other", F.when(a_rarer, F.col("kb")).otherwise(F.col("ka"))
    )
    sized = materialise(sized, "pairs")
    lines = sized.join(on_line.select("group_id", F.col("value").alias("rare"), "line", F.col("e").alias("re")), ["group_id", "rare"])
    both = lines.join(on_line.select("group_id", F.col("value").alias("other"), "line", F.col("e").alias("oe")), ["group_id", "other", "line"])
    shared = both.groupBy("group_id", "a_value", "b_value").agg(F.min(F.struct("line", "re", "oe")).alias("s"))
    found = sized.join(shared, ["group_id", "a_value", "b_value"], "left")

    def row(value: str, key: str, first: str):
        entry = F.when(F.col("rare") == F.col(key), F.col("s.re")).otherwise(F.col("s.oe"))
        together = F.col("s").isNotNull()
        same_first = F.col("fa.line") == F.col("fb.line")
        return F.struct(
            F.col(value).alias("value"),
            F.when(together, F.col("s.line")).otherwise(F.col(f"{first}.line")).alias("line"),
            F.coalesce(F.when(together, entry["timestamp"]).otherwise(F.col(f"{first}.e.timestamp")), F.lit("N/A")).alias("timestamp"),
            F.coalesce(F.when(together, entry["type"]).otherwise(F.col(f"{first}.e.type")), F.lit("")).alias("type"),
            F.when(together, F.col("s.line")).otherwise(F.when(same_first, F.col("fa.line"))).alias("tuple_line"),
        )

    rows = F.array(row("a_value", "ka", "fa"), row("b_value", "kb", "fb"))
    return found.select("group_id", "a_value", "b_value", F.posexplode(rows).alias("side", "r")).select(
        "group_id", "a_value", "b_value", "side", "r.*"
    )
