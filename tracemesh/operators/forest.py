"""Connected components and the minimum spanning forest, by contraction.

Every component picks its first edge, the picked edges are contracted, and the
remaining edges go to the next round.  The number of components at least halves
each round.  All steps are joins on a key that is unique on one side, or
aggregations that Spark combines before the shuffle, so a hub with a third of all
edges is no problem; every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemesh.operators.order import number_rows
from tracemesh.session import discard, materialise


@dataclass
class Forest:
    """``labels(node, root)`` and ``edges(src, dst, <order>, seq, a, b, level)``.

    Inside, nodes and edges are numbers: ``nodes(node, c, r, first)`` gives each node its number, that of its root and that of the
    first edge that touches it; ``links(src, dst, <order>, seq, a, b)`` numbers all edges by ``order`` and names their ends.
    ``rounds[i]`` maps the number of each component alive in round ``i`` to its component afterwards,
    ``(c, parent, pick)``, where ``pick`` is the first edge leaving it.
    """

    labels: DataFrame
    edges: DataFrame
    rounds: list[DataFrame] = field(default_factory=list)
    nodes: DataFrame | None = None
    links: DataFrame | None = None


def to_roots(hooks: DataFrame) -> DataFrame:
    """Follow ``c -> parent`` pointers to the end by repeatedly doubling their reach; a written ``hooks`` is used up."""
    before = hooks
    while True:
        up = hooks.select(F.col("c").alias("parent"), F.col("parent").alias("_next"))
        moved = hooks.join(up, "parent", "left").withColumn("_next", F.coalesce("_next", "parent"))
        moved = materialise(
            moved.withColumn("_moved", F.col("_next") != F.col("parent")).drop("parent").withColumnRenamed("_next", "parent"),
            "pointers",
        )
        discard(before)
        before = moved
        hooks = moved.drop("_moved").select("c", "parent", *[n for n in moved.columns if n not in ("c", "parent", "_moved")])
        if moved.filter("_moved").isEmpty():
            return hooks


def spanning_forest(edges: DataFrame, order: Sequence[str]) -> Forest:
    """Minimum spanning forest of ``(src, dst, <order>)``; ``order`` must tell any two edges apart.

    Self edges only register their node.
    """
    order = list(order)
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    names = materialise(names.withColumn("c", F.monotonically_increasing_id()), "nodes")
    links = number_rows(edges.select("src", "dst", *order), [*order, "src", "dst"], "seq")
    links = links.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    links = materialise(links.select("src", "dst", *order, "seq", "a", "b"), "numbered")

    def lightest(df: DataFrame) -> DataFrame:
        """Join parallel edges into the first of them."""
        ends = df.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "seq")
        return materialise(ends.groupBy("a", "b").agg(F.min("seq").alias("seq")), "edges")

    alive = lightest(links)
    rounds, picked = [], []
    while not alive.isEmpty():
        both_ways = F.explode(
            F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))
        )
        picks = alive.select("seq", both_ways.alias("e")).groupBy("e.c").agg(F.min("seq").alias("pick"), F.min_by("e.o", "seq").alias("parent"))
        # An edge picked from both ends would make a cycle; its smaller end becomes the root.
        ends = picks.groupBy("pick").agg(
            F.min("c").alias("low"), F.count(F.lit(1)).alias("n"), F.max("c").alias("c"), F.max_by("parent", "c").alias("parent")
        )
        root, high = F.struct(F.col("low").alias("c"), F.col("low").alias("parent")), F.struct("c", "parent")
        hooks = ends.select("pick", F.explode(F.when(F.col("n") == 2, F.array(root, high)).otherwise(F.array(high))).alias("h"))
        hooks = to_roots(materialise(hooks.select("h.c", "h.parent", "pick"), "hooks"))
        picked.append(hooks.select(F.col("pick").alias("seq")).distinct().withColumn("level", F.lit(len(rounds))))
        rounds.append(hooks)
        target = hooks.select("c", "parent")
        before = alive
        alive = lightest(
            alive.join(target.toDF("a", "_a"), "a").join(target.toDF("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "seq")
        )
        discard(before)
    root = names.select("c", F.col("c").alias("r")).limit(0)
    for number, hooks in enumerate(reversed(rounds)):  # from the few components of the last round down to the nodes
        moved = hooks.select("c", F.col("parent").alias("_p"))
        root = moved.join(root.toDF("_p", "r"), "_p", "left").select("c", F.coalesce("r", "_p").alias("r")) if number else moved.toDF("c", "r")
    first = links.select("seq", F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.min("seq").alias("first"))
    nodes = materialise(names.join(first, "c").join(root, "c", "left").select("node", "c", F.coalesce("r", "c").alias("r"), "first"), "labels")
    labels = nodes.join(nodes.filter("c = r").select("r", F.col("node").alias("root")), "r").select("node", "root")
    chosen = links.select("seq").limit(0).withColumn("level", F.lit(0))
    for level in picked:
        chosen = chosen.unionByName(level)
    return Forest(labels, materialise(links.join(chosen, "seq"), "forest"), rounds, nodes, links)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(src, dst)``: the labels of the forest without its edges.

    Each component points to its smallest neighbour.  Pointers cannot run in a circle but between two components that point at
    each other, so the number of components at least halves each round, and nothing but node numbers is compared.
    Self edges only register their node.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()

    def pairs(df: DataFrame) -> DataFrame:
        ends = df.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return materialise(ends.distinct(), "edges")

    alive = pairs(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    rounds = []
    while not alive.isEmpty():
        both_ways = F.explode(
            F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))
        )
        picks = alive.select(both_ways.alias("e")).groupBy("e.c").agg(F.min("e.o").alias("o"))
        # Of two that point at each other, the smaller becomes the root.
        ends = picks.groupBy(F.least("c", "o").alias("low"), F.greatest("c", "o").alias("high")).agg(F.max("c").alias("c"), F.count(F.lit(1)).alias("n"))
        low, high = F.struct(F.col("low").alias("c"), "low"), F.struct(F.col("high").alias("c"), "low")
        other = F.when(F.col("c") == F.col("low"), F.col("high")).otherwise(F.col("low"))
        one = F.struct("c", other.alias("low"))
        hooks = ends.select(F.explode(F.when(F.col("n") == 2, F.array(low, high)).otherwise(F.array(one))).alias("h"))
        hooks = to_roots(materialise(hooks.select("h.c", F.col("h.low").alias("parent")), "hooks"))
        rounds.append(hooks)
        before = alive
        alive = pairs(alive.join(hooks.toDF("a", "_a"), "a").join(hooks.toDF("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        discard(before)
    labels = nodes.withColumn("root", F.col("node"))
    for hooks in rounds:
        labels = labels.join(hooks.toDF("root", "_root"), "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return materialise(labels, "labels")


def highest_ancestor(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """For each start ``(at, below, ...)`` the highest ancestor of ``at`` with a number less than ``below``.

    ``parents(seq, parent)`` must lead to larger numbers.  A start that is itself not
    less than ``below`` gets null.  Jump tables of doubling length keep the number of
    joins logarithmic in the depth.
    """
    jumps = [parents.filter("parent is not null").select("seq", F.col("parent").alias("_up"))]
    while True:
        last = jumps[-1]
        longer = materialise(
            last.join(last.select(F.col("seq").alias("_up"), F.col("_up").alias("_far")), "_up").select(
                "seq", F.col("_far").alias("_up")
            ),
            "jumps",
        )
        if longer.isEmpty():
            break
        jumps.append(longer)
    found = starts.withColumn("_at", F.when(F.col("at") < F.col("below"), F.col("at")))
    for jump in reversed(jumps):
        step = jump.withColumnRenamed("seq", "_at")
        found = found.join(step, "_at", "left").withColumn(
            "_at", F.when(F.col("_up") < F.col("below"), F.col("_up")).otherwise(F.col("_at"))
        )
        found = found.drop("_up")
    return found.withColumnRenamed("_at", "ancestor")
