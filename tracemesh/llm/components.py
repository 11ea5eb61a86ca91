"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemesh.operators.order import join_counted
from tracemesh.session import discard, materialise


def component_labels(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; ``root`` is the smallest node that can be reached.

    Alternating stars: each node points its larger neighbours to the smallest neighbour, then its smaller ones
    too, until nothing changes, in a number of rounds that grows like a logarithm.  The smallest neighbour is
    found by an aggregate and brought back by a join that splits off the most frequent keys, so a hub
    with a third of all links stays spread out.  Each round is written to the shared folder, and the one before is deleted.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialise(links, "links")
    state = _fingerprint(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_smallest(both, "v > u", "large-star")
        discard(links)
        links = _towards_smallest(large, "v < u", "small-star")
        discard(large)
        before, state = state, _fingerprint(links)
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def _towards_smallest(pairs: DataFrame, which: str, name: str) -> DataFrame:
    """Link the neighbours ``which`` selects, and the node itself, to the smallest of node and neighbours; written as ``name``."""
    nodes = pairs.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = materialise(nodes.select("u", F.least("u", "least").alias("least"), F.col("n").alias("_n")), "smallest")
    moved = join_counted(pairs.filter(which), nodes, "u", "_n").select(F.col("v").alias("u"), F.col("least").alias("v"))
    own = nodes.select("u", F.col("least").alias("v"))
    found = materialise(moved.unionByName(own).filter("u <> v").distinct(), name)
    discard(nodes)
    return found


def _fingerprint(links: DataFrame) -> tuple:
    """Tells whether a round has changed the links: their number and a sum of their hashes."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
