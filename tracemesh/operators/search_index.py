"""A kept search index: groups are found once, and a search reads the parts of the tables that its term can be in.

The index is a folder of Parquet tables.  ``grams`` lists for each character trigram the values that hold it, in buckets of a
hash of the trigram; ``entries`` are in parts by a hash of their value; ``lines`` (the nodes of each line) and ``nodes`` (with
their groups) are in parts by line and by node.  A value stands for itself by a 64-bit hash of its lower-case form; two values
with one hash are told apart when the entries are verified against the term.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh.operators.people import Groups
from tracemesh.operators.search import Term, search
from tracemesh.session import materialise

GRAM = 3
BUCKETS = 256
PARTS = 64
#: Tasks that write one bucket or part, so that a frequent trigram, value or node is not one task.
WRITERS = 4
#: Trigrams, the rarest ones first, whose lists are intersected; entries are verified in any case.
INTERSECTED = 4


def _value_id(value: Column) -> Column:
    return F.xxhash64(F.lower(value))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _gram_bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def _keep(df: DataFrame, path: str, part: str, order: list[str]) -> None:
    salt = F.pmod(F.xxhash64(*order), F.lit(WRITERS))
    df.repartition(part, salt).sortWithinPartitions(part, *order).write.mode("errorifexists").partitionBy(part).parquet(path)


@dataclass
class SearchIndex:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def search(self, term: str) -> DataFrame:
        """What :func:`tracemesh.operators.search.search` returns for the tables that were indexed.

        Terms whose text has fewer than three characters, and times without a text, scan the kept tables; they still
        find no groups anew.
        """
        wanted = Term.read(term)
        entries, lines, nodes = self.table("entries"), self.table("lines"), self.table("nodes")
        if wanted.text is not None and len(wanted.text) >= GRAM:
            entries = self.matching_entries(wanted.text)
            on_lines = entries.filter("route = 'filtered'").select("line").distinct()
            lines = self._pruned(lines, on_lines, "line")
            named = entries.select("node").union(lines.select("node")).filter("node is not null").distinct()
            nodes = self._pruned(nodes, named, "node")
            beside = [F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in ("pos", "timestamp", "type", "value")]
            entries = entries.unionByName(lines.select("line", "node", F.lit("node").alias("route"), *beside))
        stats = nodes.select("node", "type", "value")
        members = nodes.filter("group_id is not null").select("node", "group_id")
        sizes = nodes.filter("group_id is not null").select("group_id", F.col("group_size").alias("_size")).distinct()
        return search(entries, stats, Groups(members, None, None), term, sizes)

    def candidates(self, text: str) -> DataFrame:
        """``(value_id, part)`` of the values that hold the rarest trigrams of ``text``, which has three characters or more."""
        grams = grams_of(text)
        listed = self.table("grams").filter(F.col("bucket").isin(sorted({_gram_bucket(g) for g in grams})) & F.col("gram").isin(grams))
        counts = {r["gram"]: r["count"] for r in listed.groupBy("gram").count().collect()}  # a row per trigram of the term
        rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:INTERSECTED]
        of = lambda g: self.table("grams").filter((F.col("bucket") == _gram_bucket(g)) & (F.col("gram") == g)).select("value_id")
        found = of(rarest[0])
        for gram in rarest[1:]:
            found = found.join(of(gram), "value_id", "left_semi")
        return found.select("value_id", F.pmod("value_id", F.lit(PARTS)).cast("int").alias("part"))

    def matching_entries(self, text: str) -> DataFrame:
        """The entries whose value holds ``text``, from the parts that its candidates are in."""
        found = materialise(self.candidates(text), "candidates")
        parts = [r["part"] for r in found.select("part").distinct().collect()]  # at most PARTS
        entries = self.table("entries").filter(F.col("part").isin(parts)).join(found.select("value_id"), "value_id", "left_semi")
        entries = entries.filter(F.lower("value").contains(text))
        return materialise(entries.select("line", "pos", "timestamp", "type", "value", "route", "node"), "matching")

    @staticmethod
    def _pruned(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        """The rows of ``table`` with one of ``keys``, from the parts that these are in."""
        keys = materialise(keys.select(key, _part(F.col(key), PARTS).alias("part")), "keys")
        parts = [r["part"] for r in keys.select("part").distinct().collect()]  # at most PARTS
        return table.filter(F.col("part").isin(parts)).join(keys.select(key), key, "left_semi").drop("part")


def build_index(routed: DataFrame, stats: DataFrame, groups: Groups, folder: str) -> SearchIndex:
    """Write the index of routed entries, node statistics and groups to a new folder."""
    entries = routed.select("line", "pos", "timestamp", "type", "value", "route", "node").withColumn("value_id", _value_id(F.col("value")))
    entries = entries.withColumn("part", F.pmod("value_id", F.lit(PARTS)).cast("int"))
    _keep(entries, f"{folder}/entries", "part", ["value_id", "line", "pos"])

    values = routed.select(F.lower("value").alias("v")).distinct().filter(F.length("v") >= GRAM)
    grams = values.select(_value_id(F.col("v")).alias("value_id"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("v") - GRAM + 1), lambda i: F.substring("v", i, F.lit(GRAM))))).alias("gram"))
    bucket = F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(BUCKETS)).cast("int")
    _keep(grams.distinct().withColumn("bucket", bucket), f"{folder}/grams", "bucket", ["gram", "value_id"])

    lines = routed.filter("route = 'node'").select("line", "node").distinct()
    _keep(lines.withColumn("part", _part(F.col("line"), PARTS)), f"{folder}/lines", "part", ["line", "node"])

    sizes = groups.members.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    nodes = stats.select("node", "type", "value").join(groups.members.join(sizes, "group_id"), "node", "left")
    _keep(nodes.withColumn("part", _part(F.col("node"), PARTS)), f"{folder}/nodes", "part", ["node"])
    return SearchIndex(routed.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> SearchIndex:
    """An index that :func:`build_index` wrote, in this session or an earlier one."""
    return SearchIndex(spark, folder)
