"""Session set-up and the shared folder that iterative jobs write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(name: str = "tracemesh", master: str | None = None, **options: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win if already present."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; only a local session is given a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracemesh-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the next join true sizes to plan with.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tracemesh/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialise` that no plan reads any more, such as those of an earlier round."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            table._written_to = None


def spread(df: DataFrame, key: str | Sequence[str], most: int | None = None) -> DataFrame:
    """Redistribute by a unique ``key``, if the scan has fewer tasks than there are cores, or a task of it more than ``most`` rows.

    A file is cut by its size, but a row group is read by one task, so most tasks of a scan may be empty; rows are counted (from the
    footers of the files) where ``most`` is given, and a large table gets a task for every so many rows.  Any other scan of
    more tasks than cores is left as it is, so that no text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    keys = [key] if isinstance(key, str) else key
    tasks = cores if df.rdd.getNumPartitions() < cores else 0
    if most is not None:
        sizes = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
        rows, longest = sizes.agg(F.sum("n"), F.max("n")).first()
        if longest and (tasks or longest > most):
            tasks = max(cores, -(-rows // most))
    return df.repartition(tasks, *keys) if tasks else df
