"""Placing data: staged tables, and small inputs spread over the cluster.

A staged table cuts lineage, survives the loss of executors and, being
Parquet, lets each later pass read only the columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_OPTION = "spark.checkpoint.dir"
# Rows of a small table (a few numbers and digests each) that are worth a task.
TASK_ROWS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below the session's checkpoint folder.

    Only a local session without one gets a temporary folder of its own.
    """
    base = spark.conf.get(DIR_OPTION, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError(f"set {DIR_OPTION} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set(DIR_OPTION, base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    The table is needed for as long as the result is. A job that knows when it
    is done passes its own ``path`` and removes it; the rest lies in a folder
    named after the application and can go when the application has ended.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """The same rows from no more tasks than ``rows``, a bound on their number,
    are worth, and from one per core at least. For small tables that come out of
    a shuffle: each of its partitions is a task and a file otherwise, however
    few the rows. Partitions are joined, none is cut or moved."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a scan with fewer splits than the cluster has cores, hashed over
    all cores; larger scans are left as they are. For work that costs far more
    than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
