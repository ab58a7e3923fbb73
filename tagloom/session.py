"""Session options the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Source texts can reach tens of MB each, so keep batches of them short.
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(app_name: str = "tagloom", **extra: str) -> SparkSession:
    """Get or create a session; ``master`` and sizing come from the submitter."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**OPTIONS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
