"""What is on disk: sizes of data folders and readiness of model folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of every file below; contents are not read."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return scan.select("path", "length")


def folder_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``folder, files, bytes`` per folder directly below ``root``. Downloads
    in progress (``.part``) do not count."""
    marker = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    below = F.substring_index(F.col("path"), marker, -1)
    return (
        _files(spark, root)
        .filter(~F.col("path").endswith(".part") & below.contains("/"))
        .groupBy(F.substring_index(below, "/", 1).alias("folder"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )


def model_folders(spark: SparkSession, root: str) -> DataFrame:
    """``folder, complete``: a model folder is complete with a config.json."""
    marker = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    below = F.substring_index(F.col("path"), marker, -1)
    return (
        _files(spark, root)
        .filter(below.contains("/"))
        .groupBy(F.substring_index(below, "/", 1).alias("folder"))
        .agg(F.max(below.rlike("^[^/]+/config\\.json$")).alias("complete"))
    )
