"""Parquet shards with a stable row order, and the registry of raw sources."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom import schemas
from tagloom.operators.corpus import fan_out_pairs

log = logging.getLogger(__name__)

# `ord` = file number * 2**ROW_BITS + row number within the file.
ROW_BITS = 38
# The file list is broadcast up to this many files (about 30 MB of paths).
BROADCAST_FILES = 200_000


def _plain_path(path: Column) -> Column:
    """Local paths are printed with one slash or three, depending on the API."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_shards(
    spark: SparkSession, pattern: str, schema: T.StructType, columns: list[str] | None = None
) -> DataFrame:
    """The listed columns of all files that match, and ``ord``: files in name
    order, rows in file order. No match gives an empty result and a warning.
    """
    columns = columns or schema.names
    try:
        scan = spark.read.schema(schema).parquet(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no files match %s", pattern)
        picked = T.StructType([schema[c] for c in columns])
        return spark.createDataFrame([], picked).withColumn("ord", F.lit(0).cast("long"))
    paths = sorted(scan.inputFiles())
    rows = scan.select(
        *columns,
        _plain_path(F.col("_metadata.file_path")).alias("_path"),
        F.col("_metadata.row_index").alias("_row"),
    )
    numbers = spark.createDataFrame(
        list(enumerate(paths)), "_file long, _path string"
    ).withColumn("_path", _plain_path(F.col("_path")))
    if len(paths) <= BROADCAST_FILES:
        numbers = F.broadcast(numbers)
    order = F.shiftleft("_file", ROW_BITS) + F.col("_row")
    return rows.join(numbers, "_path").select(*columns, order.alias("ord"))


Source = Callable[[SparkSession, str, Mapping[str, Any]], DataFrame]
SOURCES: dict[str, Source] = {}


def register_source(name: str) -> Callable[[Source], Source]:
    """Make a function ``(spark, raw_dir, settings) -> samples`` a source."""

    def add(source: Source) -> Source:
        SOURCES[name] = source
        return source

    return add


def source(name: str) -> Source:
    try:
        return SOURCES[name]
    except KeyError:
        raise ValueError(f"unknown source {name!r}, choose one of {sorted(SOURCES)}") from None


@register_source("cvefixes")
def fix_commits(spark: SparkSession, raw_dir: str, settings: Mapping[str, Any]) -> DataFrame:
    """Fix commits: each yields the flawed and the repaired version."""
    raw = read_shards(spark, f"{raw_dir.rstrip('/')}/cvefixes/train-*.parquet", schemas.RAW_FIX)
    return fan_out_pairs(raw, "cvefixes")
