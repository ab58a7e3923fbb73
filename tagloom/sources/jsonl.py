"""JSON Lines in and out. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom import schemas
from tagloom.operators.corpus import labelled_only


def read_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are left out; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_labelled(
    spark: SparkSession, path: str, schema: T.StructType = schemas.LABELLED_INPUT
) -> DataFrame:
    """Rows with a label, their text never null. A label of JSON null counts
    as missing, as Spark does not tell the two apart."""
    return labelled_only(read_strict(spark, path, schema))


def read_records(
    spark: SparkSession, path: str, schema: T.StructType = schemas.LABELLED_INPUT
) -> DataFrame:
    """Batch-scoring input: id and label optional, text never null."""
    rows = read_strict(spark, path, schema)
    return rows.withColumn("code", F.coalesce("code", F.lit("")))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, code``: one row per file. Undecodable bytes are dropped, and
    with them any replacement characters the text itself contains."""
    files = spark.read.text(path, wholetext=True)
    valid = F.make_valid_utf8("value")
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.replace(valid, F.lit("\ufffd"), F.lit("")).alias("code"),
    )


def literal(spark: SparkSession, code: str) -> DataFrame:
    """A one-row input from a string."""
    return spark.createDataFrame([(code,)], "code string")


def write_jsonl(df: DataFrame, path: str, *partitions: str) -> int:
    """Write, replacing what is there, and return the number of rows.

    Null fields are written, text stays as it is. The count comes from the
    write itself, not from a second pass.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = counted.write.mode("overwrite").option("ignoreNullFields", "false")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.json(path)
    return seen.get["n"]
