"""Single JSON and text documents on any Hadoop file system."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom import schemas


def _file(spark: SparkSession, path: str):
    """The file system and path objects Spark itself would use."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder the caller made; a missing one is fine."""
    system, target = _file(spark, path)
    system.delete(target, True)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    system, target = _file(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(content, "utf-8"))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, content: Any) -> None:
    write_text(spark, path, json.dumps(content, ensure_ascii=False, indent=2))


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"] if rows else ""


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


def label_map(task: str, names: list[str], codes: dict[str, int] | None = None) -> dict[str, Any]:
    """A label dictionary document. ``codes`` (name -> id) lists the classes
    that can be encoded; it has no entry for OTHER."""
    content: dict[str, Any] = {
        "task": task,
        "num_labels": len(names),
        "id2name": {str(i): n for i, n in enumerate(names)},
    }
    if codes is not None:
        content["name2id"] = codes
    return content


def names_by_id(content: dict[str, Any]) -> list[str]:
    """Class names in id order; ids without a name print as the id."""
    known = {int(i): n for i, n in content.get("id2name", {}).items()}
    count = max([int(content.get("num_labels", 0)), *[i + 1 for i in known]])
    return [known.get(i, str(i)) for i in range(count)]


def dictionary(spark: SparkSession, names: list[str]) -> DataFrame:
    """``id, name``."""
    return spark.createDataFrame(list(enumerate(names)), "id int, name string")


def read_runs(
    spark: SparkSession, path: str, metrics: T.StructType = schemas.BINARY_METRICS
) -> DataFrame:
    """Result documents of training runs, with the ``run`` folder's name."""
    schema = schemas.run_results(metrics)
    runs = spark.read.schema(schema).option("multiLine", True).json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return runs.select(folder.alias("run"), *schema.names)


def run_history(runs: DataFrame) -> DataFrame:
    """One row per run and epoch, metrics as columns."""
    return runs.select("run", F.explode("history").alias("h")).select(
        "run", "h.epoch", "h.train_loss", "h.val.*"
    )


def run_scores(runs: DataFrame) -> DataFrame:
    """Final metrics in long form: one row per run and split."""
    halves = [
        runs.select("run", F.lit(split).alias("split"), f"{split}.*") for split in ("val", "test")
    ]
    return halves[0].unionByName(halves[1])
