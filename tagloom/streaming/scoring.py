"""Batch scoring chunk by chunk: new input files are scored as they arrive.

Same readers, scorer and output as the batch job; Structured Streaming keeps
track of the chunks done, so a job that is stopped goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom import schemas
from tagloom.plans.model import ScoreRows
from tagloom.plans.predict import Predictor, prediction_lines


def score_new_files(
    spark: SparkSession,
    predictor: Predictor,
    score: ScoreRows,
    in_dir: str,
    out_dir: str,
    state_dir: str,
    files_per_chunk: int = 1000,
) -> StreamingQuery:
    """Start scoring everything in ``in_dir`` not scored yet, then stop."""
    rows = (
        spark.readStream.schema(schemas.LABELLED_INPUT)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_chunk)
        .json(in_dir)
        .withColumn("code", F.coalesce("code", F.lit("")))
    )
    lines = prediction_lines(predictor.shape(score(predictor.prepare(rows))))
    return (
        lines.writeStream.format("text")
        .option("path", out_dir)
        .option("checkpointLocation", state_dir)
        .trigger(availableNow=True)
        .start()
    )
