"""Training-run analytics: best epoch, early stop, learning-rate schedule."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def track_best(
    history: DataFrame, by: Sequence[str], epoch: str, score: str, patience: int
) -> DataFrame:
    """Per epoch: ``improved`` (strictly above all before), ``best_epoch`` and
    ``best_score`` so far, ``stale`` (epochs in a row without improvement) and
    ``reached`` (false once training has stopped).

    A run has one row per epoch, so its window is as long as its training.
    """
    run = Window.partitionBy(*by).orderBy(epoch)
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    # Fixed value: the score to beat in the first epoch.
    start = F.lit(-1.0)
    # A null or NaN score is no improvement and never one to beat.
    value = F.when(~F.isnan(score), F.col(score))
    previous = F.greatest(F.coalesce(F.max(value).over(before), start), start)
    limit = max(patience, 1)
    return (
        history.withColumn("_step", F.row_number().over(run))
        .withColumn("improved", F.coalesce(value > previous, F.lit(False)))
        .withColumn("_gain", F.when(F.col("improved"), F.col("_step")))
        .withColumn("stale", F.col("_step") - F.coalesce(F.max("_gain").over(so_far), F.lit(0)))
        .withColumn(
            "best_epoch",
            F.coalesce(F.max(F.when(F.col("improved"), F.col(epoch))).over(so_far), F.lit(-1)),
        )
        .withColumn("best_score", F.greatest(F.max(value).over(so_far), start))
        .withColumn(
            "_stops", F.max((F.col("stale") >= limit).cast("int")).over(before)
        )
        .withColumn("reached", F.coalesce(F.col("_stops"), F.lit(0)) == 0)
        .drop("_step", "_gain", "_stops")
    )


def early_stop(
    history: DataFrame, by: Sequence[str], epoch: str, score: str, patience: int
) -> DataFrame:
    """Per run: ``best_epoch, best_score, last_epoch, stopped_early``."""
    tracked = track_best(history, by, epoch, score, patience).filter("reached")
    last = F.struct(epoch, "best_epoch", "best_score", "stale")
    return (
        tracked.groupBy(*by)
        .agg(F.max_by(last, F.col(epoch)).alias("last"))
        .select(
            *by,
            F.col("last.best_epoch").alias("best_epoch"),
            F.col("last.best_score").alias("best_score"),
            F.col(f"last.{epoch}").alias("last_epoch"),
            (F.col("last.stale") >= max(patience, 1)).alias("stopped_early"),
        )
    )


def optimizer_steps(rows: int, batch_size: int, accumulation: int, epochs: int) -> int:
    """Weight updates of a whole run; a last partial accumulation counts."""
    batches = math.ceil(rows / batch_size)
    return math.ceil(batches / max(1, accumulation)) * epochs


def warmup_schedule(
    spark: SparkSession, total_steps: int, warmup_ratio: float, base_rate: float
) -> DataFrame:
    """``step, rate``: linear from 0 up to the base rate, then down to 0."""
    warmup = int(total_steps * warmup_ratio)
    step = F.col("step")
    rising = step / F.lit(float(max(1, warmup)))
    falling = F.greatest(
        F.lit(0.0), (F.lit(total_steps) - step) / F.lit(float(max(1, total_steps - warmup)))
    )
    factor = F.when(step < warmup, rising).otherwise(falling)
    return spark.range(total_steps).select(F.col("id").alias("step")).select(
        "step", (factor * F.lit(float(base_rate))).alias("rate")
    )
