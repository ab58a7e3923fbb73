"""Threshold sweeps: all metrics at every threshold from one pass.

A row belongs to the bucket "how many thresholds are not above its score".
Bucket counts are a tiny table, and sums over its buckets from a threshold up
give the counts there, so a sweep costs one scan whatever the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import rates

# The short grid for tables, and start, stop and step of the
# fine grid used to pick a threshold.
TABLE_GRID = [0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10]
FINE_START, FINE_STOP, FINE_STEP = 0.01, 1.0, 0.005
# A threshold transfers well if recall moves by no more than this.
TRANSFER_TOLERANCE = 0.03


def fine_grid() -> list[float]:
    """0.01, 0.015, ... below 1, with the rounding of a float range: the step
    is the difference of the first two values."""
    count = round((FINE_STOP - FINE_START) / FINE_STEP)
    step = (FINE_START + FINE_STEP) - FINE_START
    return [FINE_START + i * step for i in range(count)]


def sweep(
    df: DataFrame,
    truth: str,
    score: str,
    grid: Sequence[float] = tuple(TABLE_GRID),
    by: Sequence[str] = (),
) -> DataFrame:
    """``by, threshold, precision, recall, f1, accuracy, tn, fp, fn, tp`` for
    each threshold; a score equal to a threshold counts as positive. Rows
    without a score or a truth do not count."""
    steps = sorted(set(float(t) for t in grid))
    inf = float("inf")
    place = Bucketizer(
        splits=[-inf, *steps, inf], inputCol="_score", outputCol="_step", handleInvalid="keep"
    )
    y = F.col(truth).cast("int")
    rows = df.select(
        *by,
        F.nanvl(F.col(score).cast("double"), F.lit(-inf)).alias("_score"),
        y.alias("_y"),
    ).filter(F.col("_score").isNotNull() & F.col("_y").isNotNull())
    counts = (
        place.transform(rows)
        .groupBy(*by, F.col("_step").cast("int").alias("step"))
        .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    )
    # At most len(grid) + 1 cells per `by` value, so they fit one row.
    cells = counts.groupBy(*by).agg(F.collect_list(F.struct("step", "pos", "neg")).alias("cells"))
    spread = cells.select(*by, "cells", F.explode(F.sequence(F.lit(1), F.lit(len(steps)))).alias("step"))

    def summed(part: Column, field: str) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, c: acc + c[field])

    above = F.filter("cells", lambda c: c["step"] >= F.col("step"))
    below = F.filter("cells", lambda c: c["step"] < F.col("step"))
    thresholds = F.expr("array(" + ", ".join(f"{t!r}D" for t in steps) + ")")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        spread.select(
            *by,
            F.get(thresholds, F.col("step") - 1).alias("threshold"),
            summed(above, "pos").alias("tp"),
            summed(above, "neg").alias("fp"),
            summed(below, "pos").alias("fn"),
            summed(below, "neg").alias("tn"),
        )
        .withColumns({"precision": rates.precision(tp, fp), "recall": rates.recall(tp, fn)})
        .select(
            *by,
            "threshold",
            "precision",
            "recall",
            rates.harmonic_mean(F.col("precision"), F.col("recall")).alias("f1"),
            rates.accuracy(tp, fp, fn, tn).alias("accuracy"),
            "tn",
            "fp",
            "fn",
            "tp",
        )
    )


def best_for_recall(swept: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Of the thresholds that reach the target recall, the one with the best
    precision; the lowest threshold wins ties; no row if none reaches it."""
    names = [c for c in swept.columns if c not in by]
    preference = F.struct("precision", (-F.col("threshold")).alias("_low"))
    best = (
        swept.filter(F.col("recall") >= target)
        .groupBy(*by)
        .agg(F.max_by(F.struct(*names), preference).alias("best"))
        .filter(F.col("best").isNotNull())
    )
    return best.select(*by, "best.*")


def transfer(
    swept: DataFrame, target: float, split: str, tune_on: str, check_on: str
) -> DataFrame:
    """The best threshold of one split, and how it does on another.

    ``swept`` covers both splits: their values at the same threshold are put
    side by side, so nothing is computed for the check but a lookup.
    """
    fields = ["recall", "precision", "f1", "fn", "fp"]

    tuned, checked = "tuned", "checked"
    sides = swept.filter(F.col(split).isin(tune_on, check_on)).groupBy("threshold").agg(
        F.max(F.when(F.col(split) == tune_on, F.struct(*fields))).alias(tuned),
        F.max(F.when(F.col(split) == check_on, F.struct(*fields))).alias(checked),
    )
    flat = sides.filter(F.col(tuned).isNotNull()).select(
        "threshold",
        *[F.col(f"{tuned}.{c}").alias(c) for c in fields],
        *[F.col(f"{checked}.{c}").alias(f"check_{c}") for c in fields],
    )
    gap = F.abs(F.col("check_recall") - F.col("recall"))
    return best_for_recall(flat, target).withColumns(
        {"recall_gap": gap, "transfers": gap <= TRANSFER_TOLERANCE}
    )
