"""Two-class evaluation: confusion counts, rates, ROC-AUC, average precision.

Input rows are (truth 0/1, score). Everything starts from one aggregate, the
counts per distinct score, which merges ties and is the only shuffle whose
size depends on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import rates
from tagloom.operators.staging import stage

# Bounds of the number of score ranges. Any ranges give exact results; being
# quantiles only makes them equally full.
FEWEST_RANGES, MOST_RANGES = 32, 1024


def at_least(score: Column, threshold: Column) -> Column:
    """``score >= threshold`` with NaN below everything (Spark sorts it above)."""
    return (score >= threshold) & ~F.isnan(score)


def verdict(score: Column, threshold: Column) -> Column:
    return at_least(score, threshold).cast("int")


def score_counts(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, score, pos, neg``: positives and negatives per distinct score.

    A NaN score counts as below all others; rows without a score or a truth do
    not count. Values of ``by`` are not null.
    """
    value = F.nanvl(F.col(score).cast("double"), F.lit(float("-inf")))
    y = F.col("_y")
    return (
        df.select(*by, value.alias("score"), F.col(truth).cast("int").alias("_y"))
        .filter(F.col("score").isNotNull() & y.isNotNull())
        .groupBy(*by, "score")
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )


def _score_ranges(counts: DataFrame) -> Bucketizer:
    """Score ranges cut at approximate quantiles, a bounded array. There are
    twice as many ranges as the session has shuffle partitions."""
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(FEWEST_RANGES, min(MOST_RANGES, 2 * partitions))
    steps = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    sketch = F.percentile_approx("score", F.expr(f"array({steps})"), F.lit(4 * ranges))
    values = counts.agg(sketch.alias("q")).first()["q"]
    inf = float("inf")
    cuts = sorted({v for v in values or [] if -inf < v < inf}) or [0.0]
    return Bucketizer(
        splits=[-inf, *cuts, inf], inputCol="score", outputCol="_range", handleInvalid="keep"
    )


def cumulative_counts(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from the highest down: ``tp`` and ``fp`` of calling
    that score and everything above it positive.

    The counts per distinct score are staged, so the input is read once. Then
    ranges of scores are cumulated independently and shifted by the totals of
    the ranges above; no task sees more than its range.
    """
    staged = stage(score_counts(df, truth, score, by))
    counts = _score_ranges(staged).transform(staged)
    inside = (
        Window.partitionBy(*by, "_range")
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    above = (
        Window.partitionBy(*by)
        .orderBy(F.col("_range").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*by)
    totals = (
        counts.groupBy(*by, "_range")
        .agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
        .select(
            *by,
            "_range",
            F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_tp_above"),
            F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_fp_above"),
            F.sum("_pos").over(whole).alias("positives"),
            F.sum("_neg").over(whole).alias("negatives"),
        )
    )
    local = counts.withColumn("_tp", F.sum("pos").over(inside)).withColumn(
        "_fp", F.sum("neg").over(inside)
    )
    return local.join(totals, [*by, "_range"]).select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("_tp_above") + F.col("_tp")).alias("tp"),
        (F.col("_fp_above") + F.col("_fp")).alias("fp"),
        "positives",
        "negatives",
    )


def _curve_aggregates() -> list[Column]:
    """ROC-AUC by trapezoids over distinct scores, and the step-wise average
    precision (no interpolation). NaN when only one class is present."""
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    p, n = (
        F.coalesce(F.max(c), F.lit(0)).cast("double") for c in ("positives", "negatives")
    )
    one_class = (p == 0) | (n == 0)
    area = F.sum(neg * (2 * tp - pos) / 2)
    steps = F.sum(pos * F.try_divide(tp, tp + fp))
    nan = F.lit(float("nan"))
    return [
        F.when(one_class, nan).otherwise(F.try_divide(area, p * n)).alias("roc_auc"),
        F.when(one_class, nan).otherwise(F.try_divide(steps, p)).alias("pr_auc"),
    ]


def curve_areas(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return cumulative_counts(df, truth, score, by).groupBy(*by).agg(*_curve_aggregates())


def _confusion_aggregates(
    threshold: Column, score: Column, pos: Column, neg: Column
) -> list[Column]:
    hit = at_least(score, threshold)
    zero = F.lit(0).cast("long")
    return [
        F.coalesce(F.sum(F.when(~hit, neg)), zero).alias("tn"),
        F.coalesce(F.sum(F.when(hit, neg)), zero).alias("fp"),
        F.coalesce(F.sum(F.when(~hit, pos)), zero).alias("fn"),
        F.coalesce(F.sum(F.when(hit, pos)), zero).alias("tp"),
    ]


def confusion(
    df: DataFrame, truth: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """``tn, fp, fn, tp`` at a threshold, in one map-side combined aggregate."""
    y = F.col(truth).cast("int")
    pos, neg = (y == 1).cast("long"), (y == 0).cast("long")
    return df.groupBy(*by).agg(
        *_confusion_aggregates(F.lit(float(threshold)), F.col(score).cast("double"), pos, neg)
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, F1 and MCC to confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": rates.accuracy(tp, fp, fn, tn),
            "precision": rates.precision(tp, fp),
            "recall": rates.recall(tp, fn),
            "f1": rates.f1(tp, fp, fn),
            "mcc": rates.mcc(tp, fp, fn, tn),
        }
    )


METRIC_COLUMNS = [
    "threshold", "accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "pr_auc",
    "tn", "fp", "fn", "tp",
]


def binary_metrics(
    df: DataFrame, truth: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """The full set of detection metrics, one row per ``by`` value."""
    aggregates = cumulative_counts(df, truth, score, by).groupBy(*by).agg(
        *_curve_aggregates(),
        *_confusion_aggregates(
            F.lit(float(threshold)), F.col("score"), F.col("pos"), F.col("neg")
        ),
    )
    return (
        with_rates(aggregates)
        .withColumn("threshold", F.lit(float(threshold)))
        .select(*by, *METRIC_COLUMNS)
    )


def positive_rate(df: DataFrame, truth: str, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(truth).cast("int")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == 1).alias("positives"),
        F.avg((y == 1).cast("double")).alias("positive_rate"),
    )
