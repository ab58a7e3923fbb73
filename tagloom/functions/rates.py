"""Ratios of confusion counts. A zero denominator gives 0, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return ratio(tp + tn, tp + fp + fn + tn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def harmonic_mean(a: Column, b: Column) -> Column:
    return ratio(2 * a * b, a + b)


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 whenever a margin is empty. Products are taken
    as doubles because four counts overflow a long."""
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    return ratio(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c)))


def metric_line(*names: str) -> Column:
    """``accuracy=0.9123 | tp=17``: doubles with 4 decimals, the rest as is.

    Pass double columns by name, count columns with a leading ``#``.
    """
    parts = []
    for name in names:
        if name.startswith("#"):
            parts.append(F.concat(F.lit(name[1:] + "="), F.col(name[1:]).cast("string")))
        else:
            parts.append(F.concat(F.lit(name + "="), F.format_string("%.4f", F.col(name))))
    return F.concat_ws(" | ", *parts)


def rate_line(metrics: dict) -> str:
    """The same line for metrics already on the driver."""
    return " | ".join(
        f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in metrics.items()
    )
