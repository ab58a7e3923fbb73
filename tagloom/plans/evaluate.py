"""Metrics of scored rows, as documents and tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import binary, multiclass, thresholds
from tagloom.sources import documents


def positive_scores(scored: DataFrame, truth: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """``keep, y, score``: truth and the probability of class 1."""
    return scored.select(
        *keep, F.col(truth).cast("int").alias("y"), F.get("probs", F.lit(1)).alias("score")
    )


def detection_metrics(scored: DataFrame, threshold: float, truth: str = "label") -> dict[str, Any]:
    metrics = binary.binary_metrics(positive_scores(scored, truth), "y", "score", threshold)
    return metrics.first().asDict()


def class_metrics(
    scored: DataFrame, num_labels: int, top_k: int = 3, truth: str = "label"
) -> dict[str, Any]:
    return multiclass.multiclass_metrics(scored, truth, "probs", num_labels, top_k).first().asDict()


def metrics_of(
    scored: DataFrame, task: str, num_labels: int, threshold: float
) -> dict[str, Any]:
    if task == "detection":
        return detection_metrics(scored, threshold)
    return class_metrics(scored, num_labels)


def report_text(scored: DataFrame, names: Sequence[str], truth: str = "label") -> str:
    """The per-class table; as long as the dictionary."""
    table = documents.dictionary(scored.sparkSession, list(names))
    lines = multiclass.report_lines(
        multiclass.class_report(multiclass.cells(scored, truth, "probs"), table)
    )
    return "\n".join(row["line"] for row in lines.orderBy("line_no").collect())


def tune(
    scores: DataFrame, split: str = "val", target: float = 0.90
) -> tuple[dict[str, Any] | None, DataFrame]:
    """Pick a threshold on one split and look it up on the other.

    ``scores`` has ``split, y, score``. Returns the result row, or None if no
    threshold reaches the target, and the short sweep of the tuning split.
    """
    other = "test" if split == "val" else "val"
    fine = thresholds.sweep(scores, "y", "score", thresholds.fine_grid(), ["split"])
    moved = thresholds.transfer(fine, target, "split", split, other).first()
    table = thresholds.sweep(scores.filter(F.col("split") == split), "y", "score")
    return (moved.asDict() if moved else None), table


def threshold_document(best: dict[str, Any], target: float, split: str) -> dict[str, Any]:
    fields = {k: best[k] for k in ("recall", "precision", "f1", "fn", "fp")}
    return {"threshold": best["threshold"], "target_recall": target, "tuned_on": split, **fields}
