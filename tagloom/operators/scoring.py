"""Scoring with a pluggable model, and the shape of a prediction."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import vectors
from tagloom.functions.binding import bind
from tagloom.operators.binary import verdict
from tagloom.operators.labels import DETECTION_NAMES, name_of

# Fixed values.
DEFAULT_THRESHOLD = 0.5
TOP_CANDIDATES = 5


class Scorer(Protocol):
    """A model that turns texts into an (n, classes) probability matrix."""

    def predict_probs(self, codes: list[str]) -> np.ndarray: ...


def score(
    df: DataFrame,
    load: Callable[[], Scorer],
    code: str = "code",
    name: str = "probs",
    batch_size: int = 16,
) -> DataFrame:
    """Add the class probabilities of every row.

    ``load`` runs once per task. Only the text travels to Python;
    all other columns, a gold label among them, stay on their row.
    """

    @F.pandas_udf("array<double>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for batch in batches:
            codes = batch.fillna("").tolist()
            rows: list[np.ndarray] = []
            for low in range(0, len(codes), batch_size):
                rows.extend(np.asarray(scorer.predict_probs(codes[low:low + batch_size]), dtype=float))
            yield pd.Series(rows, dtype=object)

    return df.withColumn(name, probabilities(F.col(code)))


def detection_prediction(probs: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Verdict by threshold, not by the larger probability; the confidence is
    the chosen side's probability and may be below one half."""
    safe, flawed = F.get(probs, F.lit(0)), F.get(probs, F.lit(1))
    label = verdict(flawed, F.lit(float(threshold)))
    return F.struct(
        label.alias("label"),
        F.when(label == 1, DETECTION_NAMES[1]).otherwise(DETECTION_NAMES[0]).alias("verdict"),
        F.when(label == 1, flawed).otherwise(safe).alias("confidence"),
        safe.alias("prob_safe"),
        flawed.alias("prob_vulnerable"),
        F.lit(float(threshold)).alias("threshold"),
    )


def class_prediction(probs: Column, names: Sequence[str], k: int = TOP_CANDIDATES) -> Column:
    """The best class and the ``k`` best candidates with their names."""

    def shape(best: Column) -> Column:
        first = F.get(best, F.lit(0))
        return F.struct(
            first["id"].alias("label"),
            name_of(first["id"], names).alias("cwe"),
            first["prob"].alias("confidence"),
            F.transform(
                best,
                lambda c: F.struct(name_of(c["id"], names).alias("cwe"), c["prob"].alias("prob")),
            ).alias("topk"),
        )

    return bind(vectors.top_classes(probs, k), shape)


def chosen_threshold(argument: float | None, document: str | None) -> float:
    """Explicit argument, else the tuned value, else the default. A broken
    threshold document counts as absent."""
    if argument is not None:
        return float(argument)
    if document is not None:
        try:
            return float(json.loads(document)["threshold"])
        except (KeyError, TypeError, ValueError):
            pass
    return DEFAULT_THRESHOLD
