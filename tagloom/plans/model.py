"""A Spark ML baseline behind the same interface as a plugged-in scorer.

The encoder network itself is not part of this library. The baseline is a
different model (hashed word counts and logistic regression) and makes no
claim to the network's quality; it lets every step around it run on Spark.
"""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import settings as config
from tagloom.operators import balance, scoring
from tagloom.operators.labels import BROADCAST_CLASSES
from tagloom.operators.staging import scratch_dir, stage
from tagloom.sources import documents

ScoreRows = Callable[[DataFrame], DataFrame]

WORD_PATTERN = r"\w+|[^\w\s]"


def weigh_rows(rows: DataFrame, num_labels: int) -> DataFrame:
    """Add the ``weight`` of each row's class."""
    weights = balance.class_weights(rows, num_labels).select(
        F.col("class_id").alias("label"), "weight"
    )
    if num_labels <= BROADCAST_CLASSES:
        weights = F.broadcast(weights)
    weighed = rows.join(weights, "label", "left")
    missing = F.raise_error(F.lit("a label is null or outside the classes")).cast("double")
    return weighed.withColumn("weight", F.coalesce("weight", missing))


def balance_rows(rows: DataFrame, settings: Mapping[str, Any], num_labels: int) -> DataFrame:
    """Training rows with a ``weight``, under the chosen imbalance strategy.

    Balanced sampling is for detection; classification ignores it. A row drawn
    n times is the same as a row of weight n.
    """
    strategy = settings["data"]["imbalance"]
    if strategy == "weighted_loss":
        return weigh_rows(rows, num_labels)
    if strategy == "balanced_sampler" and settings["task"]["type"] == "detection":
        drawn = balance.balanced_sample(rows, settings["seed"])
        return drawn.withColumn("weight", F.col("draws").cast("double")).drop("draws")
    return rows.withColumn("weight", F.lit(1.0))


def fit_baseline(
    rows: DataFrame,
    settings: Mapping[str, Any],
    num_labels: int,
    features: int = 1 << 16,
    iterations: int = 20,
) -> PipelineModel:
    """Fit on ``code`` and ``label``; weights follow ``data.imbalance``."""
    stages = [*feature_stages(features), classifier(num_labels, iterations)]
    return Pipeline(stages=stages).fit(weighted_rows(rows, settings, num_labels))


def weighted_rows(rows: DataFrame, settings: Mapping[str, Any], num_labels: int) -> DataFrame:
    weighted = balance_rows(rows.select("code", "label", "ord"), settings, num_labels)
    return weighted.select("code", F.col("label").cast("double"), "weight")


def feature_stages(features: int) -> list[Any]:
    return [
        RegexTokenizer(
            inputCol="code", outputCol="_words", pattern=WORD_PATTERN, gaps=False, toLowercase=False
        ),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
    ]


def classifier(num_labels: int, iterations: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="weight",
        rawPredictionCol="_raw", probabilityCol="_probability",
        maxIter=iterations, regParam=1e-3,
        family="binomial" if num_labels == 2 else "multinomial",
    )


@dataclass
class Training:
    """Epochs of a fit so far: what each measured, and the best model."""

    history: list[dict[str, Any]]
    best_epoch: int
    best: PipelineModel | None


def fit_epochs(
    rows: DataFrame,
    settings: Mapping[str, Any],
    num_labels: int,
    validate: Callable[[ScoreRows], tuple[dict[str, Any], float]],
    features: int = 1 << 16,
    iterations: int = 4,
) -> Training:
    """Fit epoch by epoch until the validation score has not risen for
    ``training.early_stopping_patience`` epochs, or ``training.epochs`` are over.

    An epoch goes ``iterations`` steps further. The optimiser takes the same
    path each time, so an epoch walks it again from the start; the features
    are made and written once. ``validate`` measures a model on rows it was not
    fitted on and names the score to raise. A score must rise strictly above
    the best; a NaN does not.
    """
    options, spark = settings["training"], rows.sparkSession
    patience = max(1, int(options["early_stopping_patience"]))
    weighted = weighted_rows(rows, settings, num_labels)
    prepared = Pipeline(stages=feature_stages(features)).fit(weighted)
    path = scratch_dir(spark)
    done, best_score, stale = Training([], -1, None), -1.0, 0
    try:
        table = stage(prepared.transform(weighted).select("_features", "label", "weight"), f"{path}/rows")
        for epoch in range(1, int(options["epochs"]) + 1):
            last = classifier(num_labels, iterations * epoch).fit(table)
            loss = last.summary.objectiveHistory[-1]
            # As saved: without the training summary, which cannot travel to tasks.
            last.save(f"{path}/epoch={epoch}")
            fitted = PipelineModel([*prepared.stages, LogisticRegressionModel.load(f"{path}/epoch={epoch}")])
            metrics, score = validate(baseline_scores(fitted))
            done.history.append({"epoch": epoch, "train_loss": loss, "score": score, "val": metrics})
            if score > best_score:
                best_score, stale = score, 0
                done.best_epoch, done.best = epoch, fitted
            else:
                stale += 1
                if stale >= patience:
                    break
    finally:
        documents.remove(spark, path)
    return done


def baseline_scores(model: PipelineModel) -> ScoreRows:
    """Rows with ``code`` -> the same rows with ``probs``."""

    def score(rows: DataFrame) -> DataFrame:
        scored = model.transform(rows)
        return scored.select(*rows.columns, vector_to_array("_probability").alias("probs"))

    return score


def run_settings(spark: SparkSession, checkpoint: str) -> dict[str, Any] | None:
    """What the run that made a checkpoint was set to; None if it left no file."""
    path = f"{checkpoint.rstrip('/').rpartition('/')[0]}/config.yaml"
    return config.parse(documents.read_text(spark, path)) if documents.exists(spark, path) else None


def plugged_scores(
    entry_point: str,
    batch_size: int = 16,
    checkpoint: str | None = None,
    settings: Mapping[str, Any] | None = None,
) -> ScoreRows:
    """A scorer named ``package.module:factory``; see :class:`scoring.Scorer`.

    A factory with parameters named ``checkpoint`` and ``settings`` is given
    the checkpoint's path and the model settings of its run (``max_length`` and
    ``head_ratio`` say how texts were cut in training).
    """
    module, _, factory = entry_point.partition(":")
    offered = {"checkpoint": checkpoint, "settings": dict(settings or {})}

    def load() -> scoring.Scorer:
        make = getattr(importlib.import_module(module), factory)
        wanted = inspect.signature(make).parameters
        return make(**{name: value for name, value in offered.items() if name in wanted})

    return lambda rows: scoring.score(rows, load, batch_size=batch_size)


def load_scores(spark: SparkSession, checkpoint: str, scorer: str | None, batch_size: int = 16) -> ScoreRows:
    """The plugged-in scorer if one is named, else the checkpoint's baseline."""
    if scorer:
        options = (run_settings(spark, checkpoint) or {}).get("model")
        return plugged_scores(scorer, batch_size, checkpoint, config.merged(config.DEFAULTS["model"], options))
    return baseline_scores(PipelineModel.load(f"{checkpoint.rstrip('/')}/model"))
