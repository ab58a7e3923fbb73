"""Batch predictions: read records, score, shape, write, compare with gold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import schemas
from tagloom.functions.text import truncate_middle
from tagloom.operators import multiclass, scoring
from tagloom.plans.model import ScoreRows, run_settings
from tagloom.sources import documents, jsonl

# Fixed value: the limit of runs whose settings do not name one.
LEGACY_CODE_CHARS = 8000


@dataclass(frozen=True)
class Predictor:
    """What a checkpoint folder says about how to read its scores."""

    task: str
    names: Sequence[str]
    threshold: float
    # Set for checkpoints from before the token-level cut: texts are cut by
    # characters first, as they were in training.
    max_code_chars: int | None = None

    @staticmethod
    def load(spark: SparkSession, checkpoint: str, threshold: float | None = None) -> Predictor:
        base = checkpoint.rstrip("/")
        if not documents.exists(spark, base):
            raise FileNotFoundError(f"no checkpoint folder {base}")
        content: dict[str, Any] = {}
        if documents.exists(spark, f"{base}/label_map.json"):
            content = documents.read_json(spark, f"{base}/label_map.json")
        tuned = f"{base}/threshold.json"
        stored = documents.read_text(spark, tuned) if documents.exists(spark, tuned) else None
        return Predictor(
            content.get("task", "detection"),
            documents.names_by_id(content) if content else ["safe", "vulnerable"],
            scoring.chosen_threshold(threshold, stored),
            _character_limit(run_settings(spark, base)),
        )

    def prepare(self, rows: DataFrame) -> DataFrame:
        """What happens to ``code`` before the scorer sees it."""
        if self.max_code_chars is None:
            return rows
        return rows.withColumn("code", truncate_middle(F.col("code"), self.max_code_chars))

    def shape(self, scored: DataFrame) -> DataFrame:
        """Replace ``probs`` by the ``pred`` struct."""
        if self.task == "detection":
            pred = scoring.detection_prediction(F.col("probs"), self.threshold)
        else:
            pred = scoring.class_prediction(F.col("probs"), self.names)
        return scored.withColumn("pred", pred).drop("probs")


def _character_limit(settings: dict[str, Any] | None) -> int | None:
    """The run's character limit; none if the run cuts by tokens or left no
    settings behind."""
    if settings is None:
        return None
    section = settings.get("model", {})
    if "head_ratio" in section:
        return None
    return int(section.get("max_code_chars", LEGACY_CODE_CHARS))


def prediction_lines(predicted: DataFrame) -> DataFrame:
    """``id, pred`` and, where a label exists, ``gold``, as JSON text. The id
    is written even if null, gold only if known."""
    options = {"ignoreNullFields": "false"}
    gold = F.col("label").alias("gold")
    return predicted.select(
        F.when(F.col("label").isNotNull(), F.to_json(F.struct("id", "pred", gold), options))
        .otherwise(F.to_json(F.struct("id", "pred"), options))
        .alias("value")
    )


def default_output(path: str) -> str:
    """``x.jsonl`` -> ``x.pred.jsonl``."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    return f"{folder}{slash}{name.rsplit('.', 1)[0]}.pred.jsonl"


def predict_file(
    spark: SparkSession, predictor: Predictor, score: ScoreRows, path: str, out: str | None = None
) -> dict[str, Any]:
    """Score a JSON Lines file; returns agreement counts over labelled rows."""
    out = out or default_output(path)
    predicted = predictor.shape(score(predictor.prepare(jsonl.read_records(spark, path))))
    prediction_lines(predicted).write.mode("overwrite").text(out)
    kind = schemas.DETECTION if predictor.task == "detection" else schemas.CLASSIFICATION
    # Counted on the written file, so that nothing is scored twice.
    written = jsonl.read_strict(spark, out, schemas.predictions(kind))
    return multiclass.gold_agreement(written, "pred.label", "gold").first().asDict()


def predict_one(predictor: Predictor, score: ScoreRows, rows: DataFrame) -> dict[str, Any]:
    """The prediction for a single-row input, as a dict; more rows are an error."""
    found = predictor.shape(score(predictor.prepare(rows.limit(2)))).select("pred").collect()
    if len(found) != 1:
        raise ValueError("expected one text; put several into a JSON Lines file and use --input")
    return found[0]["pred"].asDict(recursive=True)
