"""Train the baseline on a built corpus and save a run folder."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import settings as config
from tagloom.functions.text import last_path_part
from tagloom.operators import labels, splits
from tagloom.plans import evaluate, model
from tagloom.plans.build import read_split
from tagloom.sources import documents

MODEL_NAME = "hashed-words-logistic-regression"


def load_splits(
    spark: SparkSession, settings: Mapping[str, Any]
) -> tuple[dict[str, DataFrame], list[str]]:
    """Capped splits and class names. If labels go beyond the dictionary, the
    labels win and the new classes are named by their id."""
    data, task = settings["data"], settings["task"]["type"]
    rows = {
        s: splits.sample_rows(
            read_split(spark, data["cache_dir"], data["source"], task, s),
            data["max_train_samples" if s == "train" else "max_eval_samples"],
            settings["seed"],
        )
        for s in splits.SPLITS
    }
    path = f"{data['cache_dir'].rstrip('/')}/{data['source']}_{task}_label_map.json"
    if documents.exists(spark, path):
        names = documents.names_by_id(documents.read_json(spark, path))
    elif task == "detection":
        names = list(labels.DETECTION_NAMES.values())
    else:
        names = [str(i) for i in range(settings["task"]["num_labels"])]
    every = rows["train"].select("label").unionByName(rows["val"].select("label"))
    every = every.unionByName(rows["test"].select("label"))
    count = labels.class_count(every, len(names)).first()["num_labels"]
    return rows, names + [str(i) for i in range(len(names), count)]


def train(
    spark: SparkSession, settings: Mapping[str, Any], run_name: str | None = None
) -> dict[str, Any]:
    """Fit, evaluate on val and test, and write model, label map, scores,
    reports, effective settings and the result document."""
    task, source = settings["task"]["type"], settings["data"]["source"]
    run = run_name or f"{source}_{task}_{last_path_part(MODEL_NAME)}"
    settings = config.merged(settings, {"training": {"run_name": run}})
    run_dir = f"{settings['training']['output_dir'].rstrip('/')}/{run}"
    rows, names = load_splits(spark, settings)
    documents.write_text(spark, f"{run_dir}/config.yaml", config.dump(settings))

    def validate(score: model.ScoreRows) -> tuple[dict[str, Any], float]:
        scored = score(rows["val"]).select("label", "probs")
        metrics = evaluate.metrics_of(scored, task, len(names), 0.5)
        return metrics, metrics["f1" if task == "detection" else "macro_f1"]

    fitted = model.fit_epochs(rows["train"], settings, len(names), validate)
    if fitted.best is None:
        raise ValueError("no epoch has a validation score; is the validation split empty?")
    # The best on the validation rows, not the last.
    fitted.best.write().overwrite().save(f"{run_dir}/best/model")
    documents.write_json(spark, f"{run_dir}/best/label_map.json", documents.label_map(task, names))

    # As saved: without the training summary, which would travel to every task.
    score = model.load_scores(spark, f"{run_dir}/best", None)
    results: dict[str, Any] = {
        "task": task, "source": source, "model": MODEL_NAME, "best_epoch": fitted.best_epoch,
        "history": [{k: e[k] for k in ("epoch", "train_loss", "val")} for e in fitted.history],
    }
    for split in ("val", "test"):
        # Scored once, then read for metrics, reports and later tuning.
        path = f"{run_dir}/scores/split={split}"
        scored = score(rows[split]).select("ord", "id", "label", "probs")
        scored.write.mode("overwrite").parquet(path)
        scored = spark.read.schema(scored.schema).parquet(path)
        results[split] = evaluate.metrics_of(scored, task, len(names), 0.5)
        if task == "classification":
            report = evaluate.report_text(scored, names)
            documents.write_text(spark, f"{run_dir}/report_{split}.txt", report)
    documents.write_json(spark, f"{run_dir}/results.json", results)
    return results


def run_scores(spark: SparkSession, run_dir: str) -> DataFrame:
    """``split, y, score`` of a finished detection run."""
    path = f"{run_dir.rstrip('/')}/scores"
    schema = "ord long, id string, label int, probs array<double>, split string"
    scored = spark.read.schema(schema).parquet(path)
    return evaluate.positive_scores(scored, "label", ["split"]).filter(F.col("y").isNotNull())
