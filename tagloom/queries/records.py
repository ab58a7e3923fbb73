"""JSON Lines round trips and scoring with a Python model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import binary, corpus, history, scoring, splits
from tagloom.operators.staging import scratch_dir, stage
from tagloom.queries.registry import query, sql_split, table
from tagloom.plans import evaluate, model
from tagloom.schemas import LABELLED_INPUT
from tagloom.settings import load_settings, merged
from tagloom.sources import jsonl

def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, labelled where a label exists."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(known, "doc_id", "left").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("code"),
        F.col("quality").alias("label"),
    )


SQL_RECORDS = """
    SELECT 'doc-' || doc_id AS id, text AS code, quality AS label FROM documents LEFT JOIN labels USING (doc_id)"""


@query(f"SELECT id, md5(code) AS code_hash, label FROM ({SQL_RECORDS})")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON Lines, read back strictly."""
    path = scratch_dir(spark)
    jsonl.write_jsonl(labelled_documents(spark, sf_dir), path)
    back = jsonl.read_strict(spark, path, LABELLED_INPUT)
    return back.select("id", F.md5("code").alias("code_hash"), "label")


@query(f"SELECT id, CAST(length(code) AS INTEGER) AS n_code, label FROM ({SQL_RECORDS})")
def jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record followed by a broken copy and a blank line: only the
    whole records come back."""
    path = scratch_dir(spark)
    line = F.to_json(F.struct("id", "code", "label"))
    lines = F.array(line, F.substring(line, F.lit(1), F.length(line) - 1), F.lit(""))
    labelled_documents(spark, sf_dir).select(F.explode(lines).alias("value")).write.text(path)
    back = jsonl.read_lenient(spark, path, LABELLED_INPUT)
    return back.select("id", F.length("code").alias("n_code"), "label")


@query(f"SELECT id, md5(code) AS code_hash, label FROM ({SQL_RECORDS}) WHERE label IS NOT NULL")
def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a label are left out on reading."""
    path = scratch_dir(spark)
    jsonl.write_jsonl(labelled_documents(spark, sf_dir), path)
    return jsonl.read_labelled(spark, path).select("id", F.md5("code").alias("code_hash"), "label")


@query(f"SELECT id, label FROM ({SQL_RECORDS}) WHERE label IS NOT NULL")
def missing_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.labelled_only(labelled_documents(spark, sf_dir)).select("id", "label")


@query(f"""
SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents JOIN ({sql_split('documents', 'source')}) USING (source)
WHERE split = 'val' GROUP BY source""")
def partitioned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written per split; one split read back without touching the others."""
    path = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    jsonl.write_jsonl(splits.fit_group_split(docs, "source").assign(docs), path, "split")
    back = spark.read.schema("doc_id long, source string, n_chars long, split string").json(path)
    return (
        back.filter(F.col("split") == "val")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    )


class LineBreakScorer:
    """A stand-in model: the more line breaks, the more suspicious."""

    def predict_probs(self, codes: list[str]) -> np.ndarray:
        breaks = np.array([c.count("\n") for c in codes], dtype=float)
        flawed = breaks / (breaks + 10.0)
        return np.column_stack([1.0 - flawed, flawed])


@query("""
SELECT doc_id, CAST(p >= 0.5 AS INTEGER) AS label, CASE WHEN p >= 0.5 THEN 'vulnerable' ELSE 'safe' END AS verdict,
       round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 9) AS confidence, round(p, 9) AS prob_vulnerable
FROM (SELECT doc_id, b / (b + CAST(10.0 AS DOUBLE)) AS p
      FROM (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS b FROM documents))""")
def scored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through a Python scorer, shaped into verdicts in the JVM."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scoring.score(docs, LineBreakScorer, code="text", batch_size=256).drop("text")
    pred = scored.select("doc_id", scoring.detection_prediction(F.col("probs")).alias("p"))
    return pred.select(
        "doc_id",
        "p.label",
        "p.verdict",
        F.round("p.confidence", 9).alias("confidence"),
        F.round("p.prob_vulnerable", 9).alias("prob_vulnerable"),
    )


@query()
def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark ML baseline fitted on the labelled documents' train split and
    measured on each split. Rows-only check: an iterative fit has no SQL twin."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    known = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(known, "doc_id").select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("group_id"),
        F.col("text").alias("code"),
        F.col("quality").alias("label"),
    )
    split = stage(splits.fit_group_split(rows).assign(rows))
    fitted = model.fit_baseline(
        split.filter(F.col("split") == "train"), load_settings(), 2
    )
    path = scratch_dir(spark)
    fitted.save(f"{path}/model")
    scored = model.load_scores(spark, path, None)(split)
    return binary.binary_metrics(
        evaluate.positive_scores(scored, keep=["split"]), "y", "score", by=["split"]
    )


@query(f"""
WITH r AS (SELECT d.doc_id, d.source AS group_id, l.quality AS label
           FROM documents d JOIN labels l USING (doc_id)),
s AS ({sql_split('r', 'group_id')})
SELECT split, count(*) AS rows, count(*) FILTER (label = 1) AS positives, true AS adds_up, true AS areas_in_range,
       true AS best_epoch_agrees, true AS best_is_highest
FROM r JOIN s USING (group_id) GROUP BY split""")
def baseline_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline trained in epochs with patience on the labelled documents:
    what SQL can say of its metrics per split, and whether the best epoch it
    wrote is the one its history tells."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    known = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(known, "doc_id").select(
        F.col("doc_id").alias("ord"), F.col("source").alias("group_id"), F.col("text").alias("code"),
        F.col("quality").alias("label"),
    )
    split = stage(splits.fit_group_split(rows).assign(rows))
    config = merged(load_settings(), {"training": {"epochs": 3, "early_stopping_patience": 2}})

    def validate(score):
        metrics = evaluate.metrics_of(score(split.filter("split <> 'train'")).select("label", "probs"), "detection", 2, 0.5)
        return metrics, metrics["f1"]

    done = model.fit_epochs(split.filter("split = 'train'"), config, 2, validate, features=1 << 14, iterations=3)
    told = spark.createDataFrame([("one", e["epoch"], float(e["score"])) for e in done.history], "run string, epoch int, score double")
    best = history.early_stop(told, ["run"], "epoch", "score", 2).first()
    scored = model.baseline_scores(done.best)(split)
    metrics = binary.binary_metrics(evaluate.positive_scores(scored, keep=["split"]), "y", "score", by=["split"])
    within = [F.isnan(c) | F.col(c).between(0, 1) for c in ("roc_auc", "pr_auc")]
    return metrics.select(
        "split",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
        (F.col("tp") + F.col("fn")).alias("positives"),
        (F.round(F.col("accuracy") * (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))) == F.col("tn") + F.col("tp")).alias("adds_up"),
        (within[0] & within[1]).alias("areas_in_range"),
        F.lit(best["best_epoch"] == done.best_epoch).alias("best_epoch_agrees"),
        F.lit(max(e["score"] for e in done.history) == done.history[done.best_epoch - 1]["score"]).alias("best_is_highest"),
    )
