"""Training-run analytics on histories derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import history, multiclass
from tagloom.queries.registry import query, table

_HISTORY = """
    SELECT l_suppkey AS run, l_linenumber AS epoch, sum(l_quantity) / 1000.0::DOUBLE AS score
    FROM lineitem GROUP BY 1, 2"""
# Epoch by epoch, as a training loop does it.
_TRACKED = f"""
    SELECT *, CAST(step - coalesce(max(CASE WHEN improved THEN step END) OVER w, 0) AS INTEGER) AS stale,
           coalesce(max(CASE WHEN improved THEN epoch END) OVER w, -1) AS best_epoch,
           greatest(max(score) OVER w, -1) AS best_score
    FROM (SELECT *, score > greatest(coalesce(max(score) OVER (
                     PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) AS improved,
                 row_number() OVER (PARTITION BY run ORDER BY epoch) AS step
          FROM ({_HISTORY}))
    WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)"""
_REACHED = f"""
    SELECT t.*, NOT EXISTS (SELECT 1 FROM ({_TRACKED}) e
                            WHERE e.run = t.run AND e.epoch < t.epoch AND e.stale >= 2) AS reached
    FROM ({_TRACKED}) t"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as runs, line numbers as epochs."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch"))
        .agg((F.sum("l_quantity") / F.lit(1000.0)).alias("score"))
    )


@query(f"SELECT run, epoch, score, improved, stale, best_epoch, best_score, reached FROM ({_REACHED})")
def epoch_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best so far and patience, epoch by epoch."""
    return history.track_best(_history(spark, sf_dir), ["run"], "epoch", "score", patience=2)


@query(f"""
SELECT run, arg_max(best_epoch, epoch) AS best_epoch, arg_max(best_score, epoch) AS best_score,
       max(epoch) AS last_epoch, arg_max(stale, epoch) >= 2 AS stopped_early
FROM ({_REACHED}) WHERE reached GROUP BY run""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.early_stop(_history(spark, sf_dir), ["run"], "epoch", "score", patience=2)


@query("""
SELECT epoch, round(sum(loss * size) / sum(size), 9) AS mean_loss, CAST(sum(size) AS BIGINT) AS rows
FROM (SELECT l_linenumber AS epoch, avg(l_discount) AS loss, count(*) AS size
      FROM lineitem GROUP BY l_linenumber, l_suppkey)
GROUP BY epoch""")
def weighted_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of unequal batches averaged per epoch."""
    batches = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linenumber").alias("epoch"), "l_suppkey")
        .agg(F.avg("l_discount").alias("loss"), F.count(F.lit(1)).alias("size"))
    )
    means = multiclass.mean_loss(batches, ["epoch"])
    return means.withColumn("mean_loss", F.round("mean_loss", 9))


@query("""
WITH total AS (SELECT CAST(ceil(count(*) / 16.0) * 3 AS BIGINT) AS n FROM documents),
phase AS (SELECT n, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) AS warm FROM total)
SELECT step, round(CAST(0.00002 AS DOUBLE) * CASE WHEN step < warm THEN step / greatest(1, warm)
       ELSE (n - step) / greatest(1, n - warm) END, 12) AS rate
FROM phase, range((SELECT n FROM total)) t(step)""")
def warmup_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rates for three epochs over the documents in batches of 16."""
    rows = table(spark, sf_dir, "documents").count()
    steps = history.optimizer_steps(rows, batch_size=16, accumulation=1, epochs=3)
    rates = history.warmup_schedule(spark, steps, 0.1, 2e-5)
    return rates.withColumn("rate", F.round("rate", 12))
