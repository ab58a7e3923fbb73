"""Multi-class evaluation from one aggregate over (truth, prediction) cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import rates, vectors
from tagloom.operators.staging import stage


def cells(
    df: DataFrame,
    truth: str,
    probs: str,
    top_k: int = 3,
    by: Sequence[str] = (),
) -> DataFrame:
    """``by, y, pred, n, hits``: the confusion matrix in long form, with the
    number of rows whose true class is among the ``top_k`` best."""
    y = F.col(truth).cast("int")
    scored = df.select(
        *by,
        y.alias("y"),
        vectors.argmax(F.col(probs)).alias("pred"),
        (vectors.rank_of(F.col(probs), y) <= top_k).alias("_hit"),
    )
    return scored.groupBy(*by, "y", "pred").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("hits")
    )


def per_class(cell_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, class_id, tp, support, predicted, hits`` and precision, recall and
    F1, for every class seen in truth or prediction."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("y").alias("class_id"),
            F.when(F.col("y") == F.col("pred"), n).otherwise(zero).alias("tp"),
            n.alias("support"),
            zero.alias("predicted"),
            F.col("hits"),
        ),
        F.struct(
            F.col("pred").alias("class_id"),
            zero.alias("tp"),
            zero.alias("support"),
            n.alias("predicted"),
            zero.alias("hits"),
        ),
    )
    sums = (
        cell_table.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.class_id").alias("class_id"))
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "predicted", "hits")])
    )
    return _with_class_rates(sums)


def _with_class_rates(sums: DataFrame) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.withColumns(
        {
            "precision": rates.ratio(tp, predicted),
            "recall": rates.ratio(tp, support),
            "f1": rates.ratio(2 * tp, support + predicted),
        }
    )


def multiclass_metrics(
    df: DataFrame,
    truth: str,
    probs: str,
    num_labels: int,
    top_k: int = 3,
    by: Sequence[str] = (),
) -> DataFrame:
    """``accuracy, macro_f1, weighted_f1, micro_f1, top{k}_accuracy``.

    Macro F1 averages over the classes seen in truth or prediction; with one
    label per row micro F1 equals accuracy; k is at most ``num_labels``.
    """
    k = min(top_k, num_labels)
    classes = per_class(cells(df, truth, probs, k, by), by)
    rows = F.sum("support")
    return (
        classes.groupBy(*by)
        .agg(
            rates.ratio(F.sum("tp"), rows).alias("accuracy"),
            F.avg("f1").alias("macro_f1"),
            rates.ratio(F.sum(F.col("f1") * F.col("support")), rows).alias("weighted_f1"),
            rates.ratio(F.sum("tp"), rows).alias("micro_f1"),
            rates.ratio(F.sum("hits"), rows).alias(f"top{k}_accuracy"),
        )
    )


def class_report(cell_table: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``class_id, name, precision, recall, f1, support`` for every class of
    the dictionary (``id, name``), zero-filled where nothing was seen."""
    seen = per_class(cell_table)
    names = dictionary.select(F.col("id").alias("class_id"), "name")
    values = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]
    # Both sides have one row per class, so no hint is needed.
    return names.join(seen, "class_id", "left").select(
        "class_id", "name", *values, F.coalesce("support", F.lit(0)).alias("support")
    )


def full_report(cell_table: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The class report followed by accuracy, macro and weighted averages.

    The averages are over the dictionary's classes. Where these leave out a
    class that was seen, a micro average over the listed ones stands in place
    of the accuracy over all rows. The confusion matrix is staged: it is small,
    and the rows behind it are not.
    """
    staged = stage(cell_table)
    report = class_report(staged, dictionary).select("name", "precision", "recall", "f1", "support")
    weight, total = F.col("support"), F.sum("support")

    def averaged(name: str, mean: Callable[[str], Column]) -> DataFrame:
        return report.agg(
            *[mean(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")
        ).select(F.lit(name).alias("name"), "precision", "recall", "f1", "support")

    right = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    accuracy = staged.agg(
        rates.ratio(F.sum(right), F.sum("n")).alias("f1"), F.sum("n").alias("support")
    ).select(
        F.lit("accuracy").alias("name"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        "f1",
        "support",
    )
    seen = per_class(staged)
    listed = dictionary.select(F.col("id").alias("class_id"))
    if not seen.join(listed, "class_id", "left_anti").isEmpty():
        tp, predicted, support = F.sum("tp"), F.sum("predicted"), F.sum("support")
        accuracy = seen.join(listed, "class_id", "left_semi").agg(
            F.lit("micro avg").alias("name"),
            rates.ratio(tp, predicted).alias("precision"),
            rates.ratio(tp, support).alias("recall"),
            rates.ratio(2 * tp, predicted + support).alias("f1"),
            F.coalesce(support, F.lit(0)).alias("support"),
        )
    return (
        report.unionByName(accuracy)
        .unionByName(averaged("macro avg", lambda c: F.avg(c)))
        .unionByName(averaged("weighted avg", lambda c: rates.ratio(F.sum(F.col(c) * weight), total)))
    )


# Fixed formats of the text report; names are cut so that columns stay apart.
REPORT_HEADER = "%-34s%9s%9s%9s%10s" % ("class", "prec", "recall", "f1", "support")
REPORT_ROW = "%-34s%9.4f%9.4f%9.4f%10d"
NAME_WIDTH = 33


def report_lines(report: DataFrame) -> DataFrame:
    """``line_no, line``: the report as a fixed-width text table."""
    rule = "-" * len(REPORT_HEADER)
    top = report.sparkSession.createDataFrame(
        [(-2, REPORT_HEADER), (-1, rule)], "line_no int, line string"
    )
    body = report.select(
        F.col("class_id").alias("line_no"),
        F.format_string(
            REPORT_ROW, F.left("name", F.lit(NAME_WIDTH)), "precision", "recall", "f1", "support"
        ).alias("line"),
    )
    return top.unionByName(body)


def gold_agreement(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """``correct, total, agreement`` over the rows that have a gold label."""
    known = df.filter(F.col(gold).isNotNull())
    right = F.count_if(F.col(predicted).cast("int") == F.col(gold).cast("int"))
    return known.agg(right.alias("correct"), F.count(F.lit(1)).alias("total")).withColumn(
        "agreement", rates.ratio(F.col("correct"), F.col("total"))
    )


def cross_entropy(
    df: DataFrame,
    truth: str,
    probs: str,
    weights: DataFrame | None = None,
    from_logits: bool = False,
) -> DataFrame:
    """``loss``: mean negative log-likelihood of probabilities or logits; with
    class ``weights`` (``class_id, weight``) the mean is weighted and divided
    by the weights. A null label or one outside the vector is an error."""
    y = F.col(truth).cast("int")
    loss = vectors.logits_loss if from_logits else vectors.negative_log_likelihood
    per_row = df.select(y.alias("class_id"), loss(F.col(probs), y).alias("_nll"))
    per_label = per_row.groupBy("class_id").agg(
        F.sum("_nll").alias("_nll"), F.count(F.lit(1)).alias("_n")
    )
    if weights is None:
        return per_label.agg((F.sum("_nll") / F.sum("_n")).alias("loss"))
    # The weight is constant within a class, so weigh the per-class sums.
    joined = per_label.join(weights.select("class_id", "weight"), "class_id")
    return joined.agg(
        (F.sum(F.col("weight") * F.col("_nll")) / F.sum(F.col("weight") * F.col("_n"))).alias("loss")
    )


def mean_loss(batches: DataFrame, by: Sequence[str], loss: str = "loss", size: str = "size") -> DataFrame:
    """Mean of batch losses weighted by batch size."""
    return batches.groupBy(*by).agg(
        (F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("mean_loss"),
        F.sum(size).alias("rows"),
    )
