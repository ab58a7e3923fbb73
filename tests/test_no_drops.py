"""Cases where rows used to vanish, or a result used to be capped."""

import math

import pytest
from pyspark.sql import functions as F

from tagloom.operators import balance, history, multiclass, ordering, splits
from tagloom.plans import model


def test_logits_keep_their_loss(spark):
    df = spark.createDataFrame([(0, [0.0, 1000.0])], "y int, z array<double>")
    assert multiclass.cross_entropy(df, "y", "z", from_logits=True).first()["loss"] == pytest.approx(1000)


@pytest.mark.parametrize("label", [None, 2])
def test_labels_outside_the_vector_are_errors(spark, label):
    df = spark.createDataFrame([(label, [0.5, 0.5])], "y int, p array<double>")
    with pytest.raises(Exception, match="no class"):
        multiclass.cross_entropy(df, "y", "p").collect()


def test_shuffle_split_keeps_null_groups(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 7}", i) for i in range(100)]
    got = splits.shuffle_split(spark.createDataFrame(rows, "group_id string, ord long"))
    assert got.count() == 100 and got.filter("split is null").count() == 0


def test_null_orders_are_errors(spark):
    df = spark.createDataFrame([(1,), (None,)], "ord long")
    with pytest.raises(Exception, match="order"):
        ordering.ranked(df, [F.col("ord")], ordering.ord_levels(F.col("ord"))).collect()


def test_null_labels_are_errors(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "ord long, label int")
    with pytest.raises(ValueError, match="null"):
        balance.balanced_sample(df, 1)
    with pytest.raises(Exception, match="label"):
        model.weigh_rows(df, 2).collect()


def test_nan_scores_are_no_improvement(spark):
    scores = [0.5, math.nan, 0.7, 0.6]
    rows = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(scores)], "run string, epoch int, score double")
    got = history.early_stop(rows, ["run"], "epoch", "score", 3).first()
    assert got["best_epoch"] == 3 and got["best_score"] == 0.7


def test_micro_average_where_classes_are_left_out(spark):
    cells = spark.createDataFrame([(0, 0, 3), (0, 2, 1), (1, 1, 2), (2, 1, 4)], "y int, pred int, n long")
    cells = cells.withColumn("hits", F.lit(0).cast("long"))
    names = spark.createDataFrame([(0, "a"), (1, "b")], "id int, name string")
    full = {r["name"]: r for r in multiclass.full_report(cells, names).collect()}
    assert "accuracy" not in full
    micro = full["micro avg"]
    assert micro["precision"] == pytest.approx(5 / 9) and micro["recall"] == pytest.approx(5 / 6)
    assert micro["support"] == 6
