import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import vectors

V = F.col("v")


def softmax(z):
    e = np.exp(np.array(z) - max(z))
    return e / e.sum()


LOGITS = [[1000.0, 999.0, 0.0], [0.5, 0.5, 0.5], [-3.0, 2.0, 1.0], [2.0, 7.0]]


def test_softmax(values):
    got = values(vectors.softmax(V), LOGITS, "array<double>")
    for row, z in zip(got, LOGITS):
        assert row == pytest.approx(softmax(z), abs=1e-15)
        assert sum(row) == pytest.approx(1.0)


def test_positive_probability_is_two_class_softmax(values):
    pairs = [[1000.0, -1000.0], [0.1, 0.3], [2.0, 2.0]]
    got = values(vectors.positive_probability(V[0], V[1]), pairs, "array<double>")
    assert got == pytest.approx([softmax(z)[1] for z in pairs])


def test_argmax_prefers_lowest_id(values):
    assert values(vectors.argmax(V), [[1.0, 3.0, 3.0], [2.0, 2.0], [0.0]], "array<double>") == [1, 0, 0]


def test_top_classes_and_rank(values):
    rows = [[0.2, 0.5, 0.2, 0.1], [0.7, 0.3]]
    got = values(vectors.top_classes(V, 3), rows, "array<double>")
    assert [[(c["id"], c["prob"]) for c in row] for row in got] == [
        [(1, 0.5), (0, 0.2), (2, 0.2)], [(0, 0.7), (1, 0.3)],
    ]
    assert values(vectors.rank_of(V, F.lit(2)), rows, "array<double>") == [3, None]
    assert values(vectors.rank_of(V, F.lit(0)), rows, "array<double>") == [2, 1]


def test_log_probabilities_undo_softmax(values):
    probs = [[0.25, 0.75], [1.0, 0.0]]
    again = values(vectors.softmax(vectors.log_probabilities(V)), probs, "array<double>")
    assert again[0] == pytest.approx(probs[0])
    assert again[1] == pytest.approx([1.0, 1e-12])
    nll = values(vectors.negative_log_likelihood(V, F.lit(1)), probs, "array<double>")
    assert nll == pytest.approx([-math.log(0.75), -math.log(1e-12)])


def test_pooling(spark):
    hidden = [[1.0, 2.0], [3.0, 6.0], [100.0, 100.0]]
    df = spark.createDataFrame(
        [(hidden, [1, 1, 0]), (hidden, [0, 0, 0])], "h array<array<double>>, m array<int>"
    )
    rows = df.select(
        vectors.mean_pooling(F.col("h"), F.col("m")).alias("mean"), vectors.cls_pooling(F.col("h")).alias("cls")
    ).collect()
    assert rows[0]["mean"] == [2.0, 4.0] and rows[0]["cls"] == [1.0, 2.0]
    assert rows[1]["mean"] == [0.0, 0.0]
