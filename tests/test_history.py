import math

import pytest

from tagloom.operators import history


def loop(scores, patience):
    """Early stopping as a training loop does it."""
    best, best_epoch, waited, last = -1.0, -1, 0, 0
    for epoch, score in enumerate(scores, 1):
        last = epoch
        if score > best:
            best, best_epoch, waited = score, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                return best_epoch, best, last, True
    return best_epoch, best, last, False


RUNS = {
    "improves": [0.1, 0.2, 0.3],
    "stops": [0.70, 0.72, 0.73, 0.75, 0.74, 0.73, 0.80, 0.90],
    "tie": [0.5, 0.5, 0.5, 0.6],
    "recovers": [0.5, 0.4, 0.6, 0.5, 0.7],
    "never": [-2.0, -3.0, -1.0, 0.5],
    "single": [0.3],
}


@pytest.mark.parametrize("patience", [0, 1, 2, 3])
def test_early_stop(spark, patience):
    rows = [(run, e, s) for run, scores in RUNS.items() for e, s in enumerate(scores, 1)]
    df = spark.createDataFrame(rows, "run string, epoch int, score double").repartition(3)
    got = {
        r["run"]: (r["best_epoch"], r["best_score"], r["last_epoch"], r["stopped_early"])
        for r in history.early_stop(df, ["run"], "epoch", "score", patience).collect()
    }
    assert got == {run: loop(scores, patience) for run, scores in RUNS.items()}


def test_optimizer_steps():
    assert history.optimizer_steps(15147, 16, 1, 3) == math.ceil(15147 / 16) * 3
    assert history.optimizer_steps(100, 16, 4, 2) == 4
    assert history.optimizer_steps(10, 16, 0, 1) == 1


@pytest.mark.parametrize("total, ratio", [(100, 0.1), (7, 0.1), (5, 0.0)])
def test_warmup_schedule(spark, total, ratio):
    warm = int(total * ratio)
    rows = history.warmup_schedule(spark, total, ratio, 2.0).orderBy("step").collect()
    want = [
        2.0 * (i / max(1, warm) if i < warm else max(0.0, (total - i) / max(1, total - warm)))
        for i in range(total)
    ]
    assert [r["rate"] for r in rows] == pytest.approx(want)
