import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tagloom.functions import rates
from tagloom.operators import binary, multiclass, thresholds
from tagloom.sources import documents

# Published confusion counts of three runs and their published rates.
PUBLISHED = [
    ((779, 270, 189, 664), (0.7587, 0.7109, 0.7784, 0.7431, 0.5184)),
    ((754, 295, 163, 690), (0.7592, 0.7005, 0.8089, 0.7508, 0.5252)),
    ((782, 267, 178, 675), (0.7660, 0.7166, 0.7913, 0.7521, 0.5340)),
]


def test_published_rates(spark):
    df = spark.createDataFrame([c for c, _ in PUBLISHED], "tn long, fp long, fn long, tp long")
    for row, (_, want) in zip(binary.with_rates(df).collect(), PUBLISHED):
        got = [row[c] for c in ("accuracy", "precision", "recall", "f1", "mcc")]
        assert [round(v, 4) for v in got] == list(want)


def test_counts_beyond_long_products(spark):
    big = 10**11
    df = spark.createDataFrame([(big, big, big, 3 * big)], "tn long, fp long, fn long, tp long")
    assert binary.with_rates(df).first()["mcc"] == pytest.approx(2 / math.sqrt(4 * 4 * 2 * 2))


def areas(y, s):
    """Pairwise ROC-AUC and step-wise average precision, from definitions."""
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    if not pos or not neg:
        return math.nan, math.nan
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(p >= t for p in pos)
        recall, precision = tp / len(pos), tp / sum(v >= t for v in s)
        ap, before = ap + (recall - before) * precision, recall
    return auc, ap


def rows_of(spark, y, s):
    return spark.createDataFrame(list(zip(y, map(float, s))), "y int, score double")


def test_areas_match_definitions(spark):
    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=2, max_size=60))
    def check(pairs):
        y, s = zip(*pairs)
        s = [v / 12 for v in s]
        got = binary.curve_areas(rows_of(spark, y, s).repartition(3), "y", "score").first()
        auc, ap = areas(y, s)
        assert got["roc_auc"] == pytest.approx(auc, nan_ok=True)
        assert got["pr_auc"] == pytest.approx(ap, nan_ok=True)
        flipped = binary.curve_areas(rows_of(spark, y, [-v for v in s]), "y", "score").first()
        assert flipped["roc_auc"] == pytest.approx(1 - auc, nan_ok=True)

    check()


def test_continuous_and_hot_scores(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 3000)
    s = np.where(rng.random(3000) < 0.35, 0.5, rng.random(3000) * 0.6 + y * 0.3)
    got = binary.binary_metrics(rows_of(spark, y.tolist(), s.tolist()), "y", "score", 0.5).first()
    auc, ap = areas(y.tolist(), s.tolist())
    assert (got["roc_auc"], got["pr_auc"]) == (pytest.approx(auc), pytest.approx(ap))
    assert got["tp"] == int(((s >= 0.5) & (y == 1)).sum())
    assert got["tn"] == int(((s < 0.5) & (y == 0)).sum())


def test_score_ranges_are_balanced_for_crowded_scores(spark):
    # All scores within a hair of one half, a third of the rows on one value.
    score = F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(0.5 + F.col("id") * 1e-9)
    df = spark.range(30_000).select((F.col("id") % 2).alias("y"), score.alias("score"))
    counts = binary.score_counts(df, "y", "score")
    sizes = [r["count"] for r in binary._score_ranges(counts).transform(counts).groupBy("_range").count().collect()]
    assert sum(sizes) == 20_001 and len(sizes) >= binary.FEWEST_RANGES // 2
    assert max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_one_class_nan_scores_and_no_rows(spark):
    one = binary.binary_metrics(rows_of(spark, [1, 1], [0.2, 0.7]), "y", "score").first()
    assert math.isnan(one["roc_auc"]) and math.isnan(one["pr_auc"])
    assert (one["mcc"], one["precision"], one["recall"]) == (0.0, 1.0, 0.5)
    # A NaN score is never at or above a threshold.
    nan = rows_of(spark, [1, 0, 1], [math.nan, math.nan, 0.9])
    counts = binary.confusion(nan, "y", "score", 0.5).first().asDict()
    assert counts == {"tn": 1, "fp": 0, "fn": 1, "tp": 1}
    metrics = binary.binary_metrics(nan, "y", "score").first()
    assert [metrics[c] for c in ("tn", "fp", "fn", "tp")] == [1, 0, 1, 1]
    assert thresholds.sweep(nan, "y", "score", [0.5]).first()["fn"] == 1
    # Rows without truth or score do not count anywhere.
    gaps = nan.unionByName(spark.createDataFrame([(None, 0.9), (1, None)], nan.schema))
    assert binary.confusion(gaps, "y", "score", 0.5).first().asDict() == counts
    assert [binary.binary_metrics(gaps, "y", "score").first()[c] for c in ("tn", "fp", "fn", "tp")] == [1, 0, 1, 1]
    swept = thresholds.sweep(gaps, "y", "score", [0.5]).first()
    assert [swept[c] for c in ("tn", "fp", "fn", "tp")] == [1, 0, 1, 1]
    empty = binary.binary_metrics(nan.limit(0), "y", "score").first()
    assert empty["accuracy"] == 0.0 and empty["tp"] == 0 and math.isnan(empty["roc_auc"])


def test_groups_are_independent(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.1), ("b", 0, 0.9), ("b", 0, 0.1)]
    df = spark.createDataFrame(rows, "run string, y int, score double")
    got = {r["run"]: r["roc_auc"] for r in binary.curve_areas(df, "y", "score", ["run"]).collect()}
    assert got == {"a": 1.0, "b": 0.25}


def brute_sweep(y, s, grid):
    out = []
    for t in grid:
        tp = sum(a == 1 and b >= t for a, b in zip(y, s))
        fp = sum(a == 0 and b >= t for a, b in zip(y, s))
        fn, tn = sum(y) - tp, len(y) - sum(y) - fp
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        f = 2 * p * r / (p + r) if p + r else 0.0
        out.append((t, p, r, f, (tp + tn) / len(y), tn, fp, fn, tp))
    return out


def test_fine_grid_is_numpys(spark):
    assert thresholds.fine_grid() == np.arange(0.01, 1.0, 0.005).tolist()


def test_sweep_and_best_threshold(spark):
    grid = thresholds.fine_grid()
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400).tolist()
    s = [grid[i] if i % 2 else float(v) for i, v in zip(rng.integers(0, 198, 400), rng.random(400))]
    swept = thresholds.sweep(rows_of(spark, y, s).repartition(3), "y", "score", grid)
    want = brute_sweep(y, s, grid)
    got = [tuple(r) for r in swept.orderBy("threshold").collect()]
    assert got == [pytest.approx(w) for w in want]
    recalls = [r[2] for r in got]
    assert recalls == sorted(recalls, reverse=True)
    for target in (0.5, 0.9, 0.99):
        best = None
        for m in want:
            if m[2] >= target and (best is None or m[1] > best[1]):
                best = m
        row = thresholds.best_for_recall(swept, target).collect()
        assert (tuple(row[0]) if row else None) == best
    assert thresholds.best_for_recall(swept, 1.1).isEmpty()


def test_transfer(spark):
    rows = [("val", 1, 0.9), ("val", 0, 0.3), ("val", 1, 0.6), ("test", 1, 0.2), ("test", 0, 0.7), ("test", 1, 0.8)]
    df = spark.createDataFrame(rows, "split string, y int, score double")
    swept = thresholds.sweep(df, "y", "score", thresholds.fine_grid(), ["split"])
    row = thresholds.transfer(swept, 0.9, "split", "val", "test").first()
    assert row["threshold"] == pytest.approx(0.305) and row["precision"] == 1.0
    assert (row["check_recall"], row["check_fn"], row["check_fp"], row["transfers"]) == (0.5, 1, 1, False)


def macro(y, pred, classes):
    out = []
    for c in classes:
        tp = sum(a == b == c for a, b in zip(y, pred))
        n, m = y.count(c), pred.count(c)
        out.append((tp / m if m else 0.0, tp / n if n else 0.0, 2 * tp / (n + m) if n + m else 0.0, n))
    return out


def test_multiclass(spark):
    rng = np.random.default_rng(3)
    # Class 4 is never true, class 3 never predicted.
    probs = rng.dirichlet(np.ones(5), 200)
    probs[:, 3] = 0.0
    y = rng.integers(0, 4, 200).tolist()
    df = spark.createDataFrame([(a, p.tolist()) for a, p in zip(y, probs)], "y int, probs array<double>")
    pred = probs.argmax(1).tolist()
    got = multiclass.multiclass_metrics(df, "y", "probs", 5).first().asDict()
    table = macro(y, pred, range(5))
    assert got["accuracy"] == got["micro_f1"] == pytest.approx(np.mean(np.array(y) == pred))
    assert got["macro_f1"] == pytest.approx(np.mean([t[2] for t in table]))
    assert got["weighted_f1"] == pytest.approx(sum(t[2] * t[3] for t in table) / 200)
    top = np.argsort(-probs, axis=1, kind="stable")[:, :3]
    assert got["top3_accuracy"] == pytest.approx(np.mean([a in r for a, r in zip(y, top)]))
    names = documents.dictionary(spark, ["a", "b" * 40, "c", "d", "e", "never"])
    report = multiclass.class_report(multiclass.cells(df, "y", "probs"), names)
    rows = report.orderBy("class_id").collect()
    assert [tuple(r)[2:] for r in rows[:5]] == [pytest.approx(t) for t in table]
    assert tuple(rows[5])[2:] == (0.0, 0.0, 0.0, 0)
    lines = [r["line"] for r in multiclass.report_lines(report).orderBy("line_no").collect()]
    assert len(lines) == 8 and len(lines[1]) == len(lines[0]) == 71
    assert lines[3].startswith("b" * 33 + " ") and lines[3].endswith(f"{y.count(1):>10}")
    full = {r["name"]: r for r in multiclass.full_report(multiclass.cells(df, "y", "probs"), names).collect()}
    assert full["macro avg"]["f1"] == pytest.approx(sum(t[2] for t in table) / 6)
    assert full["accuracy"]["f1"] == got["accuracy"] and full["weighted avg"]["support"] == 200


def test_few_classes_limit_k(spark):
    df = spark.createDataFrame([(0, [0.4, 0.6]), (1, [0.4, 0.6])], "y int, probs array<double>")
    got = multiclass.multiclass_metrics(df, "y", "probs", num_labels=2, top_k=3).first().asDict()
    assert got["top2_accuracy"] == 1.0 and "top3_accuracy" not in got
    # Macro F1 only counts classes that occur.
    assert got["macro_f1"] == pytest.approx((0 + 2 / 3) / 2)


def test_losses_and_agreement(spark):
    df = spark.createDataFrame([(0, [0.8, 0.2]), (1, [0.5, 0.5]), (1, [1.0, 0.0])], "y int, probs array<double>")
    nll = [-math.log(0.8), -math.log(0.5), -math.log(1e-12)]
    assert multiclass.cross_entropy(df, "y", "probs").first()["loss"] == pytest.approx(sum(nll) / 3)
    weights = spark.createDataFrame([(0, 3.0), (1, 0.5)], "class_id int, weight double")
    want = (3 * nll[0] + 0.5 * nll[1] + 0.5 * nll[2]) / 4
    assert multiclass.cross_entropy(df, "y", "probs", weights).first()["loss"] == pytest.approx(want)
    gold = spark.createDataFrame([(1, 1), (0, 1), (1, None)], "label int, gold int")
    assert multiclass.gold_agreement(gold, "label", "gold").first().asDict() == {"correct": 1, "total": 2, "agreement": 0.5}
    batches = spark.createDataFrame([(1, 2.0, 3), (1, 4.0, 1), (2, 5.0, 2)], "epoch int, loss double, size long")
    means = {r["epoch"]: r["mean_loss"] for r in multiclass.mean_loss(batches, ["epoch"]).collect()}
    assert means == {1: 2.5, 2: 5.0}


def test_metric_line(spark):
    df = spark.createDataFrame([(0.5, 7)], "f1 double, tp long")
    assert df.select(rates.metric_line("f1", "#tp").alias("l")).first()["l"] == "f1=0.5000 | tp=7"
    assert rates.rate_line({"f1": 0.5, "tp": 7}) == "f1=0.5000 | tp=7"
    assert df.select(binary.at_least(F.lit(float("nan")), F.lit(0.5)).alias("x")).first()["x"] is False
