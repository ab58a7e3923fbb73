"""Classifier evaluation on scores derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import rates, vectors
from tagloom.operators import balance, binary, multiclass, scoring, thresholds
from tagloom.queries.registry import query, table
from tagloom.sources import documents

NUM_CLASSES = 10
NAMES = [f"class-{i}" for i in range(8)] + ["x" * 40]

# ---- Inputs -------------------------------------------------------------


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class logits from the first ten embedding values."""
    logits = F.slice("embedding", 1, NUM_CLASSES)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("y"), vectors.softmax(logits).alias("probs")
    )


_PROBS = """
    SELECT vec_id, y, list_transform(e, lambda x: x / list_sum(e)) AS probs
    FROM (SELECT vec_id, y, list_transform(z, lambda x: exp(x - list_max(z))) AS e
          FROM (SELECT vec_id, label AS y, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS z
                FROM embeddings))"""
_LONG_PROBS = f"""
    SELECT vec_id, y, unnest(range(10)) AS c, unnest(probs) AS p FROM ({_PROBS})"""
_RANKED_PROBS = f"""
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS r FROM ({_LONG_PROBS})"""
_PREDICTED = f"""
    SELECT vec_id, y, CAST(c AS INTEGER) AS pred FROM ({_RANKED_PROBS}) WHERE r = 1"""


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-class logits and truth from the embeddings."""
    safe, flawed = F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("label") % 2).alias("y"),
        vectors.positive_probability(safe, flawed).alias("score"),
    )


_PAIRS = """
    SELECT vec_id, label % 2 AS y, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS score
    FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)"""


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels scored by text length: many ties, exact arithmetic."""
    lengths = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    known = table(spark, sf_dir, "labels").select("doc_id", "quality")
    half = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8"
    return known.join(lengths, "doc_id").select(
        "doc_id",
        F.when(half, "val").otherwise("test").alias("split"),
        F.col("quality").alias("y"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("score"),
    )


SQL_DOC_SCORES = """
    SELECT doc_id, CASE WHEN left(md5(CAST(doc_id AS VARCHAR)), 1) < '8' THEN 'val' ELSE 'test' END AS split,
           quality AS y, n_chars / (n_chars + CAST(1000.0 AS DOUBLE)) AS score
    FROM labels JOIN documents USING (doc_id)"""


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: returned or not, scored by price; almost all distinct."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("status"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (price / (price + F.lit(30000.0))).alias("score"),
    )


_LINES = """
    SELECT l_linestatus AS status, CAST(l_returnflag = 'R' AS INTEGER) AS y,
           l_extendedprice / (l_extendedprice + CAST(30000.0 AS DOUBLE)) AS score
    FROM lineitem"""

# ---- SQL pieces ---------------------------------------------------------


def _sql_counts(source: str, threshold: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {keys}count(*) FILTER (y = 0 AND score < {threshold}) AS tn,
           count(*) FILTER (y = 0 AND score >= {threshold}) AS fp,
           count(*) FILTER (y = 1 AND score < {threshold}) AS fn,
           count(*) FILTER (y = 1 AND score >= {threshold}) AS tp
    FROM ({source}) {group}"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _sql_rates(counts: str, keys: str = "") -> str:
    keys = f"{keys}, " if keys else ""
    d = {c: f"CAST({c} AS DOUBLE)" for c in ("tn", "fp", "fn", "tp")}
    margin = "sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))".format(**d)
    product = "{tp} * {tn} - {fp} * {fn}".format(**d)
    return f"""
    SELECT {keys}round({_div('tp + tn', 'tp + fp + fn + tn')}, 9) AS accuracy,
           round({_div('tp', 'tp + fp')}, 9) AS precision, round({_div('tp', 'tp + fn')}, 9) AS recall,
           round({_div('2 * tp', '2 * tp + fp + fn')}, 9) AS f1,
           round({_div(product, margin)}, 9) AS mcc, tn, fp, fn, tp
    FROM ({counts})"""


def _sql_areas(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {keys}round(sum(neg * (2 * tp - pos) / 2.0::DOUBLE) / (max(p) * max(n)), 9) AS roc_auc,
           round(sum(pos * tp / (tp + fp)) / max(p), 9) AS pr_auc
    FROM (SELECT {keys}CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
                 CAST(sum(pos) OVER ({part} ORDER BY score DESC) AS DOUBLE) AS tp,
                 CAST(sum(neg) OVER ({part} ORDER BY score DESC) AS DOUBLE) AS fp,
                 CAST(sum(pos) OVER ({part}) AS DOUBLE) AS p, CAST(sum(neg) OVER ({part}) AS DOUBLE) AS n
          FROM (SELECT {keys}score, sum(y) AS pos, sum(1 - y) AS neg FROM ({source}) GROUP BY {keys}score))
    {group}"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


RATES = ["accuracy", "precision", "recall", "f1", "mcc"]
AREAS = ["roc_auc", "pr_auc"]

# ---- Vectors ------------------------------------------------------------


@query(f"SELECT vec_id, CAST(c AS INTEGER) AS class_id, round(p, 9) AS prob FROM ({_LONG_PROBS})")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(spark, sf_dir).select(
        "vec_id", F.posexplode("probs").alias("class_id", "prob")
    ).withColumn("prob", F.round("prob", 9))


@query(f"SELECT vec_id, pred FROM ({_PREDICTED})")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(spark, sf_dir).select("vec_id", vectors.argmax(F.col("probs")).alias("pred"))


@query(f"""
SELECT vec_id, CAST(r AS INTEGER) AS place, CAST(c AS INTEGER) AS class_id, round(p, 9) AS prob
FROM ({_RANKED_PROBS}) WHERE r <= 5""")
def topk_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vectors.top_classes(F.col("probs"), 5)
    return class_scores(spark, sf_dir).select("vec_id", F.posexplode(best).alias("p", "c")).select(
        "vec_id",
        (F.col("p") + 1).alias("place"),
        F.col("c.id").alias("class_id"),
        F.round("c.prob", 9).alias("prob"),
    )


@query(f"SELECT vec_id, CAST(c AS INTEGER) AS class_id, round(ln(greatest(p, 1e-12)), 9) AS logit FROM ({_LONG_PROBS})")
def probs_to_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = vectors.log_probabilities(F.col("probs"))
    return class_scores(spark, sf_dir).select(
        "vec_id", F.posexplode(logits).alias("class_id", "logit")
    ).withColumn("logit", F.round("logit", 9))


@query("""
SELECT vec_id, CAST(d AS INTEGER) AS dim, round(avg(x), 9) AS mean_value, round(max(x) FILTER (t = 0), 9) AS cls_value
FROM (SELECT vec_id, i // 8 AS t, i % 8 AS d, CAST(v AS DOUBLE) AS x, label
      FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))
WHERE t <= label % 8 GROUP BY vec_id, d""")
def pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as eight positions of width eight, some masked out."""
    position = F.sequence(F.lit(0), F.lit(7))
    hidden = F.transform(position, lambda t: F.slice("embedding", t * 8 + 1, 8))
    mask = F.transform(position, lambda t: (t <= F.col("label") % 8).cast("int"))
    shaped = table(spark, sf_dir, "embeddings").select("vec_id", hidden.alias("h"), mask.alias("m"))
    pooled = shaped.select(
        "vec_id",
        F.arrays_zip(
            vectors.mean_pooling(F.col("h"), F.col("m")).alias("mean"),
            vectors.cls_pooling(F.col("h")).alias("cls"),
        ).alias("v"),
    )
    return pooled.select("vec_id", F.posexplode("v").alias("dim", "v")).select(
        "vec_id",
        "dim",
        F.round("v.mean", 9).alias("mean_value"),
        F.round(F.col("v.cls").cast("double"), 9).alias("cls_value"),
    )


# ---- Two classes --------------------------------------------------------


@query(_sql_counts(_PAIRS, "0.5"))
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.confusion(pair_scores(spark, sf_dir), "y", "score")


@query(f"SELECT * FROM ({_sql_rates(_sql_counts(_LINES, '0.5', 'status'), 'status')})")
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = binary.confusion(line_scores(spark, sf_dir), "y", "score", by=["status"])
    return _rounded(binary.with_rates(counts), *RATES)


@query(f"""
SELECT CAST(0.5 AS DOUBLE) AS threshold, * FROM ({_sql_rates(_sql_counts(_PAIRS, '0.5'))}), ({_sql_areas(_PAIRS)})""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = binary.binary_metrics(pair_scores(spark, sf_dir), "y", "score")
    return _rounded(metrics, *RATES, *AREAS)


@query(f"""
SELECT CAST(0.4 AS DOUBLE) AS threshold, *
FROM ({_sql_rates(_sql_counts(_LINES, '0.4', 'status'), 'status')}) JOIN ({_sql_areas(_LINES, 'status')}) USING (status)""")
def binary_metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for several evaluation sets at once, over a long table."""
    metrics = binary.binary_metrics(line_scores(spark, sf_dir), "y", "score", 0.4, by=["status"])
    return _rounded(metrics, *RATES, *AREAS)


@query(_sql_areas(SQL_DOC_SCORES, "split"))
def curve_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC-AUC and average precision where many scores are tied."""
    return _rounded(binary.curve_areas(doc_scores(spark, sf_dir), "y", "score", by=["split"]), *AREAS)


@query(f"""
SELECT score, sum(y) AS pos, sum(1 - y) AS neg,
       CAST(sum(sum(y)) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
       CAST(sum(sum(1 - y)) OVER (ORDER BY score DESC) AS BIGINT) AS fp
FROM ({SQL_DOC_SCORES}) GROUP BY score""".replace("sum(y) AS pos", "CAST(sum(y) AS BIGINT) AS pos").replace(
    "sum(1 - y) AS neg", "CAST(sum(1 - y) AS BIGINT) AS neg"))
def cumulative_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = binary.cumulative_counts(doc_scores(spark, sf_dir), "y", "score")
    return curve.select("score", "pos", "neg", "tp", "fp")


@query(f"""
SELECT split, count(*) AS n, count(*) FILTER (y = 1) AS positives,
       round(avg(CAST(y = 1 AS INTEGER)), 9) AS positive_rate
FROM ({SQL_DOC_SCORES}) GROUP BY split""")
def positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(binary.positive_rate(doc_scores(spark, sf_dir), "y", by=["split"]), "positive_rate")


@query(f"""
SELECT status, 'accuracy=' || printf('%.4f', accuracy) || ' | f1=' || printf('%.4f', f1) || ' | tp=' || tp AS line
FROM ({_sql_rates(_sql_counts(_LINES, '0.5', 'status'), 'status')})""")
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = binary.confusion(line_scores(spark, sf_dir), "y", "score", by=["status"])
    return binary.with_rates(counts).select(
        "status", rates.metric_line("accuracy", "f1", "#tp").alias("line")
    )


# ---- Thresholds ---------------------------------------------------------


def _sql_sweep(source: str, grid: str, by: str) -> str:
    counts = f"""
        SELECT {by}, t AS threshold, count(*) FILTER (y = 0 AND score < t) AS tn,
               count(*) FILTER (y = 0 AND score >= t) AS fp, count(*) FILTER (y = 1 AND score < t) AS fn,
               count(*) FILTER (y = 1 AND score >= t) AS tp
        FROM ({source}), ({grid}) GROUP BY {by}, t"""
    pr = f"""
        SELECT *, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,
               {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM ({counts})"""
    return f"""
    SELECT {by}, threshold, precision, recall, {_div('2 * precision * recall', 'precision + recall')} AS f1,
           accuracy, tn, fp, fn, tp FROM ({pr})"""


_TABLE_GRID = "SELECT unnest([%s]) AS t" % ", ".join(f"CAST({t} AS DOUBLE)" for t in thresholds.TABLE_GRID)
_FINE_GRID = """
    SELECT CAST(0.01 AS DOUBLE) + i * ((CAST(0.01 AS DOUBLE) + CAST(0.005 AS DOUBLE)) - CAST(0.01 AS DOUBLE)) AS t
    FROM range(198) r(i)"""
_SWEPT = ["threshold", "precision", "recall", "f1", "accuracy"]
_SQL_SWEPT = ", ".join(f"round({c}, 9) AS {c}" for c in _SWEPT)


@query(f"SELECT status, {_SQL_SWEPT}, tn, fp, fn, tp FROM ({_sql_sweep(_LINES, _TABLE_GRID, 'status')})")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = thresholds.sweep(line_scores(spark, sf_dir), "y", "score", by=["status"])
    return _rounded(swept, *_SWEPT)


@query(f"SELECT split, {_SQL_SWEPT}, tn, fp, fn, tp FROM ({_sql_sweep(SQL_DOC_SCORES, _FINE_GRID, 'split')})")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 198 thresholds of the fine grid in one pass."""
    swept = thresholds.sweep(doc_scores(spark, sf_dir), "y", "score", thresholds.fine_grid(), ["split"])
    return _rounded(swept, *_SWEPT)


def _sql_best(source: str, by: str, target: float) -> str:
    return f"""
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY precision DESC, threshold) AS rn
        FROM ({_sql_sweep(source, _FINE_GRID, by)}) WHERE recall >= CAST({target} AS DOUBLE))
    WHERE rn = 1"""


SQL_TUNED = _sql_best(SQL_DOC_SCORES, "split", 0.9)


@query(f"SELECT split, {_SQL_SWEPT}, tn, fp, fn, tp FROM ({SQL_TUNED})")
def best_for_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = thresholds.sweep(doc_scores(spark, sf_dir), "y", "score", thresholds.fine_grid(), ["split"])
    return _rounded(thresholds.best_for_recall(swept, 0.9, ["split"]), *_SWEPT)


@query(f"""
SELECT round(b.threshold, 9) AS threshold, round(b.recall, 9) AS recall, round(b.precision, 9) AS precision,
       round(b.f1, 9) AS f1, b.fn, b.fp, round(o.recall, 9) AS check_recall, round(o.precision, 9) AS check_precision,
       round(o.f1, 9) AS check_f1, o.fn AS check_fn, o.fp AS check_fp,
       round(abs(o.recall - b.recall), 9) AS recall_gap, abs(o.recall - b.recall) <= 0.03 AS transfers
FROM ({_sql_best(SQL_DOC_SCORES, 'split', 0.9)}) b
LEFT JOIN ({_sql_sweep(SQL_DOC_SCORES, _FINE_GRID, 'split')}) o ON o.threshold = b.threshold AND o.split = 'test'
WHERE b.split = 'val'""")
def threshold_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold tuned on one split, checked on the other."""
    swept = thresholds.sweep(doc_scores(spark, sf_dir), "y", "score", thresholds.fine_grid(), ["split"])
    moved = thresholds.transfer(swept, 0.9, "split", "val", "test")
    return _rounded(
        moved, "threshold", "recall", "precision", "f1",
        "check_recall", "check_precision", "check_f1", "recall_gap",
    )


# ---- Many classes -------------------------------------------------------

_CLASS_COUNTS = f"""
    SELECT c AS class_id, count(*) FILTER (y = c AND pred = c) AS tp, count(*) FILTER (y = c) AS support,
           count(*) FILTER (pred = c) AS predicted
    FROM ({_PREDICTED}), (SELECT CAST(i AS INTEGER) AS c FROM range(10) r(i)) GROUP BY c"""
_CLASS_RATES = f"""
    SELECT *, {_div('tp', 'predicted')} AS precision, {_div('tp', 'support')} AS recall,
           {_div('2 * tp', 'support + predicted')} AS f1 FROM ({_CLASS_COUNTS})"""


@query(f"""
SELECT round(acc, 9) AS accuracy, round(acc, 9) AS micro_f1, round(macro, 9) AS macro_f1,
       round(weighted, 9) AS weighted_f1, round(top3, 9) AS top3_accuracy
FROM (SELECT avg(CAST(y = pred AS INTEGER)) AS acc FROM ({_PREDICTED})),
     (SELECT avg(f1) FILTER (support + predicted > 0) AS macro, sum(f1 * support) / sum(support) AS weighted
      FROM ({_CLASS_RATES})),
     (SELECT avg(CAST(r <= 3 AS INTEGER)) AS top3 FROM ({_RANKED_PROBS}) WHERE c = y)""")
def multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = multiclass.multiclass_metrics(class_scores(spark, sf_dir), "y", "probs", NUM_CLASSES)
    return _rounded(metrics, *metrics.columns)


@query(f"""
SELECT avg(CAST(r <= 5 AS INTEGER)) AS top5_accuracy, count(*) AS n FROM ({_RANKED_PROBS}) WHERE c = y""")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = multiclass.cells(class_scores(spark, sf_dir), "y", "probs", top_k=5)
    return table_.agg(
        rates.ratio(F.sum("hits"), F.sum("n")).alias("top5_accuracy"), F.sum("n").alias("n")
    )


@query(f"SELECT y, pred, count(*) AS n FROM ({_PREDICTED}) GROUP BY y, pred")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiclass.cells(class_scores(spark, sf_dir), "y", "probs").select("y", "pred", "n")


_NAMED = "SELECT unnest(range(9)) AS id, unnest([%s]) AS name" % ", ".join(f"'{n}'" for n in NAMES)
_REPORT = f"""
    SELECT class_id, name, precision, recall, f1, support
    FROM ({_NAMED}) JOIN ({_CLASS_RATES}) ON id = class_id"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = multiclass.cells(class_scores(spark, sf_dir), "y", "probs")
    return multiclass.class_report(cells, documents.dictionary(spark, NAMES))


@query(f"""
SELECT class_id, name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support
FROM ({_REPORT})""")
def per_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named class; the tables' last class has no name here."""
    return _rounded(_report(spark, sf_dir), "precision", "recall", "f1")


@query(f"""
SELECT class_id AS line_no, printf('%-34s%9.4f%9.4f%9.4f%10d', left(name, 33), precision, recall, f1, support) AS line
FROM ({_REPORT})
UNION ALL SELECT -2, '{multiclass.REPORT_HEADER}' UNION ALL SELECT -1, '{"-" * 71}'""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiclass.report_lines(_report(spark, sf_dir))


@query(f"""
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
    SELECT name, precision, recall, f1, support FROM ({_REPORT})
    UNION ALL SELECT 'micro avg', tp / p, tp / s, 2 * tp / (p + s), s FROM (
        SELECT CAST(count(*) FILTER (WHERE y = pred AND y < 9) AS DOUBLE) AS tp, count(*) FILTER (WHERE pred < 9) AS p,
               count(*) FILTER (WHERE y < 9) AS s FROM ({_PREDICTED}))
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM ({_REPORT})
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                     sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM ({_REPORT}))""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = multiclass.cells(class_scores(spark, sf_dir), "y", "probs")
    full = multiclass.full_report(cells, documents.dictionary(spark, NAMES))
    return _rounded(full, "precision", "recall", "f1")


_NLL = f"SELECT y, -ln(greatest(p, 1e-12)) AS nll FROM ({_LONG_PROBS}) WHERE c = y"


@query(f"""
SELECT round(avg(nll), 9) AS loss, round(sum(w * nll) / sum(w), 9) AS weighted_loss
FROM ({_NLL}) JOIN (
    SELECT label AS y, CAST(sum(count(*)) OVER () AS DOUBLE) / (10 * count(*)) AS w FROM embeddings GROUP BY label)
USING (y)""")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = class_scores(spark, sf_dir)
    weights = balance.class_weights(scored, NUM_CLASSES, "y")
    plain = multiclass.cross_entropy(scored, "y", "probs")
    weighted = multiclass.cross_entropy(scored, "y", "probs", weights)
    return plain.select(
        F.round("loss", 9).alias("loss"), F.round(weighted.scalar(), 9).alias("weighted_loss")
    )


@query("""
SELECT round(avg(m + ln(list_sum(list_transform(z, lambda x: exp(x - m)))) - z[label + 1]), 6) AS loss
FROM (SELECT label, z, list_max(z) AS m FROM (
    SELECT label, list_transform(embedding, lambda x: 1000 * CAST(x AS DOUBLE)) AS z FROM embeddings))""")
def logit_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of whole vectors read as logits, scaled so that they lie far apart."""
    wide = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 1000)
    rows = table(spark, sf_dir, "embeddings").select("label", wide.alias("logits"))
    return multiclass.cross_entropy(rows, "label", "logits", from_logits=True).select(
        F.round("loss", 6).alias("loss")
    )


@query(f"""
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
    WITH r AS (SELECT 'class ' || class_id AS name, precision, recall, f1, support FROM ({_CLASS_RATES}) WHERE class_id < 10)
    SELECT name, precision, recall, f1, support FROM r
    UNION ALL SELECT 'accuracy', NULL, NULL, avg(CAST(y = pred AS INTEGER)), count(*) FROM ({_PREDICTED})
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                     sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r)""")
def classification_report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report where every class seen is named: accuracy over all rows."""
    cells = multiclass.cells(class_scores(spark, sf_dir), "y", "probs")
    names = documents.dictionary(spark, [f"class {i}" for i in range(NUM_CLASSES)])
    return _rounded(multiclass.full_report(cells, names), "precision", "recall", "f1")


# ---- Predictions --------------------------------------------------------


@query(f"""
SELECT vec_id, CAST(score >= 0.45 AS INTEGER) AS label,
       CASE WHEN score >= 0.45 THEN 'vulnerable' ELSE 'safe' END AS verdict,
       round(CASE WHEN score >= 0.45 THEN score ELSE 1 - score END, 9) AS confidence,
       round(1 - score, 9) AS prob_safe, round(score, 9) AS prob_vulnerable, CAST(0.45 AS DOUBLE) AS threshold
FROM ({_PAIRS})""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = vectors.softmax(F.slice("embedding", 1, 2))
    preds = table(spark, sf_dir, "embeddings").select(
        "vec_id", scoring.detection_prediction(both, 0.45).alias("p")
    )
    return _rounded(preds.select("vec_id", "p.*"), "confidence", "prob_safe", "prob_vulnerable")


@query(f"""
SELECT vec_id, CAST(max(c) FILTER (r = 1) AS INTEGER) AS label, max(name) FILTER (r = 1) AS cwe,
       round(max(p), 9) AS confidence, string_agg(name, '>' ORDER BY r) AS candidates
FROM (SELECT vec_id, c, p, r, coalesce(name, CAST(c AS VARCHAR)) AS name
      FROM ({_RANKED_PROBS}) LEFT JOIN ({_NAMED}) ON id = c WHERE r <= 5)
GROUP BY vec_id""")
def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best class and five candidates by name; an unnamed class is its id."""
    preds = class_scores(spark, sf_dir).select(
        "vec_id", scoring.class_prediction(F.col("probs"), NAMES).alias("p")
    )
    return preds.select(
        "vec_id",
        "p.label",
        "p.cwe",
        F.round("p.confidence", 9).alias("confidence"),
        F.array_join(F.transform("p.topk", lambda c: c["cwe"]), ">").alias("candidates"),
    )


@query(f"""
SELECT count(*) FILTER (y = CAST(score >= 0.5 AS INTEGER)) AS correct, count(*) AS total,
       round(avg(CAST(y = CAST(score >= 0.5 AS INTEGER) AS INTEGER)), 9) AS agreement
FROM (SELECT quality AS y, n_chars / (n_chars + CAST(1000.0 AS DOUBLE)) AS score
      FROM documents LEFT JOIN labels USING (doc_id)) WHERE y IS NOT NULL""")
def gold_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents, compared where a label exists."""
    lengths = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    gold = table(spark, sf_dir, "labels").select("doc_id", "quality")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
    predicted = lengths.join(gold, "doc_id", "left").select(
        binary.verdict(score, F.lit(0.5)).alias("label"), F.col("quality").alias("gold")
    )
    return _rounded(multiclass.gold_agreement(predicted, "label", "gold"), "agreement")
