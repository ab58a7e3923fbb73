"""Declared schemas. Nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# One fix commit: the code before and after, and what is known of the flaw.
RAW_FIX = _struct(
    cve_id=_S, hash=_S, repo_url=_S, cwe_id=_S, cwe_name=_S,
    language=_S, vulnerable_code=_S, fixed_code=_S,
)

# One labelled sample. `ord` makes "first occurrence wins" well defined.
RECORD = _struct(
    id=_S, code=_S, label=_I, cwe=_S, cwe_name=_S, source=_S, language=_S,
    project=_S, group_id=_S, code_hash=_S, ord=_L,
)

LABELLED_INPUT = _struct(id=_S, code=_S, label=_I)

BINARY_METRICS = _struct(
    threshold=_D, accuracy=_D, precision=_D, recall=_D, f1=_D, mcc=_D,
    roc_auc=_D, pr_auc=_D, tn=_L, fp=_L, fn=_L, tp=_L,
)

MULTICLASS_METRICS = _struct(
    accuracy=_D, macro_f1=_D, weighted_f1=_D, micro_f1=_D, top1_accuracy=_D,
    top2_accuracy=_D, top3_accuracy=_D,
)


def run_results(metrics: T.StructType = BINARY_METRICS) -> T.StructType:
    """A training run's result document."""
    epoch = _struct(epoch=_I, train_loss=_D, val=metrics)
    return _struct(
        task=_S, source=_S, model=_S, best_epoch=_I,
        history=T.ArrayType(epoch), val=metrics, test=metrics,
    )


LABEL_MAP = _struct(
    task=_S, num_labels=_I,
    id2name=T.MapType(_S, _S), name2id=T.MapType(_S, _I),
)

SPLIT_STATS = _struct(n=_L, label_dist=T.MapType(_S, _L))
CORPUS_STATS = _struct(
    source=_S, total_raw=_L,
    tasks=T.MapType(_S, _struct(num_labels=_I, splits=T.MapType(_S, SPLIT_STATS))),
)

THRESHOLD = _struct(
    threshold=_D, target_recall=_D, tuned_on=_S, recall=_D, precision=_D,
    f1=_D, fn=_L, fp=_L,
)

DETECTION = _struct(
    label=_I, verdict=_S, confidence=_D, prob_safe=_D, prob_vulnerable=_D, threshold=_D,
)
CLASSIFICATION = _struct(
    label=_I, cwe=_S, confidence=_D, topk=T.ArrayType(_struct(cwe=_S, prob=_D)),
)


def predictions(prediction: T.StructType = DETECTION) -> T.StructType:
    """One scored record as written by the batch scorer."""
    return _struct(id=_S, pred=prediction, gold=_I)
