"""Per-row score vectors (``array<double>`` of length K, index = class id)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.binding import bind

# Fixed value: probabilities are raised to this floor before taking a log.
LOG_FLOOR = 1e-12
# Fixed value: floor of the mask sum in mean pooling.
MASK_FLOOR = 1e-9


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Probabilities, shifted by the row maximum so that exp cannot overflow."""

    def scale(exps: Column) -> Column:
        return bind(total(exps), lambda s: F.transform(exps, lambda e: e / s))

    def shifted(z: Column) -> Column:
        return bind(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp(x - m)))

    return bind(logits.cast("array<double>"), lambda z: bind(shifted(z), scale))


def positive_probability(safe: Column, positive: Column) -> Column:
    """Two-class softmax of the second logit, in plain code-generated arithmetic."""
    low, high = safe.cast("double"), positive.cast("double")
    top = F.greatest(low, high)
    return F.exp(high - top) / (F.exp(low - top) + F.exp(high - top))


def log_probabilities(probs: Column) -> Column:
    """Logits equivalent to the given probabilities (softmax ignores shifts)."""
    return F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(LOG_FLOOR))))


def argmax(scores: Column) -> Column:
    """Class id of the largest score; ties go to the lowest id."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_classes(probs: Column, k: int) -> Column:
    """``array<struct<id, prob>>`` of the k best, probability down, id up."""
    keyed = F.transform(
        probs, lambda p, i: F.struct((-p).alias("neg"), i.cast("int").alias("id"))
    )
    best = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(best, lambda e: F.struct(e["id"].alias("id"), (-e["neg"]).alias("prob")))


def rank_of(probs: Column, class_id: Column) -> Column:
    """1-based rank of ``class_id`` under the order of :func:`top_classes`;
    null when the vector has no such class."""
    pair = F.struct(F.get(probs, class_id).alias("p"), class_id.alias("c"))
    ahead = bind(
        pair,
        lambda t: F.size(
            F.filter(probs, lambda x, i: (x > t["p"]) | ((x == t["p"]) & (i < t["c"])))
        ),
    )
    return F.when(F.get(probs, class_id).isNotNull(), ahead + 1)


def negative_log_likelihood(probs: Column, class_id: Column) -> Column:
    """Of a probability, which has a floor as its logit was lost on the way;
    :func:`logits_loss` has none. A class outside the vector is an error."""
    return -F.log(F.greatest(_at(probs, class_id), F.lit(LOG_FLOOR)))


def logits_loss(logits: Column, class_id: Column) -> Column:
    """Negative log-likelihood of a class from scores, by log-sum-exp, so that
    scores far apart keep their loss."""
    top = F.array_max(logits)
    shifted = bind(top, lambda m: F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - m)))
    return top + F.log(shifted) - _at(logits, class_id)


def _at(values: Column, class_id: Column) -> Column:
    missing = F.raise_error(F.concat(F.lit("no class "), F.coalesce(class_id.cast("string"), F.lit("null"))))
    return F.coalesce(F.get(values, class_id), missing.cast("double"))


def cls_pooling(hidden: Column) -> Column:
    """The first position's vector."""
    return F.get(hidden, F.lit(0))


def mean_pooling(hidden: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1 (``hidden``: array of vectors)."""
    weighted = F.zip_with(
        hidden,
        mask,
        lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")),
    )
    summed = F.aggregate(
        F.slice(weighted, 2, F.greatest(F.size(weighted) - 1, F.lit(0))),
        F.get(weighted, F.lit(0)),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
    )
    weight = F.greatest(total(F.transform(mask, lambda m: m.cast("double"))), F.lit(MASK_FLOOR))
    return bind(weight, lambda w: F.transform(summed, lambda x: x / w))
