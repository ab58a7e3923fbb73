"""Quality classifier: regularised quadratic discriminant analysis (operator 11).

A document is a vector of transformed statistics of its whole text. Each label
has a Gaussian: its mean and a covariance shrunk first towards the covariance
both labels share, then towards the identity. How far is chosen by
cross-validation. A score is the logistic function of the difference of the two
log-densities, whose Mahalanobis terms use the inverse Cholesky factors that
the model keeps.

The labelled rows only leave sums and products per label and fold, so learning
takes all of them at any size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tagloom.llm.words import remainder
from tagloom.operators.staging import stage

STATISTICS = (
    "words", "word_length", "distinct", "distinct_pairs", "top_word", "repeated_lines", "line_words",
    "sentence_ends", "capitals", "symbols", "marks", "digits", "wide", "entropy",
)
SIZE = len(STATISTICS)
FOLDS = 5
# Shares of the common covariance, and of the identity, that are tried.
TOWARDS_COMMON = (0.0, 0.05, 0.2, 0.5, 1.0)
TOWARDS_IDENTITY = (0.001, 0.01, 0.05, 0.2)
# Log-odds beyond this say no more; one wrong sure row does not decide a fit.
MOST_LOG_ODDS = 30.0

_bytes = np.arange(256)
_is = {
    "symbols": np.isin(_bytes, list(b"#*$%&|<>")),
    "ends": np.isin(_bytes, list(b".!?")),
    "digits": np.isin(_bytes, list(b"0123456789")),
    "upper": (_bytes >= 65) & (_bytes <= 90),
    "lower": (_bytes >= 97) & (_bytes <= 122),
    "space": np.isin(_bytes, [32, 9, 10, 11, 12, 13]),
    "points": (_bytes & 0xC0) != 0x80,
    "wide": _bytes >= 0xC0,
}
_is["marks"] = (_bytes > 32) & (_bytes < 127) & ~(
    _is["symbols"] | _is["ends"] | _is["digits"] | _is["upper"] | _is["lower"]
)


def angle(part: float, whole: float) -> float:
    """Arc sine of the root of a share, which evens out its variance."""
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole > 0 else 0.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics; a text without words has zeros but for its
    character shares, a null text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = {k: int(counts[v].sum()) for k, v in _is.items()}
    words = raw.split()
    uses = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    inside = n["points"] - n["space"]
    letters = n["upper"] + n["lower"]
    shares = counts[counts > 0] / max(1, len(raw))
    return [
        float(np.log1p(len(words))),
        float(np.log1p(inside / len(words))) if words else 0.0,
        # Texts repeat words as they grow: a power law leaves their length out.
        float(np.log(len(uses)) / np.log(len(words))) if len(words) > 1 else 1.0 * bool(words),
        float(np.log(pairs) / np.log(len(words) - 1)) if len(words) > 2 else 1.0 * bool(words),
        angle(max(uses.values(), default=0), len(words)),
        angle(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(len(words) / len(lines))) if lines else 0.0,
        angle(n["ends"], n["ends"] + len(words)),
        angle(n["upper"], letters),
        angle(n["symbols"], n["points"]),
        angle(n["marks"], n["points"]),
        angle(n["digits"], n["points"]),
        angle(n["wide"], n["points"]),
        float(-(shares * np.log2(shares)).sum()),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The statistics of whole texts."""
    for texts in batches:
        yield pd.Series([statistics(t) for t in texts], dtype=object)


@dataclass(frozen=True)
class Moments:
    """Rows of one label, their sums and the sums of their products."""

    n: float
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.products - other.products)

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @property
    def covariance(self) -> np.ndarray:
        return self.products / self.n - np.outer(self.mean, self.mean)


NOTHING = Moments(0.0, np.zeros(SIZE), np.zeros((SIZE, SIZE)))


@dataclass(frozen=True)
class Discriminant:
    """What scoring needs: the scale, and per label a mean, an inverse Cholesky
    factor and a constant. Without rows of both labels ``means`` is empty and
    every score is the share of label 1, one half without any."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    constants: tuple[float, ...]
    share: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            share = min(max(self.share, 1e-9), 1 - 1e-9)
            return np.full(len(x), np.log(share / (1 - share)))
        z = (x - self.centre) / self.scale
        logs = [
            c - 0.5 * (((z - m) @ f.T) ** 2).sum(1)
            for m, f, c in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return np.clip(logs[1] - logs[0], -MOST_LOG_ODDS, MOST_LOG_ODDS)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def fitted(by_label: Sequence[Moments], to_common: float, to_identity: float) -> Discriminant:
    """The discriminant of two labels' moments. A statistic that never varies
    has scale one; the identity's share keeps every covariance invertible."""
    both = by_label[0] + by_label[1]
    share = by_label[1].n / both.n if both.n else 0.5
    if min(m.n for m in by_label) < 1:
        return Discriminant(np.zeros(SIZE), np.ones(SIZE), (), (), (), share)
    spread = np.sqrt(np.maximum(np.diag(both.covariance), 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    covs = [m.covariance / np.outer(scale, scale) for m in by_label]
    common = sum(m.n * c for m, c in zip(by_label, covs, strict=True)) / both.n
    means, factors, constants = [], [], []
    for m, own in zip(by_label, covs, strict=True):
        cov = (1 - to_common) * own + to_common * common
        cov = (1 - to_identity) * (cov + cov.T) / 2 + to_identity * np.eye(SIZE)
        root = np.linalg.cholesky(cov)
        means.append((m.mean - both.mean) / scale)
        factors.append(np.linalg.solve(root, np.eye(SIZE)))
        constants.append(float(np.log(m.n / both.n) - np.log(np.diag(root)).sum()))
    return Discriminant(both.mean, scale, tuple(means), tuple(factors), tuple(constants), share)


def moments(examples: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments by label and fold, in one aggregate: ``label, fold, weight, x``.

    The driver receives one row of sums per label and fold.
    """
    at = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    x = [F.get("x", F.lit(i)) for i in range(SIZE)]
    rows = (
        examples.groupBy("label", "fold")
        .agg(
            F.sum("weight").alias("n"),
            F.array(*[F.sum(x[i] * F.col("weight")) for i in range(SIZE)]).alias("s"),
            F.array(*[F.sum(x[i] * x[j] * F.col("weight")) for i, j in at]).alias("p"),
        )
        .collect()
    )
    out = {}
    for row in rows:
        products = np.zeros((SIZE, SIZE))
        for (i, j), v in zip(at, row["p"], strict=True):
            products[i, j] = products[j, i] = v
        out[row["label"], row["fold"]] = Moments(float(row["n"]), np.array(row["s"]), products)
    return out


def losses(examples: DataFrame, models: Sequence[Sequence[Discriminant]]) -> np.ndarray:
    """Weighted log losses, ``models[k][f]`` judged on fold ``f`` only. Tasks
    pass on one sum per model."""
    n = len(models)
    arrow = pa.schema([("k", pa.int32()), ("loss", pa.float64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in source:
            if not batch.num_rows:
                continue
            x = batch.column(3).flatten().to_numpy().reshape(-1, SIZE)
            label, fold, weight = (batch.column(i).to_numpy() for i in range(3))
            sign = np.where(label == 1, 1.0, -1.0)
            for f in np.unique(fold):
                rows = fold == f
                for k in range(n):
                    odds = models[k][f].log_odds(x[rows]) * sign[rows]
                    total[k] += (weight[rows] * np.logaddexp(0, -odds)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total)], schema=arrow)

    ordered = examples.select(F.col("label").cast("int"), F.col("fold").cast("int"), F.col("weight").cast("double"), "x")
    found = ordered.mapInArrow(run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    out = np.zeros(n)
    for row in found:
        out[row["k"]] = row["loss"]
    return out


def learned(examples: DataFrame) -> Discriminant:
    """The discriminant whose shrinkage loses least on rows it did not see;
    ties take less of the identity, then less of the common covariance."""
    found = moments(examples)
    folds = [[found.get((label, f), NOTHING) for f in range(FOLDS)] for label in (0, 1)]
    whole = [sum(parts, NOTHING) for parts in folds]
    choices = [(c, i) for i, c in product(TOWARDS_IDENTITY, TOWARDS_COMMON)]
    if min(m.n for m in whole) < 1:
        return fitted(whole, *choices[0])
    models = [
        [fitted([whole[k] - folds[k][f] for k in (0, 1)], *choice) for f in range(FOLDS)] for choice in choices
    ]
    return fitted(whole, *choices[int(np.argmin(losses(examples, models)))])


def scored(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id",
    text: str = "text", label: str = "quality", threshold: float = 0.5,
) -> DataFrame:
    """The ids with ``held_out``, ``score`` and ``predicted``, one row per document.

    ``held_out`` is an expression on the documents; labels of such rows are
    never read. A label other than 0 and 1, a null one and one of no document
    teach nothing; a document labelled more than once counts once per label
    row, and a repeated id counts each of its texts. Null and empty texts are
    scored like any other. With one label only, every score is that label's
    share; without any, one half. An empty table gives an empty one.
    """
    rows = stage(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.coalesce(held_out, F.lit(False)).alias("held_out"),
            described(text).alias("x"),
        )
    )
    told = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id", "label")
        .agg(F.count("*").alias("weight"))
    )
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    examples = stage(
        rows.filter("not held_out").join(told, "doc_id").select("label", fold.alias("fold"), "weight", "x")
    )
    model = learned(examples)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.scores(np.stack(x.to_list())) if len(x) else [], dtype="float64")

    return (
        rows.withColumn("score", score("x"))
        .select("doc_id", "held_out", "score")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def op11_quadratic_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels, remainder(F.col("doc_id"), 3) == 1)
