"""Class dictionaries: frequency, long-tail folding, encoding and decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.ordering import falling_levels, ranked

# Fixed values of the label dictionaries.
OTHER = "OTHER"
DETECTION_NAMES = {0: "safe", 1: "vulnerable"}

# A class table is broadcast only up to this many rows (well under 1 MB).
BROADCAST_CLASSES = 10_000


def class_frequency(df: DataFrame, class_col: str, order: str = "ord") -> DataFrame:
    """``class, n, first_ord``: counts, with the first occurrence for ties."""
    return df.groupBy(F.col(class_col).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord")
    )


def class_table(frequency: DataFrame, min_samples: int = 30, top_k: int | None = 40) -> DataFrame:
    """``id, name, n``: kept classes numbered from 0 by count, then by first
    occurrence. Everything else belongs to the id after the last one."""
    kept = frequency.filter(F.col("n") >= min_samples)
    order = [F.col("n").desc(), F.col("first_ord").asc()]
    if top_k:
        best = kept.orderBy(*order).limit(top_k)
        numbered = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:
        numbered = ranked(kept, order, falling_levels(F.col("n"), F.col("first_ord")))
    return numbered.select((F.col("rank") - 1).cast("int").alias("id"), "name", "n")


def with_other(classes: DataFrame) -> DataFrame:
    """The full dictionary ``id, name``, OTHER last."""
    other = classes.agg(F.count(F.lit(1)).cast("int").alias("id")).withColumn("name", F.lit(OTHER))
    return classes.select("id", "name").unionByName(other)


def _class_side(classes: DataFrame, bound: int | None) -> DataFrame:
    """Broadcast only what a known bound keeps small; AQE decides otherwise."""
    return F.broadcast(classes) if bound and bound <= BROADCAST_CLASSES else classes


def encode_labels(
    df: DataFrame, classes: DataFrame, class_col: str, bound: int | None, name: str = "label"
) -> DataFrame:
    """Class name -> id, with the OTHER id for names outside the table.

    ``bound`` is the most rows ``classes`` can have (its ``top_k``), or None.
    """
    lookup = classes.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    other = classes.agg(F.count(F.lit(1)).cast("int")).scalar()
    columns = [c for c in df.columns if c != name]
    return df.join(
        _class_side(lookup, bound), F.col(class_col) == F.col("_name"), "left"
    ).select(*columns, F.coalesce(F.col("_id"), other).alias(name))


def decode_labels(
    df: DataFrame, dictionary: DataFrame, label: str, bound: int | None, name: str = "name"
) -> DataFrame:
    """Id -> class name, falling back to the id as text."""
    lookup = dictionary.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    columns = [c for c in df.columns if c != name]
    return df.join(_class_side(lookup, bound), F.col(label) == F.col("_id"), "left").select(
        *columns, F.coalesce(F.col("_name"), F.col(label).cast("string")).alias(name)
    )


def name_of(class_id: Column, names: Sequence[str]) -> Column:
    """Decode inside an expression when the dictionary is in hand."""
    if not names:
        return class_id.cast("string")
    known = F.get(F.array(*[F.lit(n) for n in names]), class_id)
    return F.coalesce(known, class_id.cast("string"))


def class_count(labels: DataFrame, declared: int, label: str = "label") -> DataFrame:
    """One row ``num_labels``: the declared number, or more if labels exceed it."""
    return labels.agg(
        F.greatest(
            F.lit(declared), F.coalesce(F.max(F.col(label).cast("int")), F.lit(0)) + 1
        ).alias("num_labels")
    )


def label_distribution(df: DataFrame, *by: str, label: str = "label") -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
