"""Batches in input order and padding to the longest row of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import tokens
from tagloom.operators.ordering import ord_levels, ranked


def number_batches(df: DataFrame, batch_size: int, order: str = "ord") -> DataFrame:
    """Add ``batch_id``: consecutive chunks of ``batch_size`` rows, the last
    one possibly shorter."""
    if batch_size <= 0:
        raise ValueError(f"batch_size must be positive, got {batch_size}")
    numbered = ranked(df, [F.col(order)], ord_levels(F.col(order)), name="_position")
    batch = F.floor((F.col("_position") - 1) / batch_size).cast("long")
    return numbered.withColumn("batch_id", batch).drop("_position")


def pad_batches(
    df: DataFrame,
    special: tokens.SpecialTokens,
    ids: str = "input_ids",
    multiple: int | None = 8,
) -> DataFrame:
    """Pad ``ids`` to the batch width and add the matching masks.

    A batch has a fixed number of rows, so its window is bounded. Afterwards
    the rows of a batch lie in one partition, ready for the model.
    """
    batch = Window.partitionBy("batch_id")
    width = tokens.padded_width(F.max(F.size(ids)).over(batch), multiple)
    sized = df.withColumn("width", width)
    mask = tokens.pad(tokens.attention_mask(F.col(ids)), F.col("width"), 0)
    padded = sized.withColumn("attention_mask", mask)
    if special.token_type_ids:
        kinds = tokens.pad(tokens.token_type_ids(F.col(ids)), F.col("width"), 0)
        padded = padded.withColumn("token_type_ids", kinds)
    return padded.withColumn(ids, tokens.pad(F.col(ids), F.col("width"), special.pad_id))
