"""Class imbalance: inverse-frequency weights and balanced sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.labels import BROADCAST_CLASSES
from tagloom.operators.ordering import ord_levels, ranked

# Draws of one row are counted in chunks of this many draw numbers, so that a
# row of a rare class, drawn very often, is expanded by many tasks.
DRAW_BITS = 20


def class_weights(df: DataFrame, num_labels: int, label: str = "label") -> DataFrame:
    """``class_id, n, weight`` for every class 0..num_labels-1.

    ``weight = sum(n) / (num_labels * n)``; classes without rows count as one
    row, in the sum too.
    """
    counts = df.groupBy(F.col(label).cast("long").alias("class_id")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    classes = df.sparkSession.range(num_labels).select(F.col("id").alias("class_id"))
    every_class = Window.partitionBy()
    return (
        classes.join(counts, "class_id", "left")
        .withColumn("n", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)))
        .select(
            F.col("class_id").cast("int").alias("class_id"),
            "n",
            (F.sum("n").over(every_class) / (F.lit(float(num_labels)) * F.col("n"))).alias("weight"),
        )
    )


def _hex(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 12), 16, 10).cast("long")


def balanced_sample(
    df: DataFrame, seed: int, label: str = "label", order: str = "ord", expand: bool = False
) -> DataFrame:
    """As many draws with replacement as there are rows, every class equally
    likely and every row equally likely within its class.

    Draw i picks a class and a row number in it from a seeded hash. Draws are
    counted per row before they meet the rows, so the join carries one row per
    distinct pick. The result has a ``draws`` column; with ``expand`` each draw
    is a row of its own instead.
    """
    spark = df.sparkSession
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    # Class ids are dense and few; this is the per-class table, not the data.
    slots = sizes.withColumn("_slot", F.row_number().over(Window.orderBy(label)) - 1)
    shape = slots.agg(
        F.sum("_size").alias("n"), F.count(F.lit(1)).alias("c"), F.count_if(F.col(label).isNull()).alias("unknown")
    ).first()
    if shape["unknown"]:
        raise ValueError(f"{label} is null in some rows; balanced draws need a class for each")
    if not shape["n"]:
        empty = df.limit(0)
        return empty if expand else empty.withColumn("draws", F.lit(0).cast("long"))

    # Twelve hex digits of one hash pick the class, the next twelve the row.
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    draws = (
        spark.range(shape["n"])
        .select("id", digest.alias("_digest"))
        .select(
            (_hex(F.col("_digest"), 1) % shape["c"]).cast("int").alias("_slot"),
            _hex(F.col("_digest"), 13).alias("_u"),
            F.shiftright("id", DRAW_BITS).alias("_chunk"),
        )
    )
    keys = [label, "_row", "_chunk"] if expand else [label, "_row"]
    picks = (
        draws.join(F.broadcast(slots) if shape["c"] <= BROADCAST_CLASSES else slots, "_slot")
        .select(label, (F.col("_u") % F.col("_size") + 1).alias("_row"), "_chunk")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("draws"))
    )
    numbered = ranked(df, [F.col(order)], ord_levels(F.col(order)), by=[label], name="_row")
    drawn = numbered.join(picks, [label, "_row"])
    if not expand:
        return drawn.select(*df.columns, "draws")
    # Chunks of one row go to different tasks before they are multiplied.
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("_copy")
    return drawn.repartition("_chunk", order).select(*df.columns, copies).drop("_copy")
