"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.staging import in_few_tasks, stage


def own_exchange(column: str):
    """The same value as a fresh expression. A side that has just been grouped
    by ``column`` is then shuffled again for the join, so both sides come
    straight from an exchange and a hub's rows can be split at run time."""
    return F.col(column).bitwiseXOR(F.lit(0).cast("long")).alias(column)


def is_star_forest(now: DataFrame, rows: int) -> bool:
    """Whether each ``hi`` has one ``lo``, and no ``lo`` is a ``hi``."""
    ends = now.select(F.col("hi").alias("node"), F.lit(1).alias("up")).union(now.select("lo", F.lit(0)))
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return not in_few_tasks(per_node.filter("up > 0 and n > 1"), rows).agg(F.count("*")).first()[0]


def small_star(now: DataFrame, rows: int) -> DataFrame:
    """Each node's smaller neighbours, and itself, go to the least of them."""
    least = now.groupBy("hi").agg(F.min("lo").alias("m"))
    return in_few_tasks(
        now.join(least.select(own_exchange("hi"), "m"), "hi")
        .filter("lo > m")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .union(least.select("hi", F.col("m").alias("lo")))
        .distinct(),
        rows,
    )


def large_star(now: DataFrame, rows: int) -> DataFrame:
    """Each node's larger neighbours go to the least of all and itself."""
    both = now.select("hi", "lo").union(now.select(F.col("lo"), F.col("hi")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
    return in_few_tasks(
        both.join(least.select(own_exchange("hi"), "m"), "hi")
        .filter("lo > hi")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .distinct(),
        rows,
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node long, component long``: the smallest node each node reaches.

    Nodes without an edge are absent; self loops and nulls are ignored. Small
    and large stars alternate until every component is one star about its
    smallest node; stars to begin with take the fewest steps. ``edges`` are read
    twice. Each step is written to the shared folder, so lineage stays short and
    a lost executor costs at most one step. A hub is only ever the key of a
    partial minimum or of one side of a join whose other side has one row per
    key. No step has more edges than the one before.
    """
    rows = edges.count()
    now = stage(
        in_few_tasks(
            edges.select(
                F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")
            )
            .filter("hi > lo")
            .distinct(),
            rows,
        )
    )
    steps = 0
    while not is_star_forest(now, rows):
        now = stage((large_star if steps % 2 else small_star)(now, rows))
        steps += 1
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
