"""Mixing sources to target weights by entropy balancing (operator 5).

Every document starts at a rate of one. The rates that meet each source's
token target, do not pass ``MOST_COPIES`` and lie closest to one in relative
entropy are ``min(MOST_COPIES, exp(lambda * size / mean_size))`` with one
lambda per source: the convex dual has one variable per token constraint and is
separable. Newton steps find all lambdas at once, as Spark aggregates over the
histogram of document sizes, kept inside a bracket by bisection.

Rates become copies by carrying the words that rounding gives or takes on to
the next document, from the longest to the shortest, in bounded shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.llm.words import arrow_schema, free, split_words
from tagloom.operators.staging import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
# Documents rounded together; a larger source is dealt over several shards.
SHARD = 2_000
STEPS = 60
EXACT = "decimal(38,6)"


def sized(docs: DataFrame, id_column: str, source: str, text: str) -> DataFrame:
    """``doc_id, source, size``: words of the whole text, null as none."""
    kind = "doc_id long, source string, size long"
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(split_words(t, lower=False)) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    chosen = docs.select(
        F.col(id_column).cast("long").alias("i"), F.col(source).cast("string").alias("s"), F.col(text).alias("t")
    )
    return chosen.mapInArrow(run, kind)


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, n_docs, mean, target``, one row per source.

    Weights repeat over the sources in code point order, null last. A target
    stops at ``MOST_COPIES`` times its source; the excess is shared by weight
    among the others. A source is capped once the common level passes its cap
    per weight, so raising one number until nothing changes settles them all.
    """
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*map(F.lit, WEIGHTS))
    # One short row per source meets in a single task.
    table = stage(
        sizes.groupBy("source")
        .agg(
            F.sum("size").alias("source_size"),
            F.count("*").alias("n_docs"),
            F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))), F.lit(1.0)).alias("mean"),
        )
        .withColumn("weight", F.get(weights, (F.row_number().over(by_code) - 1) % len(WEIGHTS)))
    )
    cap = F.col("source_size") * F.lit(MOST_COPIES)
    level, seen = 0.0, None
    while True:
        capped = F.when(F.col("weight") * F.lit(level) >= cap, True).otherwise(False)
        row = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count_if(capped).alias("n"),
        ).first()
        if row["n"] == seen or not row["weight"]:
            break
        seen, level = row["n"], (SHARE * row["all"] - row["fixed"]) / row["weight"]
    wanted = F.least(F.col("weight") * F.lit(float(level)), cap.cast("double"))
    return table.select("source", "source_size", "n_docs", "mean", wanted.alias("target"))


def rate(lam: Column, size: Column, mean: Column) -> Column:
    return F.exp(F.least(lam * size / mean, F.lit(math.log(MOST_COPIES))))


def balanced(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Add ``lam`` and ``full`` (all at the most copies) to ``goals``."""
    counts = stage(sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    free = (F.col("target") > 0) & (F.col("target") < MOST_COPIES * F.col("source_size"))
    state = stage(
        goals.select(
            "*", (~free).alias("full"), F.lit(0.0).alias("lam"),
            F.lit(-1e4).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"),
        )
    )
    for _ in range(STEPS):
        if not state.filter("not done and not full").limit(1).count():
            break
        s = state.filter("not done and not full").alias("s")
        r, c = rate(F.col("s.lam"), F.col("h.size"), F.col("s.mean")), F.col("h.size") / F.col("s.mean")
        same = F.col("h.source").eqNullSafe(F.col("s.source"))
        mass, slope = F.col("h.n") * F.col("h.size") * r, F.col("h.n") * F.col("h.size") * c * r
        # Exact sums do not depend on the order of the tasks: reruns agree.
        sums = (
            counts.alias("h").join(s, same).groupBy(F.col("s.source").alias("of"))
            .agg(
                F.sum(mass.cast(EXACT)).cast("double").alias("mass"),
                F.sum(F.when(r < MOST_COPIES, slope).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"),
                F.lit(True).alias("hit"),
            )
        )
        gap = F.col("mass") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - F.try_divide(gap, F.col("slope"))
        inside = F.coalesce((step > low) & (step < high), F.lit(False))
        near = F.abs(gap) <= 1e-7 * F.col("target")
        moved = F.when(near, F.col("lam")).when(inside, step).otherwise((low + high) / 2)
        hit = F.coalesce(F.col("hit"), F.lit(False))
        state = stage(
            state.join(sums, state["source"].eqNullSafe(sums["of"]), "left").select(
                *goals.columns, "full",
                F.when(hit, moved).otherwise(F.col("lam")).alias("lam"),
                F.when(hit, low).otherwise(F.col("low")).alias("low"),
                F.when(hit, high).otherwise(F.col("high")).alias("high"),
                F.when(hit, near).otherwise(F.col("done")).alias("done"),
            )
        )
    return state.select(*goals.columns, "full", F.round("lam", 9).alias("lam"))


def rounded(rates: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Copies per document, longest first; what a document takes too much or
    too little is made up by the next ones."""
    copies, carry = np.zeros(len(rates), np.int64), 0.0
    for i, (r, size) in enumerate(zip(rates.tolist(), sizes.tolist(), strict=True)):
        low = min(int(r), MOST_COPIES)
        want = r * size + carry
        more = low < MOST_COPIES and r > low and want - low * size >= size / 2
        copies[i] = low + more
        carry = want - copies[i] * size
    return copies


def mixed(sizes: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``, one row per
    distinct (doc_id, source, size); rows that repeat all three fare alike.

    Documents without words keep one copy. An empty table gives an empty one.
    """
    goals = balanced(sizes, targets(sizes))
    distinct = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = distinct.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    shards = F.greatest(F.ceil(F.col("n_docs") / SHARD), F.lit(1))
    full = F.when(F.col("target") > 0, F.lit(float(MOST_COPIES))).otherwise(F.lit(0.0))
    wanted = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), full)
    rows = rows.select(
        "doc_id", "source", "size", "n", "source_size", "target",
        wanted.otherwise(rate(F.col("lam"), F.col("size"), F.col("mean"))).alias("rate"),
        F.pmod(F.xxhash64("doc_id", "size"), shards).alias("shard"),
    )

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
        weights = (group["size"] * group["n"]).to_numpy()
        group["copies"] = rounded(group["rate"].to_numpy(), weights)
        return group[["doc_id", "source", "size", "source_size", "target", "copies"]]

    kind = "doc_id long, source string, size long, source_size long, target double, copies long"
    return rows.groupBy("source", "shard").applyInPandas(settle, kind)


def sampled(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: repeated, once, or not at all."""
    sizes = stage(sized(docs, "doc_id", "source", "text"))
    key, origin, copies, copy = free(docs, "_id", "_source", "_copies", "_copy")
    # Rows that share id and source but not their size are taken alike.
    per_id = stage(
        mixed(sizes).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"))
        .agg(F.max("copies").alias(copies))
    )
    d = docs.withColumns({key: F.col("doc_id").cast("long"), origin: F.col("source").cast("string")})
    same = d[key].eqNullSafe(per_id["id"]) & d[origin].eqNullSafe(per_id["of"])
    taken = d.join(per_id, same).filter(F.col(copies) > 0).select(*[d[c] for c in docs.columns], copies)
    again = F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)
    return taken.select(*docs.columns, again).select(*docs.columns)


def op5_entropy_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stage(sized(docs, "doc_id", "source", "text"))
    plan = mixed(sizes)
    s = sizes.alias("s")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "source", "size")]
    return s.join(plan.alias("p"), same[0] & same[1] & same[2]).select(
        "s.doc_id", "s.size", "p.source_size", "p.target", "p.copies",
        (F.col("s.size") * F.col("p.copies")).alias("taken"),
    )
