"""Leakage-safe splits and seeded samples.

Both are fitted: one small job finds the hash value at which the order has to
be cut, after which assigning rows is a comparison on each row. No row of the
corpus is shuffled, so a group that holds a third of all rows costs nothing.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tagloom.functions.text import text_or_none
from tagloom.operators.ordering import (
    falling_levels,
    hash_levels,
    hash_place,
    keys_at,
    not_after,
    ord_levels,
    ranked,
    seeded_hash,
)

SPLITS = ("train", "val", "test")
# Groups whose shuffled order may be rebuilt on the driver, see `shuffle_split`.
DRIVER_GROUPS = 2_000_000


def cut_positions(total: int, train: float, val: float) -> list[int]:
    """Last position of train and of val; products are truncated, and test
    takes what is left."""
    n_train = int(total * train)
    return [n_train, n_train + int(total * val)]


@dataclass(frozen=True)
class GroupSplit:
    """Cut points of a fitted split. Equal groups always get equal splits."""

    seed: int
    group: str
    groups: int
    train_cut: Row | None
    val_cut: Row | None

    def column(self) -> Column:
        key = text_or_none(F.col(self.group))
        digest = seeded_hash(self.seed, key)

        def upto(cut: Row | None) -> Column:
            if cut is None:
                return F.lit(False)
            same = (digest == F.lit(cut["_hash"])) & (key <= F.lit(cut["_key"]))
            return (digest < F.lit(cut["_hash"])) | same

        return (
            F.when(upto(self.train_cut), F.lit("train"))
            .when(upto(self.val_cut), F.lit("val"))
            .otherwise(F.lit("test"))
        )

    def assign(self, df: DataFrame, name: str = "split") -> DataFrame:
        return df.withColumn(name, self.column())


def fit_group_split(
    df: DataFrame, group: str = "group_id", train: float = 0.8, val: float = 0.1, seed: int = 42
) -> GroupSplit:
    """Order the distinct groups by a seeded hash and find the two cuts. Rows
    without a group form one group."""
    keys = df.select(text_or_none(F.col(group)).alias("_key")).distinct()
    groups = keys.withColumn("_hash", seeded_hash(seed, F.col("_key")))
    total, cuts = keys_at(
        groups, ["_hash", "_key"], hash_place(F.col("_hash")), lambda n: cut_positions(n, train, val)
    )
    return GroupSplit(seed, group, total, cuts[0], cuts[1])


def shuffle_split(
    df: DataFrame,
    group: str = "group_id",
    train: float = 0.8,
    val: float = 0.1,
    seed: int = 42,
    order: str = "ord",
    place: str | None = None,
) -> DataFrame:
    """Split membership as a seeded ``random.shuffle`` of the first-seen group
    list gives it, for comparing with splits made that way.

    The shuffle moves positions only, so the driver permutes the numbers
    0..n-1 and never sees a group. That needs n to fit the driver: beyond
    ``DRIVER_GROUPS`` use :func:`fit_group_split`, which has no such limit.
    ``place`` names a column for the group's position in the shuffled list.
    """
    seen = df.groupBy(group).agg(F.min(order).alias("_first"))
    total = seen.count()
    if total > DRIVER_GROUPS:
        raise ValueError(f"{total} groups exceed {DRIVER_GROUPS}; use fit_group_split")
    positions = list(range(total))
    random.Random(seed).shuffle(positions)
    n_train, n_val = int(total * train), int(total * val)
    names = ["train"] * n_train + ["val"] * n_val + ["test"] * (total - n_train - n_val)
    placed = df.sparkSession.createDataFrame(
        [(p + 1, i, s) for i, (p, s) in enumerate(zip(positions, names))],
        "_rank long, _place long, split string",
    )
    numbered = ranked(seen, [F.col("_first")], ord_levels(F.col("_first")), name="_rank")
    by_group = numbered.join(placed, "_rank").select(group, "_place", "split")
    extra = [F.col("_place").alias(place)] if place else []
    by_group = by_group.withColumnRenamed(group, "_of")
    same = F.col(group).eqNullSafe(F.col("_of"))
    return df.join(by_group, same).select(*[df[c] for c in df.columns], "split", *extra)


def shuffle_sample(
    df: DataFrame, limit: int | None, seed: int, place: str, order: str = "ord"
) -> DataFrame:
    """The rows a seeded ``random.sample`` takes from the list of rows ordered
    by group ``place`` and then ``order``. The driver draws ``limit`` row
    numbers, at most ``DRIVER_GROUPS`` of them."""
    total = df.count() if limit is not None else 0
    if limit is None or total <= limit:
        return df
    if limit > DRIVER_GROUPS:
        raise ValueError(f"a sample of {limit} exceeds {DRIVER_GROUPS}; use sample_rows")
    picks = random.Random(seed).sample(range(total), limit)
    chosen = df.sparkSession.createDataFrame([(p + 1,) for p in picks], "_rank long")
    levels = falling_levels(-F.col(place), F.col(order))
    numbered = ranked(df, [F.col(place), F.col(order)], levels, name="_rank")
    return numbered.join(chosen, "_rank").select(*df.columns)


def split_overlap(df: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups that occur in two splits, per pair of splits: all zero if sound."""
    flags = [F.max((F.col(split) == s).cast("int")).alias(s) for s in SPLITS]
    per_group = df.groupBy(group).agg(*flags)
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1:]]
    return per_group.agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_{b}") for a, b in pairs],
    )


def sample_rows(df: DataFrame, limit: int | None, seed: int, order: str = "ord") -> DataFrame:
    """A uniform sample without replacement of at most ``limit`` rows, chosen
    by the lowest seeded hashes of the unique ``order``."""
    if limit is None:
        return df
    if limit <= 0:
        return df.limit(0)
    keyed = df.withColumn("_hash", seeded_hash(seed, F.col(order)))
    keys = ["_hash", order]
    total, (cut,) = keys_at(keyed, keys, hash_place(F.col("_hash")), lambda n: [limit])
    if total <= limit or cut is None:
        return df
    return keyed.filter(not_after(keys, cut)).drop("_hash")


def first_rows(df: DataFrame, limit: int | None, order: str = "ord") -> DataFrame:
    """The first ``limit`` rows along a unique order, without a global sort."""
    if not limit:
        return df
    total, (cut,) = keys_at(df, [order], F.col(order).cast("long"), lambda n: [limit])
    if total <= limit or cut is None:
        return df
    return df.filter(not_after([order], cut))


def epoch_order(df: DataFrame, seed: int, epoch: int, order: str = "ord") -> DataFrame:
    """Rows in a reproducible random order, one order per epoch, with their
    ``position``. Sorting by it is left to the reader."""
    hashed = df.withColumn("_hash", seeded_hash(seed, F.concat_ws(":", F.lit(epoch), F.col(order))))
    keys: Sequence[Column] = [F.col("_hash"), F.col(order)]
    numbered = ranked(hashed, keys, hash_levels(F.col("_hash")), name="position")
    return numbered.drop("_hash")
