"""Positions in a global order without a global window.

A window without partitions runs in one task. Here the order is cut into
buckets of a bounded number of rows. Rows are ranked inside their bucket and
shifted by the rows in the buckets before it, which are summed level by level:
buckets within their parent, parents within theirs. Each sum sees a bounded
number of children whether the keys are dense or spread over all 64 bits, and
only the coarsest level, at most 65,536 rows, is summed in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

# A unique `ord` puts at most 2**14 rows into one bucket, at most 2**18 buckets
# into one parent and 2**16 of these into the next.
ORD_BITS, PARENT_BITS, TOP_BITS = 14, 32, 48
# Five hex digits: about a million buckets, evenly filled because the key is a
# hash, in 256 parents.
HASH_DIGITS, HASH_PARENT = 5, 2
# Slices a pass of `keys_at` counts, and rows it sorts at the end.
SLICES, LEAF_ROWS = 1 << 14, 1 << 14


@dataclass(frozen=True)
class Levels:
    """A bucket that never decreases along an order, and its coarser parents,
    from the coarsest on, as functions of the bucket."""

    bucket: Column
    parents: tuple[Callable[[Column], Column], ...]


def ord_levels(order: Column) -> Levels:
    """Of a unique long."""
    return Levels(
        F.shiftright(order.cast("long"), ORD_BITS),
        (
            lambda b: F.shiftright(b, TOP_BITS - ORD_BITS),
            lambda b: F.shiftright(b, PARENT_BITS - ORD_BITS),
        ),
    )


def hash_levels(hex_hash: Column) -> Levels:
    """Of a hash in hex."""
    return Levels(F.substring(hex_hash, 1, HASH_DIGITS), (lambda b: F.substring(b, 1, HASH_PARENT),))


def falling_levels(n: Column, order: Column) -> Levels:
    """Of a falling number, as a count, ties by a unique long. Counts add up to
    the rows counted, so there are few different ones."""
    return Levels(
        F.struct((-n).alias("n"), F.shiftright(order.cast("long"), ORD_BITS).alias("o")),
        (
            lambda b: F.shiftright(b["n"], 20),
            lambda b: b["n"],
            lambda b: F.struct(b["n"].alias("n"), F.shiftright(b["o"], PARENT_BITS - ORD_BITS).alias("o")),
        ),
    )


def hash_place(hex_hash: Column) -> Column:
    """The first 60 bits of a hash in hex, as a long."""
    return F.conv(F.substring(hex_hash, 1, 15), 16, 10).cast("long")


def seeded_hash(seed: int, key: Column) -> Column:
    """A reproducible random sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def rows_before(sizes: DataFrame, parents: Sequence[Callable[[Column], Column]], by: Sequence[str] = ()) -> DataFrame:
    """Add ``_before``, the rows of all smaller buckets, to a table of bucket
    sizes ``_bucket, _n``: at each level the rows before a node within its
    parent, plus those before the parent."""
    nodes = [f"_p{k}" for k in range(len(parents))]
    table = sizes.withColumns({name: parent(F.col("_bucket")) for name, parent in zip(nodes, parents, strict=True)})
    above: DataFrame | None = None
    for k, node in enumerate([*nodes, "_bucket"]):
        up = nodes[k - 1 : k] if k else []
        level = table if node == "_bucket" else table.groupBy(*by, *up, node).agg(F.sum("_n").alias("_n"))
        earlier = Window.partitionBy(*by, *up).orderBy(node).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        if above is not None:
            level = level.join(above.withColumnRenamed("_before", "_above"), [*by, *up])
            level = level.withColumn("_before", F.col("_before") + F.col("_above"))
        above = level.select(*by, node, "_before")
    return above


def ranked(
    df: DataFrame,
    order: Sequence[Column],
    levels: Levels,
    by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """Add the 1-based position along ``order``, per non-null ``by`` value. A
    row whose order is null is an error.

    The join with the bucket sizes reuses the partitioning of the window, so
    the rows are shuffled once.
    """
    bucket = levels.bucket
    known = F.when(bucket.isNull(), F.raise_error("a row without a place in the order")).otherwise(bucket)
    keyed = df.withColumn("_bucket", known)
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        keyed.withColumn("_local", F.row_number().over(inside))
        .join(rows_before(sizes, levels.parents, by), [*by, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .select(*df.columns, name)
    )


def keys_at(
    df: DataFrame, keys: Sequence[str], place: Column, positions: Callable[[int], Sequence[int]]
) -> tuple[int, list[Row | None]]:
    """Row count and the key rows at the 1-based positions of a row count.

    ``place`` is a long that never decreases along ``keys``. A position below 1
    or past the end gives None. The first pass counts the rows and finds the
    ends of their places. Each further pass cuts the range around a position
    into equal slices and counts them, until a slice has few enough rows to
    sort or a single place; so dense keys take one such pass and any others
    few, and the driver never holds more than the slices of one.
    """
    keyed = df.select(*keys, place.alias("_place"))
    whole = keyed.agg(
        F.count(F.lit(1)).alias("n"), F.min("_place").alias("low"), F.max("_place").alias("high"),
        F.count_if(F.col("_place").isNull()).alias("lost"),
    ).first()
    if whole["lost"]:
        raise ValueError(f"{whole['lost']} rows without a place in the order of {', '.join(keys)}")
    total = whole["n"]
    at = list(positions(total))
    # Each open range: first and last place, rows before it, rows in it.
    ranges = {p: (whole["low"], whole["high"], 0, total) for p in at if 1 <= p <= total}
    while True:
        wide = {r for r in ranges.values() if r[3] > LEAF_ROWS and r[1] > r[0]}
        if not wide:
            break
        for low, high, before, _ in wide:
            width = (high - low) // SLICES + 1
            # The distance of far ends does not fit a long.
            far = [F.lit(x).cast("decimal(20,0)") for x in (low, width)]
            cut = F.call_function("div", F.col("_place").cast("decimal(20,0)") - far[0], far[1])
            inside = keyed.filter(F.col("_place").between(low, high))
            counts = {r["s"]: r["n"] for r in inside.groupBy(cut.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
            seen = before
            for s in sorted(counts):
                here = (low + s * width, min(high, low + (s + 1) * width - 1), seen, counts[s])
                seen += counts[s]
                for p, r in ranges.items():
                    if r[:3] == (low, high, before) and here[2] < p <= seen:
                        ranges[p] = here
    found = {}
    for low, high, before, _ in set(ranges.values()):
        mine = [p - before for p, r in ranges.items() if r[:3] == (low, high, before)]
        inside = keyed.filter(F.col("_place").between(low, high))
        rows = inside.orderBy(*keys).limit(max(mine)).collect()
        found |= {before + k: rows[k - 1] for k in mine}
    return total, [found.get(p) for p in at]


def not_after(keys: Sequence[str], cut: Row) -> Column:
    """``keys <= cut`` in lexicographic order, as plain comparisons."""
    result = F.lit(True)
    for key in reversed(keys):
        here = F.col(key)
        result = (here < F.lit(cut[key])) | ((here == F.lit(cut[key])) & result)
    return result
