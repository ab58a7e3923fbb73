"""From fix commits to labelled samples: fan-out, filters and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.operators.staging import stage

SAMPLE_COLUMNS = [
    "id", "code", "label", "cwe", "cwe_name", "source", "language", "project", "group_id", "ord",
]


def fan_out_pairs(raw: DataFrame, source: str, group_parts: tuple[str, ...] = ("cve_id", "hash")) -> DataFrame:
    """One row per fix -> up to two samples, the flawed one first.

    ``raw`` has the RAW_FIX columns and a unique ``ord``; sides that are empty
    after cleaning are left out, and safe samples carry no class.
    """

    def side(name: str, code: str, label: int) -> Column:
        flawed = label == 1
        class_id = text.normalize_class_id(F.col("cwe_id")) if flawed else F.lit("")
        class_name = text.strip(text.blank_if_null(F.col("cwe_name"))) if flawed else F.lit("")
        return F.struct(
            text.sample_id(F.col("cve_id"), name).alias("id"),
            text.clean_code(F.col(code)).alias("code"),
            F.lit(label).alias("label"),
            class_id.alias("cwe"),
            class_name.alias("cwe_name"),
            (F.col("ord") * 2 + (1 - label)).alias("ord"),
        )

    sides = F.array(side("vuln", "vulnerable_code", 1), side("fixed", "fixed_code", 0))
    return (
        raw.select(
            F.lit(source).alias("source"),
            text.strip(text.blank_if_null(F.col("language"))).alias("language"),
            text.last_url_segment(F.col("repo_url")).alias("project"),
            text.group_key(source, *[F.col(p) for p in group_parts]).alias("group_id"),
            F.explode(sides).alias("s"),
        )
        .select("s.*", "source", "language", "project", "group_id")
        .filter(F.col("code") != "")
        .select(*SAMPLE_COLUMNS)
    )


def long_enough(min_chars: int, code: str = "code") -> Column:
    return F.length(code) >= min_chars


def first_per_fingerprint(
    df: DataFrame, fingerprint: Column, order: str = "ord", name: str = "code_hash"
) -> DataFrame:
    """Exact duplicates removed; of equal texts the first in order stays.

    Spark keeps only the best row per map task before the shuffle, so of a
    text that makes up a third of the corpus one copy per map task is moved.
    """
    first = Window.partitionBy(name).orderBy(order)
    return (
        df.withColumn(name, fingerprint)
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )


# Losing rows that are broadcast as they are, and bits of the filter that
# stands for more of them: 8,192 bitmaps of 4 KiB at most.
MOST_BROADCAST, FILTER_BITS = 1_000_000, 1 << 28


def first_by_keys(
    df: DataFrame, fingerprint: Column, order: str = "ord", name: str = "code_hash", path: str | None = None
) -> DataFrame:
    """:func:`first_per_fingerprint` without moving a text that stays.

    Which rows lose is found on fingerprints and the unique ``order`` alone,
    staged at ``path``. Up to ``MOST_BROADCAST`` losing rows are broadcast.
    For more, a Bloom filter of fixed size is; rows that miss it stay where
    they are, and only rows that hit it are joined with the losing ones.
    The input is read once for the keys and once or twice for the rows.
    """
    keyed = df.withColumn(name, fingerprint)
    keys = stage(keyed.select(F.col(name).alias("_key"), F.col(order).alias("_ord")), path and f"{path}/keys")
    again = keys.groupBy("_key").agg(F.min("_ord").alias("_first"), F.max("_ord").alias("_last")).filter("_first < _last")
    late = keys.join(again.select("_key", "_first"), "_key").filter("_ord > _first").select("_ord")
    losers = stage(late, path and f"{path}/losers")
    count = losers.count()
    mine = F.col(order) == F.col("_ord")
    if count <= MOST_BROADCAST:
        return keyed.join(F.broadcast(losers), mine, "left_anti") if count else keyed
    hit = bloom_hit(keyed, losers, order)
    return hit.filter("not _hit").unionByName(hit.filter("_hit").join(losers, mine, "left_anti")).drop("_hit")


def bloom_hit(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Add ``_hit``: false only where ``column`` is none of the ``values``, a
    table of one column. The filter has one hash and ``FILTER_BITS`` bits."""

    def bit(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(FILTER_BITS)) + 1

    places = values.select(bit(F.col(values.columns[0])).alias("p"))
    bitmaps = places.groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits")
    )
    at = F.bitmap_bit_position(bit(F.col(column)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.expr("shiftright(_byte, _at)").bitwiseAND(1) == 1
    marked = df.withColumn("_bucket", F.bitmap_bucket_number(bit(F.col(column))))
    return (
        marked.join(F.broadcast(bitmaps), "_bucket", "left")
        .withColumns({"_byte": byte, "_at": at.bitwiseAND(7).cast("int")})
        .withColumn("_hit", F.coalesce(on, F.lit(False)))
        .select(*df.columns, "_hit")
    )


def task_rows(df: DataFrame, task: str) -> DataFrame:
    """Classification uses flawed samples with a known class; detection all."""
    if task == "classification":
        return df.filter((F.col("label") == 1) & (F.col("cwe") != ""))
    if task == "detection":
        return df.withColumn("label", F.col("label").cast("int"))
    raise ValueError(f"unknown task {task!r}, choose detection or classification")


def labelled_only(df: DataFrame, label: str = "label", code: str = "code") -> DataFrame:
    """Rows that carry a label; a missing text counts as empty."""
    return df.filter(F.col(label).isNotNull()).withColumn(code, text.blank_if_null(F.col(code)))
