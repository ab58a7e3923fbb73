"""The corpus pipeline: each stage's result is written and read again as the
documents of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import line_dedup, mixing, near_dup, packing, quality
from tagloom.operators.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and diverge little from their
    language; the rest go."""
    return quality.accepted(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut; documents made of
    such passages only go. ``n_chars``, if there, follows the text."""
    from pyspark.sql import functions as F

    done = line_dedup.deduplicated(docs)
    if "n_chars" in done.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.length("text").cast(kind))
    return done


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 80% of their shingles, the
    one with the smallest doc_id."""
    return near_dup.one_of_each(docs, near_dup.STAGE_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their shares."""
    return mixing.sampled(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the encoded documents with their places in full windows."""
    return packing.digests(packing.packed(docs, packing.tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_repeats),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed_windows),
]
# Signatures, balancing and encoding have no SQL form: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
