"""Quality rules by divergence from language references (operator 8).

A document is described by two histograms: its characters by class, and its
words by the common words of its language. Each is compared with the average
document of the language, whatever its name, by Jensen-Shannon divergence, in
bits. Only Spark's own expressions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.words import native_words
from tagloom.operators.staging import stage

# The commonest function words of each known language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los"),
}
# So many references at most are broadcast; more are joined unhinted.
MOST_BROADCAST = 10_000
CLASSES = {
    "upper": "[A-Z]",
    "symbol": "[#*$%&|<>]",
    "mark": "[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E&&[^#*$%&|<>]]",
}
WINDOW = 8
# Verdict: divergences above these reject, from so many words on.
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
CHAR_LIMIT, CHAR_WORDS = 0.035, 50
WORD_LIMIT, WORD_WORDS = 0.06, 100


def add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two distributions, as arrays."""

    def against(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(x * 2 / (x + y))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda x, y: (against(x, y) + against(y, x)) / 2)
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def measured(docs: DataFrame, keep: Sequence[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc`` (the columns ``keep`` as a struct) and the measures of each row.

    Null texts and texts of separators have no words. ``n_dup_lines`` counts
    lines with a word that equal an earlier one; ``n_repeat_words`` the words
    covered by 8-word windows that occur twice or more.
    """
    first = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("doc"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
        F.col(lang).cast("string").alias("lang"),
    )
    listed = F.create_map(
        *[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    )
    split = first.withColumn("w", native_words(F.col("t"))).withColumn("common", listed[F.col("lang")])
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hashed = split.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.when(F.instr("t", "\n") > 0, lines).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
        *[F.regexp_count("t", F.lit(x)).cast("long").alias(f"c_{k}") for k, x in CLASSES.items()],
        F.length("t").cast("long").alias("c_all"),
        (F.octet_length("t") - F.length("t")).cast("long").alias("c_wide"),
        *[
            (F.size("w") - F.size(F.array_remove("w", F.col("common")[k]))).cast("long").alias(f"w_{k}")
            for k in range(len(COMMON_WORDS["en"]))
        ],
    )
    # Hashes of 2, 4 and 8 neighbours, each from two of the one before.
    for width in (2, 4, WINDOW):
        half, tail = f"h{width // 2}", F.slice(f"h{width // 2}", width // 2 + 1, 1 << 30)
        hashed = hashed.withColumn(f"h{width}", F.zip_with(half, tail, lambda a, b: F.xxhash64(a, b)))
    hashed = hashed.withColumn(
        "h", F.slice(f"h{WINDOW}", 1, F.greatest(F.lit(0), F.size("w") - WINDOW + 1))
    )
    paired = hashed.withColumn(
        "pairs",
        F.when(
            F.size("h") > F.size(F.array_distinct("h")),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    again = F.filter(
        "pairs",
        lambda p, i: (p.h == F.get(F.col("pairs"), i - 1).h) | (p.h == F.get(F.col("pairs"), i + 1).h),
    )
    starts = paired.withColumn("at", F.sort_array(F.transform(again, lambda p: p.i)))
    covered = F.aggregate(
        F.transform(
            "at",
            lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), i + 1) - s, F.lit(WINDOW))),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return starts.select(
        "doc", "lang", "n_words", "word_chars",
        F.col("c_symbol").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        *[f"c_{k}" for k in CLASSES], "c_all", "c_wide",
        *[F.coalesce(f"w_{k}", F.lit(0)).alias(f"w_{k}") for k in range(len(COMMON_WORDS["en"]))],
    )


def shares(whole: Column, parts: Sequence[Column]) -> list[Column]:
    """Shares of the parts and of the rest; all in the rest for an empty whole."""
    whole = F.greatest(whole, add(parts)).cast("double")
    part = [F.coalesce(F.try_divide(p, whole), F.lit(0.0)) for p in parts]
    return [*part, 1 - add(part)]


def histograms() -> tuple[list[Column], list[Column]]:
    chars = shares(
        F.col("c_all") + F.col("c_wide"),
        [*[F.col(f"c_{k}") for k in CLASSES], F.col("c_wide"), F.col("c_all") - F.col("word_chars")],
    )
    return chars, shares(F.col("n_words"), [F.col(f"w_{k}") for k in range(len(COMMON_WORDS["en"]))])


def assess(docs: DataFrame, keep: Sequence[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc``, the measures, ``char_divergence``, ``word_divergence`` (both in
    bits), ``base_failed`` and ``kept``, one row per input row.

    The references are the mean histograms of all documents of a language, so
    every document counts alike however long. A language without common words
    here is compared by its characters only, a document without a language by
    neither. Documents shorter than a measure's minimum are not judged by it. Repeated rows are each assessed;
    an empty table gives an empty one. The measures are written once, as both
    the references and the verdicts read them.
    """
    rows = stage(measured(docs, keep, text, lang))
    chars, words = histograms()
    sizes = {"c": len(chars), "w": len(words)}
    rows = rows.withColumns({"hc": F.array(*chars), "hw": F.array(*words)})
    longer = F.col("n_words") >= CHAR_WORDS
    means = stage(rows.filter(longer & F.col("lang").isNotNull()).groupBy("lang").agg(
        *[F.array(*[F.avg(F.get(f"h{k}", F.lit(i))) for i in range(n)]).alias(f"r{k}") for k, n in sizes.items()]
    ))
    few = means.count() <= MOST_BROADCAST
    judged = rows.join(F.broadcast(means) if few else means, "lang", "left")
    by_char = F.when(longer & F.col("lang").isNotNull(), divergence(F.col("hc"), F.col("rc"))).otherwise(0.0)
    by_word = F.when(
        (F.col("n_words") >= WORD_WORDS) & F.col("lang").isin(*COMMON_WORDS),
        divergence(F.col("hw"), F.col("rw")),
    ).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return judged.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        by_char.alias("char_divergence"), by_word.alias("word_divergence"),
        failed.alias("base_failed"),
    ).withColumn(
        "kept",
        ~F.col("base_failed")
        & (F.col("char_divergence") <= CHAR_LIMIT)
        & (F.col("word_divergence") <= WORD_LIMIT),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns."""
    return assess(docs, docs.columns).filter("kept").select("doc.*")


def op8_quality_divergence(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess(docs, ["doc_id"]).select("doc.doc_id", *[
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_divergence", "word_divergence",
    ])
