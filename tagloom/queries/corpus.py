"""Corpus preparation: fan-out, deduplication, classes, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.operators import balance, corpus, labels, splits
from tagloom.operators.staging import spread, stage
from tagloom.queries.registry import (
    query,
    sql_class_id,
    sql_clean,
    sql_split,
    sql_truncate,
    table,
)

MIN_CHARS, MAX_CHARS = 30, 8000


# ---- Fix commits bound to the tables ------------------------------------

_PART_FIXES = """
    SELECT p_partkey AS ord, 'P-' || p_partkey AS cve_id,
           CASE WHEN p_size % 7 <> 0 THEN p_brand END AS hash,
           'https://host/' || p_type || '/' || CASE WHEN p_size < 10 THEN '' ELSE p_name END AS repo_url,
           p_brand AS cwe_id, ' ' || p_type AS cwe_name, p_type || ' ' AS language,
           p_name AS vulnerable_code, CASE WHEN p_size > 25 THEN ' ' ELSE p_type END AS fixed_code
    FROM part"""


def part_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fix commits, with null hashes, blank sides and bare URLs."""
    size = F.col("p_size")
    tail = F.when(size < 10, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("cve_id"),
        F.when(size % 7 != 0, F.col("p_brand")).alias("hash"),
        F.concat(F.lit("https://host/"), "p_type", F.lit("/"), tail).alias("repo_url"),
        F.col("p_brand").alias("cwe_id"),
        F.concat(F.lit(" "), "p_type").alias("cwe_name"),
        F.concat("p_type", F.lit(" ")).alias("language"),
        F.col("p_name").alias("vulnerable_code"),
        F.when(size > 25, " ").otherwise(F.col("p_type")).alias("fixed_code"),
    )


_DOC_FIXES = """
    SELECT doc_id AS ord, 'D-' || doc_id AS cve_id, source AS hash, 'https://host/' || source AS repo_url,
           'cwe_' || CAST(floor(sqrt(CAST(n_chars AS DOUBLE)) / 4) AS BIGINT) AS cwe_id, lang AS cwe_name,
           lang AS language, text AS vulnerable_code, replace(text, ' the ', ' THE ') AS fixed_code
    FROM documents"""


def document_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fix commits; classes from text length have a long tail."""
    step = F.floor(F.sqrt(F.col("n_chars").cast("double")) / 4)
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("cve_id"),
        F.col("source").alias("hash"),
        F.concat(F.lit("https://host/"), "source").alias("repo_url"),
        F.concat(F.lit("cwe_"), step.cast("string")).alias("cwe_id"),
        F.col("lang").alias("cwe_name"),
        F.col("lang").alias("language"),
        F.col("text").alias("vulnerable_code"),
        F.replace("text", F.lit(" the "), F.lit(" THE ")).alias("fixed_code"),
    )


def _sql_samples(fixes: str, source: str) -> str:
    space = "' '"
    shared = f"""'{source}' AS source, trim(language, {space}) AS language,
        string_split(repo_url, '/')[-1] AS project,
        '{source}::' || cve_id || '::' || coalesce(hash, 'None') AS group_id"""
    return f"""
    SELECT * FROM (
        SELECT cve_id || '-vuln' AS id, {sql_clean('vulnerable_code')} AS code, 1 AS label,
               {sql_class_id('cwe_id')} AS cwe, trim(cwe_name, {space}) AS cwe_name,
               ord * 2 AS ord, {shared} FROM ({fixes})
        UNION ALL
        SELECT cve_id || '-fixed', {sql_clean('fixed_code')}, 0, '', '', ord * 2 + 1, {shared}
        FROM ({fixes}))
    WHERE code <> ''"""


@query(_sql_samples(_PART_FIXES, "parts"))
def fan_out_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fix commit -> flawed and repaired sample."""
    return corpus.fan_out_pairs(part_fixes(spark, sf_dir), "parts")


# ---- Deduplicated samples -----------------------------------------------


def sql_distinct_samples(source: str) -> str:
    return f"""
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY code_hash ORDER BY ord) AS rn
        FROM (SELECT *, md5(code) AS code_hash FROM (
            SELECT * EXCLUDE (code), {sql_truncate('code', MAX_CHARS, 4800)} AS code
            FROM ({_sql_samples(_DOC_FIXES, source)}) WHERE length(code) >= {MIN_CHARS})))
    WHERE rn = 1"""


_DISTINCT_SAMPLES = sql_distinct_samples("docs")


def distinct_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = corpus.fan_out_pairs(document_fixes(spark, sf_dir), "docs")
    cut = samples.filter(corpus.long_enough(MIN_CHARS)).withColumn(
        "code", text.truncate_middle(F.col("code"), MAX_CHARS)
    )
    return corpus.first_per_fingerprint(cut, text.fingerprint(F.col("code")))


@query("""
SELECT doc_id, code_hash FROM (
    SELECT doc_id, md5(text) AS code_hash,
           row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = docs.select("doc_id", text.fingerprint(F.col("text")).alias("h"))
    return corpus.first_per_fingerprint(hashed, F.col("h"), "doc_id").select("doc_id", "code_hash")


@query(f"SELECT id, label, cwe, group_id, code_hash, ord FROM ({_DISTINCT_SAMPLES})")
def distinct_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples after fan-out, length filter, truncation and deduplication."""
    return distinct_samples(spark, sf_dir).select("id", "label", "cwe", "group_id", "code_hash", "ord")


# ---- Classes ------------------------------------------------------------

_BRANDS = """
    SELECT p_brand AS name, count(*) AS n, min(p_partkey) AS first_ord FROM part GROUP BY p_brand"""
_TOP_BRANDS = f"""
    SELECT CAST(row_number() OVER (ORDER BY n DESC, first_ord) - 1 AS INTEGER) AS id, name, n
    FROM ({_BRANDS}) WHERE n >= 60 ORDER BY n DESC, first_ord LIMIT 10"""
_BRAND_DICTIONARY = f"""
    SELECT id, name FROM ({_TOP_BRANDS})
    UNION ALL SELECT CAST(count(*) AS INTEGER), 'OTHER' FROM ({_TOP_BRANDS})"""


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.class_frequency(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


def _top_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows, staged because encoding and decoding read them twice."""
    return stage(labels.class_table(_brands(spark, sf_dir), min_samples=60, top_k=10))


@query(_BRANDS)
def label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir)


@query(_BRAND_DICTIONARY)
def class_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept classes by count, OTHER last."""
    return labels.with_other(_top_brands(spark, sf_dir))


@query("""
SELECT CAST(row_number() OVER (ORDER BY n DESC, first_ord) - 1 AS INTEGER) AS id, name, n
FROM (SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS n, min(o_orderkey) AS first_ord
      FROM orders GROUP BY 1)
WHERE n >= 10""")
def class_dictionary_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class with enough rows, numbered without a global window."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("ord")
    )
    return labels.class_table(labels.class_frequency(orders, "name"), min_samples=10, top_k=None)


@query(f"""
SELECT p_partkey, p_brand, coalesce(c.id, (SELECT CAST(count(*) AS INTEGER) FROM ({_TOP_BRANDS}))) AS label
FROM part LEFT JOIN ({_TOP_BRANDS}) c ON p_brand = c.name""")
def topk_other_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return labels.encode_labels(parts, _top_brands(spark, sf_dir), "p_brand", bound=10)


@query(f"""
SELECT p_partkey, p_size, coalesce(c.name, CAST(p_size AS VARCHAR)) AS name
FROM part LEFT JOIN ({_BRAND_DICTIONARY}) c ON p_size = c.id""")
def decode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without a name print as the id."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    names = labels.with_other(_top_brands(spark, sf_dir))
    return labels.decode_labels(parts, names, "p_size", bound=11)


@query("SELECT CAST(greatest(5, max(label) + 1) AS INTEGER) AS num_labels FROM embeddings")
def max_label_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.class_count(table(spark, sf_dir, "embeddings"), declared=5)


# ---- Splits -------------------------------------------------------------


@query(f"""
SELECT doc_id, source, split FROM documents JOIN ({sql_split('documents', 'source')}) USING (source)""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.fit_group_split(docs, "source").assign(docs)


@query(f"""
SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS groups
FROM orders JOIN ({sql_split('orders', 'o_custkey')}) USING (o_custkey) GROUP BY split""")
def group_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    split = splits.fit_group_split(orders, "o_custkey").assign(orders)
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("groups")
    )


@query("""
SELECT count(DISTINCT o_custkey) AS groups, CAST(0 AS BIGINT) AS train_val,
       CAST(0 AS BIGINT) AS train_test, CAST(0 AS BIGINT) AS val_test
FROM orders""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    split = splits.fit_group_split(orders, "o_custkey").assign(orders)
    return splits.split_overlap(split, "o_custkey")


_LANGUAGE_STATS = f"""
    WITH kept AS (
        SELECT doc_id, source, lang FROM (
            SELECT doc_id, source, lang, row_number() OVER (PARTITION BY md5(code) ORDER BY doc_id) AS rn
            FROM (SELECT doc_id, source, lang, {sql_truncate('code', MAX_CHARS, 4800)} AS code
                  FROM (SELECT doc_id, source, lang, {sql_clean('text')} AS code FROM documents)
                  WHERE length(code) >= {MIN_CHARS}))
        WHERE rn = 1),
    assigned AS ({sql_split('kept', 'source')})
    SELECT split, lang, count(*) AS n FROM kept JOIN assigned USING (source) GROUP BY split, lang"""


@query(_LANGUAGE_STATS)
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation of a text corpus, down to rows per split."""
    docs = spread(table(spark, sf_dir, "documents").drop("n_chars"), "doc_id").select(
        "doc_id", "source", "lang", text.clean_code(F.col("text")).alias("code")
    )
    cut = docs.filter(corpus.long_enough(MIN_CHARS)).select(
        "doc_id", "source", "lang", text.fingerprint(text.truncate_middle(F.col("code"), MAX_CHARS)).alias("h")
    )
    kept = stage(corpus.first_per_fingerprint(cut, F.col("h"), "doc_id"))
    split = splits.fit_group_split(kept, "source").assign(kept)
    return split.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


SQL_CLASSES = """
    SELECT CAST(row_number() OVER (ORDER BY n DESC, first_ord) - 1 AS INTEGER) AS id, name
    FROM (SELECT cwe AS name, count(*) AS n, min(ord) AS first_ord FROM pool GROUP BY cwe)
    WHERE n >= 30 ORDER BY n DESC, first_ord LIMIT 40"""


@query(f"""
WITH pool AS (SELECT * FROM ({_DISTINCT_SAMPLES}) WHERE label = 1 AND cwe <> ''),
classes AS ({SQL_CLASSES}),
assigned AS ({sql_split('pool', 'group_id')})
SELECT split, coalesce(c.id, (SELECT CAST(count(*) AS INTEGER) FROM classes)) AS label, count(*) AS n
FROM pool JOIN assigned USING (group_id) LEFT JOIN classes c ON cwe = c.name
GROUP BY ALL""")
def corpus_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flawed samples with folded classes, split by group: label counts."""
    # Four passes follow over a few columns; the texts are read once.
    pool = stage(corpus.task_rows(distinct_samples(spark, sf_dir), "classification").drop("code"))
    classes = stage(labels.class_table(labels.class_frequency(pool, "cwe")))
    encoded = labels.encode_labels(pool, classes, "cwe", bound=40)
    split = splits.fit_group_split(pool).assign(encoded)
    return labels.label_distribution(split, "split")


@query(f"""
WITH pool AS ({_DISTINCT_SAMPLES}), assigned AS ({sql_split('pool', 'group_id')})
SELECT split, label, count(*) AS n FROM pool JOIN assigned USING (group_id) GROUP BY ALL""")
def corpus_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples, split by group: label counts."""
    pool = stage(corpus.task_rows(distinct_samples(spark, sf_dir), "detection").drop("code"))
    split = splits.fit_group_split(pool).assign(pool)
    return labels.label_distribution(split, "split")


# ---- Samples and weights ------------------------------------------------


@query("""
SELECT doc_id, lang FROM (
    SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents)
WHERE r <= 150""")
def hash_sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded sample without replacement (the cap is the operator)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.sample_rows(docs, 150, seed=42, order="doc_id")


@query("""
SELECT min(doc_id) AS doc_id, h AS code_hash FROM (
    SELECT doc_id, md5(text) AS h, row_number() OVER (ORDER BY doc_id) AS r
    FROM documents WHERE length(text) >= 30)
WHERE r <= 150 GROUP BY h""")
def extraction_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows after the filters, deduplicated afterwards."""
    docs = table(spark, sf_dir, "documents").filter(corpus.long_enough(30, "text"))
    first = splits.first_rows(docs.select("doc_id", text.fingerprint(F.col("text")).alias("h")), 150, "doc_id")
    return corpus.first_per_fingerprint(first, F.col("h"), "doc_id").select("doc_id", "code_hash")


@query("""
SELECT doc_id, row_number() OVER (ORDER BY md5('42:3:' || doc_id), doc_id) AS position FROM documents""")
def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.epoch_order(docs, seed=42, epoch=3, order="doc_id")


def _sql_weights(source: str, label: str, num_labels: int) -> str:
    return f"""
    SELECT CAST(class_id AS INTEGER) AS class_id, n,
           round(CAST(sum(n) OVER () AS DOUBLE) / (CAST({num_labels} AS DOUBLE) * n), 9) AS weight
    FROM (SELECT class_id, greatest(coalesce(n, 0), 1) AS n
          FROM range({num_labels}) t(class_id)
          LEFT JOIN (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY 1) c ON c.label = class_id)"""


@query(_sql_weights("labels", "quality", 2))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = balance.class_weights(table(spark, sf_dir, "labels"), 2, "quality")
    return weights.withColumn("weight", F.round("weight", 9))


@query(_sql_weights("embeddings", "label", 12))
def class_weights_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two classes that have no rows."""
    weights = balance.class_weights(table(spark, sf_dir, "embeddings"), 12)
    return weights.withColumn("weight", F.round("weight", 9))


@query("""
WITH shape AS (SELECT count(*) AS n, count(DISTINCT quality) AS c FROM labels),
classes AS (SELECT quality, row_number() OVER (ORDER BY quality) - 1 AS slot, count(*) AS size
            FROM labels GROUP BY quality),
draws AS (
    SELECT CAST('0x' || left(md5('7:' || i), 12) AS BIGINT) % (SELECT c FROM shape) AS slot,
           CAST('0x' || substring(md5('7:' || i), 13, 12) AS BIGINT) AS u
    FROM range((SELECT n FROM shape)) t(i)),
picks AS (SELECT quality, u % size + 1 AS r, count(*) AS draws FROM draws JOIN classes USING (slot) GROUP BY ALL),
numbered AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels)
SELECT doc_id, quality, draws FROM numbered JOIN picks USING (quality, r)""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with replacement, classes equally likely: times drawn per row."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return balance.balanced_sample(rows, seed=7, label="quality", order="doc_id")
