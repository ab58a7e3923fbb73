"""Scans, projections and text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.operators.corpus import long_enough
from tagloom.queries.registry import query, sql_class_id, sql_clean, sql_truncate, table


@query("""
SELECT 'doc-' || doc_id AS id, text AS code, trim(lang) AS language,
       'documents' AS source, source AS project
FROM documents""")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected scan with renames and a constant column."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("code"),
        text.strip(F.col("lang")).alias("language"),
        F.lit("documents").alias("source"),
        F.col("source").alias("project"),
    )


_MESSY = "chr(9) || chr(12288) || replace(text, chr(10), chr(13) || chr(10)) || chr(13) || ' ' || chr(8195)"


@query(f"""
SELECT doc_id, code, CAST(length(code) AS INTEGER) AS n_code
FROM (SELECT doc_id, {sql_clean(_MESSY)} AS code FROM documents)""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends and outer white space, on texts given DOS line ends first."""
    messy = F.concat(
        F.lit("\t　"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r  ")
    )
    cleaned = table(spark, sf_dir, "documents").select("doc_id", text.clean_code(messy).alias("code"))
    return cleaned.withColumn("n_code", F.length("code"))


@query(f"""
SELECT page_id, code, CAST(length(code) AS INTEGER) AS n_code
FROM (SELECT page_id, {sql_clean('html')} AS code FROM pages)""")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = table(spark, sf_dir, "pages").select("page_id", text.clean_code(F.col("html")).alias("code"))
    return cleaned.withColumn("n_code", F.length("code"))


@query(f"""
SELECT p_partkey, {sql_class_id('p_brand')} AS brand_id,
       {sql_class_id("('  cwe_00' || p_size || ' ')")} AS size_id,
       {sql_class_id("CASE WHEN p_size > 40 THEN NULL WHEN p_size > 30 THEN 'nan' WHEN p_size > 20 THEN 'NVD-CWE-noinfo' WHEN p_size > 10 THEN 'CWE-000' ELSE p_type END")} AS odd_id
FROM part""")
def normalize_code_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class ids in several spellings, and values that are none."""
    size = F.col("p_size")
    odd = (
        F.when(size > 40, F.lit(None).cast("string"))
        .when(size > 30, "nan")
        .when(size > 20, "NVD-CWE-noinfo")
        .when(size > 10, "CWE-000")
        .otherwise(F.col("p_type"))
    )
    padded = F.concat(F.lit("  cwe_00"), size.cast("string"), F.lit(" "))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.normalize_class_id(F.col("p_brand")).alias("brand_id"),
        text.normalize_class_id(padded).alias("size_id"),
        text.normalize_class_id(odd).alias("odd_id"),
    )


@query(f"""
SELECT doc_id, CAST(length(code) AS INTEGER) AS n_code
FROM (SELECT doc_id, {sql_clean('text')} AS code FROM documents)
WHERE length(code) >= 30""")
def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.clean_code(F.col("text")).alias("code"))
    return docs.filter(long_enough(30)).select("doc_id", F.length("code").alias("n_code"))


@query(f"""
SELECT doc_id, code, CAST(length(code) AS INTEGER) AS n_code
FROM (SELECT doc_id, {sql_truncate('text', 2000, 1200)} AS code FROM documents)""")
def head_tail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select(
        "doc_id", text.truncate_middle(F.col("text"), 2000).alias("code")
    )
    return cut.withColumn("n_code", F.length("code"))


@query("SELECT doc_id, md5(text) AS code_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.fingerprint(F.col("text")).alias("code_hash")
    )


@query("SELECT page_id, string_split(url, '/')[-1] AS segment FROM pages")
def url_last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", text.last_url_segment(F.col("url")).alias("segment")
    )


@query("""
SELECT 'documents::' || source || '::' || CASE WHEN lang = 'en' THEN 'None' ELSE lang END AS group_id,
       count(*) AS n
FROM documents GROUP BY 1""")
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys; a missing part prints as None instead of vanishing."""
    lang = F.when(F.col("lang") != "en", F.col("lang"))
    return (
        table(spark, sf_dir, "documents")
        .groupBy(text.group_key("documents", F.col("source"), lang).alias("group_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS encoded
FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON decoded with a declared schema and encoded again."""
    decoded = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.from_json("props", "k int").alias("p")
    )
    k = F.col("p.k")
    return decoded.select(
        "event_id", k.alias("k"), F.to_json(F.struct("event_type", k.alias("k"))).alias("encoded")
    )


@query("""
SELECT lang, format('{:,}', sum(n_chars)) AS chars,
       printf('%.4f', avg(CAST(n_chars AS DOUBLE))) AS mean_chars
FROM documents GROUP BY lang""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .groupBy("lang")
        .agg(F.sum("n_chars").alias("s"), F.avg("n_chars").alias("m"))
        .select("lang", text.thousands(F.col("s")).alias("chars"), text.four_decimals(F.col("m")).alias("mean_chars"))
    )
