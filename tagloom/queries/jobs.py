"""Whole jobs and file formats: shards, a corpus build, predictions, folders."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import schemas
from tagloom.functions import text, tokens
from tagloom.operators import labels, scoring, splits
from tagloom.operators.ordering import ord_levels, ranked
from tagloom.operators.staging import scratch_dir
from tagloom.plans import build, evaluate
from tagloom.plans.predict import Predictor, predict_file
from tagloom.queries.corpus import (
    MAX_CHARS,
    MIN_CHARS,
    SQL_CLASSES,
    document_fixes,
    sql_distinct_samples,
)
from tagloom.queries.evaluation import SQL_DOC_SCORES, SQL_TUNED, doc_scores
from tagloom.queries.records import SQL_RECORDS, LineBreakScorer, labelled_documents
from tagloom.queries.registry import query, sql_split, table
from tagloom.settings import load_settings
from tagloom.sources import documents, inventory, jsonl, shards


def _write_in_order(rows: DataFrame, order: str, path: str, *drop: str) -> None:
    """Files whose names and rows follow ``order``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    ordered.drop(*drop).write.parquet(path)


@query("SELECT doc_id, md5(text) AS code_hash, row_number() OVER (ORDER BY doc_id) AS position FROM documents")
def shard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as ordered shards, read back: `ord` follows files and rows."""
    path = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _write_in_order(docs, "doc_id", path)
    rows = shards.read_shards(spark, f"{path}/part-*.parquet", docs.schema)
    hashed = rows.select("doc_id", text.fingerprint(F.col("text")).alias("code_hash"), "ord")
    return ranked(hashed, [F.col("ord")], ord_levels(F.col("ord")), name="position").drop("ord")


_BUILT = f"""
WITH pool AS ({sql_distinct_samples('cvefixes')}),
flawed AS (SELECT * FROM pool WHERE label = 1 AND cwe <> ''),
classes AS ({SQL_CLASSES.replace('pool', 'flawed')}),
first AS ({sql_split('pool', 'group_id')}),
second AS ({sql_split('flawed', 'group_id')}),
r AS (
    SELECT 'detection' AS task, split, label, CASE label WHEN 1 THEN 'vulnerable' ELSE 'safe' END AS name, code
    FROM pool JOIN first USING (group_id)
    UNION ALL
    SELECT 'classification', split, coalesce(c.id, (SELECT CAST(count(*) AS INTEGER) FROM classes)),
           coalesce(c.name, '{labels.OTHER}'), code
    FROM flawed JOIN second USING (group_id) LEFT JOIN classes c ON cwe = c.name)
SELECT task, split, label, name, count(*) AS n, CAST(sum(length(code)) AS BIGINT) AS chars, count(*) AS in_stats
FROM r GROUP BY ALL"""


@query(_BUILT)
def built_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build job from raw shards to records: written records, class names
    from the label map, and the counts of the statistics document."""
    path, name = scratch_dir(spark), "cvefixes"
    fixes = document_fixes(spark, sf_dir).select(*schemas.RAW_FIX.names, "ord")
    _write_in_order(fixes, "ord", f"{path}/raw/{name}/train-documents.parquet", "ord")
    limits = {"source": name, "min_code_chars": MIN_CHARS, "max_code_chars": MAX_CHARS}
    build.build_corpus(spark, load_settings(overrides={"data": limits}), f"{path}/raw", path)
    stats = documents.read_json(spark, f"{path}/{name}_stats.json")["tasks"]
    found = []
    for task in build.TASKS:
        # As long as the class dictionary.
        names = documents.names_by_id(documents.read_json(spark, f"{path}/{name}_{task}_label_map.json"))
        counted = [
            (split, int(label), names[int(label)], n)
            for split, part in stats[task]["splits"].items()
            for label, n in part["label_dist"].items()
        ]
        known = spark.createDataFrame(counted, "split string, label int, name string, in_stats long")
        for split in splits.SPLITS:
            records = build.read_split(spark, path, name, task, split)
            sums = records.groupBy("label").agg(
                F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).cast("long").alias("chars")
            )
            here = known.filter(F.col("split") == split)
            found.append(sums.join(here, "label").withColumn("task", F.lit(task)))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result.select("task", "split", "label", "name", "n", "chars", "in_stats")


@query(f"""
SELECT id, CAST(p >= 0.3 AS INTEGER) AS label, round(p, 9) AS prob_vulnerable, CAST(y AS INTEGER) AS gold,
       count(*) FILTER (y = CAST(p >= 0.3 AS INTEGER)) OVER () AS correct, count(y) OVER () AS total
FROM (SELECT id, label AS y, b / (b + CAST(10.0 AS DOUBLE)) AS p FROM (
    SELECT id, label, length(code) - length(replace(code, chr(10), '')) AS b FROM ({SQL_RECORDS})))""")
def predicted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction job: a JSON Lines file scored into another, with gold."""
    path = scratch_dir(spark)
    jsonl.write_jsonl(labelled_documents(spark, sf_dir), f"{path}/in.jsonl")
    predictor = Predictor("detection", ["safe", "vulnerable"], 0.3)
    agreed = predict_file(
        spark, predictor, lambda rows: scoring.score(rows, LineBreakScorer, batch_size=256), f"{path}/in.jsonl"
    )
    written = jsonl.read_strict(spark, f"{path}/in.pred.jsonl", schemas.predictions())
    return written.select(
        "id",
        "pred.label",
        F.round("pred.prob_vulnerable", 9).alias("prob_vulnerable"),
        "gold",
        F.lit(agreed["correct"]).cast("long").alias("correct"),
        F.lit(agreed["total"]).cast("long").alias("total"),
    )


@query(f"""
SELECT doc_id, CAST(score >= threshold AS INTEGER) AS label, round(threshold, 9) AS threshold
FROM ({SQL_DOC_SCORES}), (SELECT threshold FROM ({SQL_TUNED}) WHERE split = 'val')""")
def tuned_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuned on one split, kept with the checkpoint, found there and applied."""
    best, _ = evaluate.tune(doc_scores(spark, sf_dir).select("split", "y", "score"), "val", 0.9)
    path = f"{scratch_dir(spark)}/best"
    documents.write_json(spark, f"{path}/threshold.json", evaluate.threshold_document(best, 0.9, "val"))
    probs = F.array(1 - F.col("score"), F.col("score"))
    scored = doc_scores(spark, sf_dir).select("doc_id", probs.alias("probs"))
    return Predictor.load(spark, path).shape(scored).select(
        "doc_id", "pred.label", F.round("pred.threshold", 9).alias("threshold")
    )


class WordLengths:
    """A stand-in tokenizer: a word's id is its length."""

    def encode_batch(self, texts: list[str], add_special_tokens: bool = True) -> list[SimpleNamespace]:
        return [SimpleNamespace(ids=[len(w) for w in t.split(" ") if w]) for t in texts]


@query("""
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, md5(array_to_string(list_transform(w, lambda x: length(x)), ' ')) AS ids_md5
FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)""")
def tokenizer_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through a plugged-in tokenizer object."""
    ids = tokens.vocabulary_tokenizer(WordLengths)(F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    return docs.select(
        "doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join("ids", " ")).alias("ids_md5")
    )


def _text_folders(spark: SparkSession, sf_dir: str) -> str:
    """Documents as text files of a few texts each, in ten folders."""
    path = f"{scratch_dir(spark)}/texts"
    docs = table(spark, sf_dir, "documents").select("text", F.pmod("doc_id", F.lit(10)).alias("bucket"))
    docs.write.partitionBy("bucket").option("maxRecordsPerFile", 32).text(path)
    return path


@query("""
SELECT doc_id % 10 AS bucket, CAST(sum(length(t) + 1) AS BIGINT) AS chars,
       CAST(sum(length(t) - length(replace(t, chr(10), '')) + 1) AS BIGINT) AS line_ends
FROM (SELECT doc_id, replace(coalesce(text, ''), chr(65533), '') AS t FROM documents) GROUP BY 1""")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text files read whole, their characters and lines by folder."""
    files = jsonl.read_text_files(spark, _text_folders(spark, sf_dir))
    lines = F.length("code") - F.length(F.replace("code", F.lit("\n"), F.lit("")))
    bucket = F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long")
    return files.groupBy(bucket.alias("bucket")).agg(
        F.sum(F.length("code")).cast("long").alias("chars"), F.sum(lines).cast("long").alias("line_ends")
    )


@query("""
SELECT 'bucket=' || (doc_id % 10) AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY 1""")
def folder_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes on disk per folder."""
    return inventory.folder_sizes(spark, _text_folders(spark, sf_dir)).select("folder", "bytes")


@query("""
SELECT count(*) AS groups, count(*) FILTER (WHERE a AND b) AS train_val, count(*) FILTER (WHERE a AND c) AS train_test, count(*) FILTER (WHERE b AND c) AS val_test
FROM (SELECT o_custkey, bool_or(h < 'c') AS a, bool_or(h >= 'c' AND h < 'e') AS b, bool_or(h >= 'e') AS c
      FROM (SELECT o_custkey, left(md5(CAST(o_orderkey AS VARCHAR)), 1) AS h FROM orders) GROUP BY o_custkey)""")
def split_overlap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders split one by one: customers then lie in several splits."""
    digit = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1)
    split = F.when(digit < "c", "train").when(digit < "e", "val").otherwise("test")
    return splits.split_overlap(
        table(spark, sf_dir, "orders").select("o_custkey", split.alias("split")), "o_custkey"
    )
