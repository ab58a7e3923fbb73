"""Model inputs: token ids, masks, batches and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import subwords, tokens
from tagloom.operators import batching
from tagloom.operators.staging import spread
from tagloom.queries.registry import query, table

SPECIAL = tokens.SpecialTokens(cls_id=1, sep_id=2, pad_id=0, token_type_ids=True)
MAX_LENGTH = 512


def spelling_id(word: Column) -> Column:
    """An id SQL can compute too: first and last letter, and length."""
    return F.ascii(word) * 10_000 + F.ascii(F.right(word, F.lit(1))) * 10 + F.length(word)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.encode_words(F.col("text"), SPECIAL, MAX_LENGTH, word_id=spelling_id)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs, "doc_id").select("doc_id", ids.alias("input_ids"))


_ENCODED = """
    SELECT doc_id, list_concat([1], list_concat(list_transform(kept,
               lambda w: ascii(w) * 10000 + ascii(right(w, 1)) * 10 + CAST(length(w) AS INTEGER)), [2])) AS ids
    FROM (SELECT doc_id, CASE WHEN len(w) > 510
                 THEN list_concat(w[1:306], w[len(w) - 203:len(w)]) ELSE w END AS kept
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w
                FROM documents))"""


@query(f"""
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens, array_to_string(ids, ' ') AS ids FROM ({_ENCODED})""")
def token_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenised whole, middle cut out, wrapped in special tokens."""
    ids = F.col("input_ids")
    return encoded(spark, sf_dir).select(
        "doc_id", F.size(ids).alias("n_tokens"), F.array_join(ids, " ").alias("ids")
    )


@query(f"""
WITH numbered AS (
    SELECT doc_id, ids, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch_id FROM ({_ENCODED})),
sized AS (
    SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 8.0) * 8 AS INTEGER) AS width FROM numbered)
SELECT doc_id, batch_id, width, CAST(len(ids) AS INTEGER) AS real_tokens, CAST(0 AS INTEGER) AS type_sum,
       md5(array_to_string(ids, ' ') || repeat(' 0', CAST(width - len(ids) AS BIGINT))) AS ids_md5
FROM sized""")
def dynamic_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 in order, padded to the longest row in steps of 8."""
    batches = batching.number_batches(encoded(spark, sf_dir), 16, "doc_id")
    padded = batching.pad_batches(batches, SPECIAL)
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    types = F.aggregate("token_type_ids", F.lit(0), lambda a, x: a + x)
    return padded.select(
        "doc_id",
        "batch_id",
        "width",
        ones.alias("real_tokens"),
        types.alias("type_sum"),
        F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
    )


def vocabulary(spark: SparkSession) -> subwords.Subwords:
    """A public vocabulary file; any other of the `tokenizers` library will do."""
    import public_tokenizers

    return subwords.Subwords(spark, public_tokenizers.path("word_bpe_49k.json"))


def subword_inputs(spark: SparkSession, sf_dir: str, bpe: subwords.Subwords) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", bpe.head_tail(F.col("text"), MAX_LENGTH).alias("input_ids"))


# Byte pair encoding has no SQL form: the three below are tested against the
# tokenizer itself.
@query()
def subword_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned subword ids of whole texts, the middle cut out, wrapped in the
    file's special tokens, with the mask of real tokens."""
    ids = F.col("input_ids")
    return subword_inputs(spark, sf_dir, vocabulary(spark)).withColumn("attention_mask", tokens.attention_mask(ids))


@query()
def subword_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword inputs in batches of 16, padded to the longest row in steps of 8."""
    bpe = vocabulary(spark)
    rows = subword_inputs(spark, sf_dir, bpe)
    return batching.pad_batches(batching.number_batches(rows, 16, "doc_id"), bpe.special)


@query()
def subword_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: subwords of the whole texts, and how many texts a limit of
    512 would cut, by how much."""
    bpe = vocabulary(spark)
    room = MAX_LENGTH - len(sum(bpe.special.around(), []))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    return docs.select("lang", bpe.count(F.col("text")).alias("n")).groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.sum("n").alias("tokens"),
        F.max("n").alias("longest"),
        F.count_if(F.col("n") > room).alias("cut"),
        F.sum(F.greatest(F.col("n") - room, F.lit(0))).alias("tokens_lost"),
    )
