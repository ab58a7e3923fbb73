"""Merkle fixity audit of WARC archives (operator 3).

A record's leaf is the SHA-256 of its bytes. Offsets are cut into ranges of
``RANGE`` bytes; a node at the lowest level covers the records that start in
one range, a node above it ``FANOUT`` neighbouring ranges of the level below.
Ranges are arithmetic on offsets, so a tree is built by grouping alone and a
group is bounded: records are longer than their headers, nodes have few
children. Replicas are compared from the root down, and only children of nodes
that differ are looked at. Only Spark's own expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.staging import stage

RANGE = 1 << 16
FANOUT = 16
# Pages of one archive file in the query's layout.
PER_ARCHIVE = 4096
# First two digits of the hashes of records that the query damages.
CHANGED, LOST = ("a7", "3c"), ("1f", "e0")


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record with its headers, as text."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """``archive, offset, length, digest, copies`` from ``archive, offset,
    record``. Records that repeat archive, offset and bytes are one leaf."""
    return (
        records.select(
            F.col("archive").cast("long"), F.col("offset").cast("long"),
            F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"),
        )
        .filter("archive is not null and offset is not null")
        .groupBy("archive", "offset", "length", "digest").agg(F.count("*").alias("copies"))
    )


def parents(nodes: DataFrame, at: Column, order: str, *content: str) -> DataFrame:
    inside = F.array_sort(F.collect_list(F.struct(order, *content)))
    text = F.transform(inside, lambda x: F.concat_ws(":", x[order], *[x[c] for c in content]))
    return nodes.groupBy("archive", at.alias("node")).agg(F.sha2(F.array_join(text, "\n"), 256).alias("digest"))


def levels(found: DataFrame) -> list[DataFrame]:
    """Node tables from the lowest ranges up to one root per archive."""
    out = [stage(parents(found, F.shiftright("offset", 16), "offset", "length", "digest", "copies"))]
    while (out[-1].agg(F.max("node")).first()[0] or 0) > 0:
        out.append(stage(parents(out[-1], F.floor(F.col("node") / FANOUT), "node", "digest")))
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """``archive, offset, length, state`` of the leaves that differ between two
    tables of leaves: ``missing`` (in ``a`` only), ``extra`` (in ``b`` only) or
    ``corrupt`` (other bytes at the same offset; ``length`` is that of ``a``).

    Equal and empty replicas give no rows. An archive that one replica lacks
    differs from its root down.
    """
    trees = [levels(a), levels(b)]
    height = max(map(len, trees))
    for tree in trees:
        while len(tree) < height:
            top = tree[-1]
            tree.append(stage(parents(top, F.floor(F.col("node") / FANOUT), "node", "digest")))
    suspects = None
    for level in range(height - 1, -1, -1):
        left, right = trees[0][level], trees[1][level]
        if suspects is not None:
            near = suspects.select("archive", F.col("node").alias("above"))
            left, right = (
                t.withColumn("above", F.floor(F.col("node") / FANOUT)).join(near, ["archive", "above"], "left_semi").select("archive", "node", "digest")
                for t in (left, right)
            )
        both = left.alias("l").join(right.alias("r"), ["archive", "node"], "full")
        suspects = stage(both.filter(~F.col("l.digest").eqNullSafe(F.col("r.digest"))).select("archive", "node"))
    inside = [
        t.withColumn("node", F.shiftright("offset", 16)).join(suspects, ["archive", "node"], "left_semi")
        for t in (a, b)
    ]
    l, r = (t.groupBy("archive", "offset").agg(
        F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("digest", "copies"))).alias("d")
    ) for t in inside)
    state = F.when(F.col("r.d").isNull(), "missing").when(F.col("l.d").isNull(), "extra").otherwise("corrupt")
    return (
        l.alias("l").join(r.alias("r"), ["archive", "offset"], "full")
        .filter(~F.col("l.d").eqNullSafe(F.col("r.d")))
        .select("archive", "offset", F.coalesce("l.length", "r.length").alias("length"), state.alias("state"))
    )


def laid_out(pages: DataFrame) -> DataFrame:
    """``archive, offset, page_id, record``: pages in order of their id, in
    archives of a range of ids each; rows without an id come first in archive
    -1. Rows that repeat an id follow each other by url and html."""
    archive = F.coalesce(F.floor(F.col("page_id") / PER_ARCHIVE), F.lit(-1)).cast("long")
    rows = pages.select(
        "page_id", archive.alias("archive"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")
    )
    before = Window.partitionBy("archive").orderBy("page_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("record").cast("long")
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with faults where the record's own hash says so: two in 256
    have their end changed, two in 256 are lost."""
    mark = F.substring(F.sha2("record", 256), 1, 2)
    changed = F.when(mark.isin(*CHANGED), F.concat("record", F.lit("#")))
    return records.filter(~mark.isin(*LOST)).withColumn("record", F.coalesce(changed, F.col("record")))


def op3_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Every record of the pages' archives with the state the audit gives it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = stage(laid_out(pages))
    found = audit(stage(leaves(records)), stage(leaves(damaged(records))))
    return (
        records.select("page_id", "archive", "offset", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
        .join(found.select("archive", "offset", "state"), ["archive", "offset"], "left")
        .withColumn("state", F.coalesce("state", F.lit("intact")))
    )


_END = "chr(13) || chr(10)"
ORACLE = f"""
WITH p AS (
  SELECT page_id, CAST(coalesce(floor(page_id / 4096.0), -1) AS BIGINT) AS archive,
    'WARC/1.0' || {_END} || 'WARC-Type: resource' || {_END} || 'WARC-Record-ID: <urn:page:'
    || coalesce(CAST(page_id AS VARCHAR), 'null') || '>' || {_END} || 'WARC-Target-URI: ' || coalesce(url, '')
    || {_END} || 'Content-Type: text/html' || {_END} || 'Content-Length: '
    || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || {_END} || {_END}
    || coalesce(html, '') || {_END} || {_END} AS record FROM pages),
s AS (SELECT *, CAST(octet_length(encode(record)) AS BIGINT) AS length, sha256(record) AS sha256 FROM p)
SELECT page_id, archive, length, sha256,
  CASE WHEN left(sha256, 2) IN ('a7', '3c') THEN 'corrupt' WHEN left(sha256, 2) IN ('1f', 'e0') THEN 'missing'
    ELSE 'intact' END AS state,
  CAST(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, record
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s"""
