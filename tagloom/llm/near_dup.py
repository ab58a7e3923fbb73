"""MinHash near-duplicates by a multi-index Hamming join (operator 4).

Each document is the set of its distinct five-word shingles. Its signature has
``POSITIONS`` symbols of eight bits, one per hash function; a symbol differs
with the probability of one minus the similarity. All pairs of signatures that
differ in at most ``distance(percent)`` symbols, an odd number, are found: cut
into chunks of which each two cover two more symbols of distance, by the
pigeonhole principle one chunk differs in at most one symbol, and every such
error is enumerated by masking a symbol of the chunk. Links are then confirmed
on the full sets.

Equal sets are one class before anything is paired. No pairs leave a task:
a task compares two bounded blocks and passes on a star per group it links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.llm.components import connected_components, own_exchange
from tagloom.llm.words import WordHashes, arrow_schema, free, mixed, rolled, split_words
from tagloom.operators.staging import in_few_tasks, stage

SHINGLE = 5
POSITIONS = 64
# Least similarity of a link, in percent: that of the query, and that of other
# work on word shingles.
PERCENT, STAGE_PERCENT = 85, 80
# Chance that the signatures of a pair at the least similarity lie too far apart.
MOST_MISSED = 2e-6
# Rows of one block of a pair that a task compares.
BUCKET_BLOCK = 2048
SET_BLOCK = 512

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance(percent: int) -> int:
    """Least odd distance beyond which lie at most ``MOST_MISSED`` of the pairs
    with the similarity ``percent``: 25 symbols at 85, 29 at 80."""
    p = (100 - percent) / 100 * 255 / 256
    chances = [comb(POSITIONS, k) * p**k * (1 - p) ** (POSITIONS - k) for k in range(POSITIONS + 1)]
    return next(d for d in range(1, POSITIONS, 2) if sum(chances[d + 1 :]) <= MOST_MISSED or d == POSITIONS - 1)


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; of a shorter text, the whole
    sequence; none without words."""
    words = split_words(text)
    return np.unique(rolled(hashes.of(words), SHINGLE)) if words else np.zeros(0, np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """Low bytes of the least hash per function, over blocks of bounded size."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048]
        h = part[None, :] * FACTORS[:, None]
        h ^= h >> np.uint64(32)
        least = np.minimum(least, h.min(axis=1))
    return (mixed(least) & np.uint64(0xFF)).astype(np.uint8)


MOST_DIFFERENT = distance(PERCENT)


def keys_of(sign: np.ndarray, most: int = MOST_DIFFERENT) -> np.ndarray:
    """Keys under which signatures (rows) at a distance up to ``most`` meet:
    every chunk with every symbol masked out."""
    wide = sign.astype(np.uint64) + np.uint64(1)
    cuts = np.linspace(0, POSITIONS, most // 2 + 2).astype(int)
    keys = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        for masked in range(low, high):
            h = np.full(len(sign), len(keys), np.uint64)
            for at in range(low, high):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + (np.uint64(0) if at == masked else wide[:, at]))
            keys.append(h)
    return np.stack(keys, 1)


class Forest:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def joined(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins the pairs of rows; returns those that were not connected before.
        A portion at a time, so that of the pairs of a large group, which are
        its size squared, most are dropped by their roots without a step each."""
        out, portion = [], max(256, len(self.up))
        while len(a):
            head = zip(a[:portion].tolist(), b[:portion].tolist(), strict=True)
            out += [(x, y) for x, y in head if self.join(x, y)]
            a, b = a[portion:], b[portion:]
            if len(a):
                roots = np.array([self.root(x) for x in range(len(self.up))])
                apart = roots[a] != roots[b]
                a, b = a[apart], b[apart]
        return out

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def star_edges(ids: np.ndarray, forest: Forest, joins: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The trees that ``joins`` made, each as a star about its least id. Blocks
    that share rows then agree on the centres, so few steps join the stars."""
    if len(joins) < 2:
        return [(int(ids[x]), int(ids[y])) for x, y in joins]
    nodes = sorted({x for join in joins for x in join})
    roots = [forest.root(x) for x in nodes]
    least: dict[int, int] = {}
    for i, root in zip(ids[nodes].tolist(), roots, strict=True):
        least[root] = min(i, least.get(root, i))
    return [(least[root], i) for i, root in zip(ids[nodes].tolist(), roots, strict=True) if i != least[root]]


def described(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``doc_id, same, n_shingles, set_hash, sign``, one row per input row;
    ``same`` is the SHA-256 of its text."""
    kind = "doc_id long, same binary, n_shingles long, set_hash binary, sign binary"
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in source:
            rows = []
            for doc_id, value, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items = shingles(value, hashes)
                if len(items):
                    digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                    rows.append((doc_id, same, len(items), digest, signature(items).tobytes()))
                else:
                    rows.append((doc_id, same, 0, None, None))
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return docs.select(
        F.col(id_column).cast("long").alias("i"), F.col(text).alias("t"), same_text(F.col(text)).alias("s")
    ).mapInArrow(run, kind)


def same_text(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def meeting_places(reps: DataFrame, most: int) -> DataFrame:
    kind = "key long, id long"
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, POSITIONS)
            keys = keys_of(sign, most)
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(ids)], schema=arrow
            )

    return reps.select("id", "sign").mapInArrow(run, kind)


def in_blocks(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Give each row the cells of its key's grid of block pairs: ``lo <= hi``
    number the two blocks, ``own`` the row's. A key within one block has one."""
    blocks = F.ceil(F.col(size) / F.lit(float(block))).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    wide = rows.withColumn("blocks", blocks).withColumn("own", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return wide.select("*", other).select(
        *rows.columns, "own",
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
    )


def runs_of(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[pa.Table]:
    """Rows of a sorted partition, cut where the leading columns change."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in columns], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        if kept:
            last = [kept[-1].column(i)[-1].as_py() for i in columns]
            if last != keys[0].tolist():
                yield pa.Table.from_batches(kept)
                kept = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if kept and low:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(low, high - low))
    if kept:
        yield pa.Table.from_batches(kept)


def edges_out(found: list[tuple[int, int]], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)


EDGES = "a long, b long"


def signature_links(reps: DataFrame, most: int) -> DataFrame:
    """Stars, per meeting place, that connect what pairs within the distance do."""
    arrow = arrow_schema(StructType.fromDDL(EDGES))
    places = meeting_places(reps, most)
    shared = places.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    cells = in_blocks(shared.join(reps.select("id", "sign"), "id"), "key", "n", BUCKET_BLOCK)
    order = ["key", "lo", "hi"]
    placed = cells.select("key", "lo", "hi", "id", "own", "sign").repartition(*order)
    placed = placed.sortWithinPartitions(*order)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in runs_of(source, [0, 1, 2]):
            ids = rows.column("id").to_numpy()
            sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            forest, joins = Forest(len(ids)), []
            step = max(1, (1 << 22) // (len(ids) * POSITIONS))
            for at in range(0, len(ids), step):
                far = (sign[at : at + step, None, :] != sign[None, :, :]).sum(2, dtype=np.uint8)
                x, y = np.nonzero(far <= most)
                x = x + at
                joins += forest.joined(x[x < y], y[x < y])
            found += star_edges(ids, forest, joins)
            if len(found) > 20_000:
                yield edges_out(found, arrow)
                found = []
        yield edges_out(found, arrow)

    return placed.mapInArrow(run, EDGES)


def confirmed_links(
    docs: DataFrame, groups: DataFrame, sets: DataFrame, id_column: str, text: str, percent: int
) -> DataFrame:
    """Stars, per candidate group, that connect what the true links do:
    similarity at least ``percent`` on the full sets, in whole numbers. A set is
    read from one text that has it."""
    arrow = arrow_schema(StructType.fromDDL(EDGES))
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = groups.join(sizes.select(own_exchange("component"), "n"), "component")
    members = members.join(sets.select(F.col("id").alias("node"), "first", "same"), "node")
    texts = docs.select(
        F.col(id_column).cast("long").alias("first"), same_text(F.col(text)).alias("same"), F.col(text).alias("t")
    )
    wanted = texts.join(members.withColumnRenamed("node", "id"), ["first", "same"])
    cells = in_blocks(shingle_sets(wanted), "component", "n", SET_BLOCK)
    order = ["component", "lo", "hi"]
    placed = cells.select(*order, "id", "own", "items").repartition(*order).sortWithinPartitions(*order)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(source, [0, 1, 2]):
            ids = rows.column("id").to_numpy()
            items = [np.frombuffer(x, np.uint64) for x in rows.column("items").to_pylist()]
            yield edges_out(true_links(ids, items, percent), arrow)

    return placed.mapInArrow(run, EDGES)


def shingle_sets(rows: DataFrame) -> DataFrame:
    kind = "id long, component long, n long, items binary"
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in source:
            # Repeated rows of a text meet in one task.
            ids = batch.column(0).to_pylist()
            new = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            batch = batch.take(pa.array(new, pa.int64()))
            items = [shingles(t, hashes).tobytes() for t in batch.column(3).to_pylist()]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(items, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.select("id", "component", "n", "t").mapInArrow(run, kind)


def true_links(ids: np.ndarray, items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Count intersections of all pairs, a band of shared shingles at a time."""
    n = len(ids)
    sizes = np.array([len(x) for x in items], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values = np.concatenate(items) if n else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    number = np.cumsum(first) - 1
    often = np.bincount(number) > 1 if len(number) else np.zeros(0, bool)
    keep = often[number] if len(number) else np.zeros(0, bool)
    owner, number = owner[keep], np.unique(number[keep], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    width = int(number.max()) + 1 if len(number) else 0
    for low in range(0, width, 4096):
        a, b = np.searchsorted(number, [low, low + 4096])
        part = np.zeros((n, min(4096, width - low)), np.float32)
        part[owner[a:b], number[a:b] - low] = 1
        common += part @ part.T
    both = sizes[:, None] + sizes[None, :] - common.astype(np.int64)
    x, y = np.nonzero(100 * common.astype(np.int64) >= percent * both)
    forest = Forest(n)
    return star_edges(ids, forest, forest.joined(x[x < y], y[x < y]))


def grouped(docs: DataFrame, id_column: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`described`, staged, and the groups of linked sets:
    ``set_hash``, ``first`` (the set's least doc_id), ``group`` and ``least``
    (the group's least doc_id)."""
    rows = stage(described(docs, id_column, text))
    n = rows.count()
    # The number is a set's own for good once the table is written, also where
    # one doc_id is the first of several sets.
    sets = stage(
        in_few_tasks(
            rows.filter("set_hash is not null and doc_id is not null")
            .groupBy("set_hash")
            .agg(F.min(F.struct("doc_id", "same")).alias("least"), F.first("sign").alias("sign")),
            n,
        ).select("set_hash", "least.same", F.col("least.doc_id").alias("first"), "sign", F.monotonically_increasing_id().alias("id"))
    )
    candidates = connected_components(stage(signature_links(sets, distance(percent))), "a", "b")
    links = confirmed_links(docs, stage(in_few_tasks(candidates, n)), sets, id_column, text, percent)
    class_of = connected_components(stage(links), "a", "b")
    by_set = sets.join(class_of, sets["id"] == class_of["node"], "left").select(
        "set_hash", "first", F.coalesce("component", "id").alias("group")
    )
    return rows, with_least(by_set, n)


def with_least(by_set: DataFrame, rows: int) -> DataFrame:
    """Staged, with each group's least doc_id; ``rows`` bounds their number."""
    by_set = stage(in_few_tasks(by_set, rows))
    least = by_set.groupBy("group").agg(F.min("first").alias("least"))
    found = by_set.join(least.select(own_exchange("group"), "least"), "group")
    return stage(in_few_tasks(found.select("set_hash", "first", "group", "least"), rows))


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Sets with a similarity of ``percent`` or more are linked.
    Null and empty texts, and texts of separators, have no shingles and stand
    alone. Rows with equal sets are linked. Rows that share a doc_id are one
    node: the links of all its texts are its own. A null doc_id is its own
    component and kept.
    """
    rows, by_set = grouped(docs, id_column, text, percent)
    # Groups that a doc_id with several sets holds together.
    several = (
        rows.filter("set_hash is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high"))
        .filter("low <> high")
        .select("doc_id")
    )
    n = rows.count()
    held = rows.join(several, "doc_id").join(by_set, "set_hash").select("doc_id", "group").distinct()
    held = stage(in_few_tasks(held, n))
    if held.count():
        lowest = held.groupBy("doc_id").agg(F.min("group").alias("low"))
        joined = connected_components(stage(held.join(lowest, "doc_id").select("group", "low")), "group", "low")
        pooled = by_set.join(joined, by_set["group"] == joined["node"], "left").select(
            "set_hash", "first", F.coalesce("component", "group").alias("group")
        )
        by_set = with_least(pooled, n)
    of_set = by_set.select("set_hash", F.col("least").alias("component_id"))
    return (
        rows.join(of_set, "set_hash", "left")
        .select(
            "doc_id", "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are kept, with their own columns: of each group of
    linked texts that of its least doc_id.

    Texts decide for themselves: where one doc_id has several, each stays or
    goes with its own group, so no text goes without one like it that stays.
    Texts without shingles and rows without a doc_id stay, as do repeated rows
    of the doc_id that is kept.
    """
    rows, by_set = grouped(docs, "doc_id", "text", percent)
    name, same = free(docs, "_gone", "_same")
    gone = (
        rows.join(by_set, "set_hash")
        .filter("doc_id <> least")
        .select(F.col("doc_id").alias(name), "same")
        .distinct()
    )
    keyed = docs.withColumn(same, same_text(F.col("text")))
    hit = (F.col("doc_id").cast("long") == F.col(name)) & (F.col(same) == gone["same"])
    return keyed.join(gone, hit, "left_anti").drop(same)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS s FROM (
  SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id"""
