"""Near-duplicate embeddings by PCA-ordered tiled comparison (operator 1).

Unit vectors are turned into the principal axes, so that the leading
coordinates hold the most they can of every dot product. Rows are ordered by
the first one and cut into tiles; two tiles meet unless their ranges on the
leading axes are too far apart. A task compares two tiles block by block: it
adds up leading coordinates, bounds the rest by the product of the suffix
norms, and goes on only for pairs whose bound still reaches the threshold.
No pairs leave a task, only counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.arrays import IntegerArray
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.llm.components import connected_components
from tagloom.llm.near_dup import Forest
from tagloom.llm.words import arrow_schema
from tagloom.operators.staging import stage

COSINE = 0.9
# Rounding of a dot product in turned axes stays far below this; pairs nearer
# to the threshold are computed again from the original vectors.
SLACK = 1e-9
# Rows of a tile: as few tiles as keep tasks busy, as many as fit in memory.
TILE_LEAST, TILE_MOST, TILES_WANTED, TILES_MOST = 1024, 32_768, 24, 2000
BLOCK = 1024
LEADING = 4


def valid_vectors(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``row, id, raw``: rows with a usable vector, as bytes of doubles."""
    v = F.col(vector)
    usable = (
        v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return table.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        F.when(F.coalesce(usable, F.lit(False)), v.cast("array<double>")).alias("v"),
    )


def matrix(values: list, width: int | None = None) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if values else np.zeros((0, width or 0))


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that the squares of very large or small values hold.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """Axes by falling second moment of the unit vectors, over all rows. The
    tasks' sums are added by Spark; the driver sees ``width`` squared numbers."""
    kind = "i int, j int, s double"
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in source:
            if batch.num_rows:
                x = unit(matrix(batch.column(0).to_pylist()))
                total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    sums = rows.select("v").mapInArrow(run, kind).groupBy("i", "j").agg(F.sum("s").alias("s"))
    moments = np.zeros((width, width))
    for r in sums.collect():
        moments[r["i"], r["j"]] = r["s"]
    _, axes = np.linalg.eigh((moments + moments.T) / 2)
    return axes[:, ::-1].copy()


def turned(rows: DataFrame, axes: np.ndarray) -> DataFrame:
    kind = "row long, id long, lead array<double>, unit binary"
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(2).to_pylist()))
            lead = (x @ axes)[:, :LEADING]
            columns = [
                batch.column(0), batch.column(1),
                pa.array(list(lead), arrow.field("lead").type), pa.array([r.tobytes() for r in x]),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.select("row", "id", "v").mapInArrow(run, kind)


def tile_pairs(placed: DataFrame, cosine: float) -> DataFrame:
    """``tile, lo, hi``: the pairs of tiles that each tile takes part in. Two
    points at the threshold lie within ``sqrt(2 - 2 cosine)`` on every axis."""
    ranges = placed.groupBy("tile").agg(
        *[F.min(F.get("lead", F.lit(k))).alias(f"a{k}") for k in range(LEADING)],
        *[F.max(F.get("lead", F.lit(k))).alias(f"z{k}") for k in range(LEADING)],
    )
    rows = sorted(ranges.collect())
    far = 2 - 2 * cosine + SLACK
    pairs = []
    for n, p in enumerate(rows):
        for q in rows[n:]:
            gaps = [
                max(0.0, (q[f"a{k}"] or 0) - (p[f"z{k}"] or 0), (p[f"a{k}"] or 0) - (q[f"z{k}"] or 0))
                for k in range(LEADING)
            ]
            if sum(g * g for g in gaps) <= far:
                pairs += [(t, p["tile"], q["tile"]) for t in {p["tile"], q["tile"]}]
    # At most the square of a number of tiles that the tile size bounds.
    return placed.sparkSession.createDataFrame(pairs or [(-1, -1, -1)], "tile int, lo int, hi int")


def close_pairs(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, cosine: float):
    """Index pairs with the cosine; ``x, y`` in principal axes, ``ux, uy`` as given."""
    width = x.shape[1]
    first = max(1, width // 4)
    part = x[:, :first] @ y[:, :first].T
    rest = np.sqrt(np.maximum(0, 1 - (x[:, :first] ** 2).sum(1)))[:, None]
    other = np.sqrt(np.maximum(0, 1 - (y[:, :first] ** 2).sum(1)))[None, :]
    a, b = np.nonzero(part + rest * other >= cosine - SLACK)
    if not len(a):
        return a, b
    if 4 * len(a) > part.size:
        # Too many left to pick out: finish the whole block at once.
        total = (part + x[:, first:] @ y[:, first:].T)[a, b]
        sure = total >= cosine - SLACK
        a, b, total = a[sure], b[sure], total[sure]
    else:
        total, low = part[a, b], first
        while low < width and len(a):
            high = min(width, 2 * low)
            total = total + np.einsum("ij,ij->i", x[a, low:high], y[b, low:high])
            bound = total
            if high < width:
                bound = total + np.sqrt((x[a, high:] ** 2).sum(1) * (y[b, high:] ** 2).sum(1))
            alive = bound >= cosine - SLACK
            a, b, total, low = a[alive], b[alive], total[alive], high
    unsure = np.flatnonzero(np.abs(total - cosine) <= SLACK)
    ok = total >= cosine
    ok[unsure] = np.einsum("ij,ij->i", ux[a[unsure]], uy[b[unsure]]) >= cosine
    return a[ok], b[ok]


LINKS = "row long, n long, a long, b long"


def links(placed: DataFrame, axes: np.ndarray, cosine: float) -> DataFrame:
    """Per pair of tiles: ``row, n`` (links of a row) and ``a, b`` (a forest)."""
    width = axes.shape[0]
    cells = placed.join(F.broadcast(tile_pairs(placed, cosine)), "tile").withColumns(
        {"named": F.col("id").isNotNull(), "id": F.coalesce("id", F.lit(0))}
    )

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        u = np.frombuffer(b"".join(cell["unit"]), np.float64).reshape(-1, width)
        x = u @ axes
        left = np.flatnonzero((cell["tile"] == cell["lo"]).to_numpy())
        right = np.flatnonzero((cell["tile"] == cell["hi"]).to_numpy())
        same = bool(len(left) == len(cell) and len(right) == len(cell))
        counts, forest = np.zeros(len(cell), np.int64), Forest(len(cell))
        # Without nulls, which would turn ids into floating point.
        ids, named, found = cell["id"].to_numpy(), cell["named"].to_numpy(), []
        for i in range(0, len(left), BLOCK):
            p = left[i : i + BLOCK]
            for j in range(i if same else 0, len(right), BLOCK):
                q = right[j : j + BLOCK]
                a, b = close_pairs(x[p], x[q], u[p], u[q], cosine)
                a, b = p[a], q[b]
                if same and i == j:
                    a, b = a[a < b], b[a < b]
                counts += np.bincount(a, minlength=len(cell)) + np.bincount(b, minlength=len(cell))
                # A row without an id counts its links but joins no tree.
                both = named[a] & named[b]
                a, b = a[both], b[both]
                # Rows already in one tree add nothing; test before the loop.
                roots = np.array([forest.root(k) for k in range(len(cell))]) if len(a) else None
                if roots is not None:
                    new = roots[a] != roots[b]
                    for s, t in zip(a[new].tolist(), b[new].tolist(), strict=True):
                        if forest.join(s, t):
                            found.append((ids[s], ids[t]))
        some = np.flatnonzero(counts)
        empty = np.arange(len(some) + len(found)) >= len(some)
        left, right = np.array(found, np.int64).reshape(-1, 2).T
        fill, pad = np.zeros(len(found), np.int64), np.zeros(len(some), np.int64)
        return pd.DataFrame({
            "row": IntegerArray(np.concatenate([cell["row"].to_numpy()[some], fill]), empty),
            "n": IntegerArray(np.concatenate([counts[some], fill]), empty),
            "a": IntegerArray(np.concatenate([pad, left]), ~empty),
            "b": IntegerArray(np.concatenate([pad, right]), ~empty),
        })

    return cells.groupBy("lo", "hi").applyInPandas(compare, LINKS)


def near_copies(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    Vectors that are null, empty, zero, or hold a null or non-finite component
    link with nothing and are kept. Vectors of another length than the most
    frequent one are compared among themselves by the same steps. Equal vectors
    link like all others. Rows that share an id are one node of the graph, but
    each counts its own links. A null id is kept and joins no component.
    """
    rows = stage(valid_vectors(table, id_column, vector))
    widths = [r["w"] for r in rows.filter("v is not null").groupBy(F.size("v").alias("w")).count().collect()]
    spark = table.sparkSession
    counted = spark.createDataFrame([], "row long, n_links long")
    edges = spark.createDataFrame([], "a long, b long")
    for width in sorted(widths):
        own = rows.filter(F.size("v") == width)
        n = own.count()
        axes = principal_axes(own, width)
        basis = stage(turned(own, axes))
        size = max(min(TILE_MOST, max(TILE_LEAST, n // TILES_WANTED)), n // TILES_MOST)
        tiles = -(-n // size)
        cuts = basis.select(
            F.percentile_approx(F.get("lead", F.lit(0)), [k / tiles for k in range(1, tiles)], 10_000)
        ).first()[0] if tiles > 1 else []
        band = sum((F.when(F.get("lead", F.lit(0)) > c, 1).otherwise(0) for c in cuts), F.lit(0))
        # Equal leading coordinates would fill one band: bands are split evenly.
        banded = stage(basis.withColumn("band", band))
        full = {r["band"]: -(-r["count"] // size) for r in banded.groupBy("band").count().collect()}
        parts = F.create_map(*[F.lit(x) for kv in full.items() for x in kv])[F.col("band")]
        most = max(full.values())
        tile = (F.col("band") * F.lit(most) + F.pmod(F.xxhash64("row"), parts)).cast("int")
        found = stage(links(banded.withColumn("tile", tile), axes, cosine))
        counted = counted.union(found.filter("row is not null").groupBy("row").agg(F.sum("n")))
        edges = edges.union(found.filter("a is not null and b is not null").select("a", "b"))
    component = connected_components(edges, "a", "b")
    return (
        rows.select("row", F.col("id").alias(id_column))
        .join(counted, "row", "left")
        .join(component, F.col(id_column) == F.col("node"), "left")
        .select(
            id_column,
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", id_column).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
    )


def op1_embedding_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) = 0
      OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
      OR len(list_filter(embedding, lambda x: x <> 0)) = 0
    THEN NULL ELSE CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE a.e IS NOT NULL AND b.e IS NOT NULL AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v LEFT JOIN n ON n.x = v.vec_id JOIN c ON c.x = v.vec_id"""
