"""Toxicity by nearest labelled examples (operator 6).

Examples and documents are TF-IDF vectors over every term of the examples. A
term that goes with the label beyond chance weighs more, by its evidence; none
is left out. The examples of a bounded sample form an inverted index. Its
``DENSE`` commonest terms, which hold most postings that documents meet, are a
matrix that many documents are multiplied with at once; of the others each
document adds up its terms' postings. So every cosine is worked out in full.
Neighbours vote with their cosine; a logistic curve fitted on the examples, each
without itself, makes the vote a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.llm.words import arrow_schema, coded, hashes_of, remainder
from tagloom.operators.staging import stage

# Bound of the fitted model: labelled rows it learns from, by smallest id hash.
MOST_EXAMPLES = 6_000
NEIGHBOURS = 15
# Terms kept as rows of a matrix, and documents multiplied with it at once.
DENSE = 256
TOGETHER = 128
# Standard errors from which a term's evidence multiplies its weight.
CHANCE = 4.0
# Weight of the base rate against the neighbours' votes.
PRIOR = 0.05
THRESHOLD = 0.3
EDGES = ".,;:!?\"'()[]{}<>*#&%$|-_"


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, term hash, times`` of a batch, by text and term. A term is a
    lower-cased word without the marks around it."""
    words, at, sizes = coded(texts)
    bare = pc.ascii_trim(words, characters=EDGES)
    full = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    terms, term_of = np.unique(hashes_of(bare), return_inverse=True)
    text_of = np.repeat(np.arange(len(sizes)), sizes)[full[at]]
    width = max(1, len(terms))
    code, times = np.unique(text_of * width + term_of[at[full[at]]], return_counts=True)
    return code // width, terms[code % width] if len(code) else np.zeros(0, np.int64), times


def known_counts(texts: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``term_counts`` with term numbers, of the terms in ``hashes`` alone."""
    text, term, times = term_counts(texts)
    if not len(hashes):
        return text[:0], term[:0], times[:0]
    number = np.minimum(np.searchsorted(hashes, term), len(hashes) - 1)
    known = hashes[number] == term
    return text[known], number[known], times[known]


def evidence(toxic: np.ndarray, rest: np.ndarray, n_toxic: int, n_rest: int) -> np.ndarray:
    """Standard errors between a term's rates among toxic and other examples:
    the root of the likelihood-ratio statistic."""

    def likelihood(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            one = np.where(k > 0, k * np.log(p), 0.0)
            return one + np.where(n > k, (n - k) * np.log1p(-p), 0.0)

    if not n_toxic or not n_rest:
        return np.zeros(len(toxic))
    p = (toxic + rest) / (n_toxic + n_rest)
    apart = likelihood(toxic, n_toxic, toxic / n_toxic) + likelihood(rest, n_rest, rest / n_rest)
    return np.sqrt(np.maximum(2 * (apart - likelihood(toxic, n_toxic, p) - likelihood(rest, n_rest, p)), 0.0))


def document_frequency(docs: DataFrame, hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those with each term. A task counts in
    one array, as long as the examples have terms."""
    kind = "term int, n long"
    arrow = arrow_schema(StructType.fromDDL(kind))
    size = len(hashes)
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in source:
            _, number, _ = known_counts(batch.column(0), shared.value)
            total[:size] += np.bincount(number, minlength=size)
            total[size] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=arrow)

    found = docs.select("text").mapInArrow(run, kind).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size + 1, np.int64)
    total[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return int(total[size]), total[:size]


@dataclass
class Index:
    """Examples as postings by term, the commonest terms as rows of a matrix.

    What travels are the counts, in their smallest types; weights and the matrix
    are worked out where the index arrives."""

    hashes: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    length: np.ndarray  # term -> number of postings
    post_doc: np.ndarray
    post_count: np.ndarray
    base: float

    def __post_init__(self):
        term, doc = np.repeat(np.arange(len(self.weight)), self.length), self.post_doc.astype(np.intp)
        value = (1 + np.log(self.post_count.astype(float))) * self.weight[term]
        value /= np.sqrt(np.bincount(doc, value * value, len(self.ids)))[doc]
        self.doc, self.value = doc, value
        self.start = np.append(0, np.cumsum(self.length, dtype=np.int64))  # term -> first posting
        common = np.argsort(-self.length.astype(np.int64), kind="stable")[:DENSE]
        self.row = np.full(len(self.weight), -1)  # term -> row of the matrix, or -1
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(self.ids)))
        held = self.row[term] >= 0
        self.dense[self.row[term[held]], doc[held]] = value[held]
        self.slope, self.shift, self.sent = 1.0, 0.0, None

    def __reduce__(self):
        return Index, tuple(getattr(self, f.name) for f in fields(self))

    def shared(self, spark) -> Broadcast:
        """Sent once, and bounded by the sample's texts."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return unit_vector(self.weight, terms, counts)

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosine of each vector (rows) with
        each example. Always ``TOGETHER`` rows are multiplied, so that a vector's
        sums do not depend on those beside it."""
        q = np.zeros((-(-len(vectors) // TOGETHER) * TOGETHER, len(self.dense)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            q[i, row[row >= 0]] = weights[row >= 0]
        out = np.empty((len(q), len(self.ids)))
        for i in range(0, len(q), TOGETHER):
            np.matmul(q[i : i + TOGETHER], self.dense, out=out[i : i + TOGETHER])
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, but: int = -1, k: int = NEIGHBOURS, begun: np.ndarray | None = None):
        """Example numbers and cosines of the ``k`` nearest with a term in
        common; equal cosines by number. ``begun``: the vector's row of ``common``."""
        score = self.common([(terms, weights)])[0] if begun is None else begun.copy()
        rare = self.row[terms] < 0
        low, high = self.start[terms[rare]], self.start[terms[rare] + 1]
        if rare.any():
            spans = list(map(slice, low.tolist(), high.tolist()))
            doc, value = (np.concatenate([x[span] for span in spans]) for x in (self.doc, self.value))
            score += np.bincount(doc, value * np.repeat(weights[rare], high - low), len(score))
        if 0 <= but < len(score):
            score[but] = 0.0
        # Beyond the twelfth digit sums differ by their order alone.
        least = np.partition(score, -k)[-k] - 1e-12 if len(score) > k else 0.0
        docs = np.flatnonzero((score > 0) & (score >= least))
        cosines = np.round(score[docs], 12)
        best = np.lexsort((docs, -cosines))[:k]
        return docs[best], cosines[best]

    def vote(self, docs: np.ndarray, cosines: np.ndarray) -> float:
        total = cosines.sum() + PRIOR
        return float(((cosines * self.labels[docs]).sum() + PRIOR * self.base) / total)

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.shift))))


def unit_vector(weight: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * weight[terms]
    return w / np.sqrt((w * w).sum()) if len(w) else w


def smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def build_index(hashes: np.ndarray, weight: np.ndarray, rows: list) -> Index:
    """``rows`` are (id, label, terms, counts); rows without a term only
    enter the base rate. Examples are numbered by their leading terms."""
    full = [(int(t[np.argmax(unit_vector(weight, t, np.asarray(c, float)))]), i, y, t, c) for i, y, t, c in rows if len(t)]
    full.sort(key=lambda r: r[:2])
    none = np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(full)), [len(r[3]) for r in full])
    term, count = (np.concatenate([none, *(r[k] for r in full)]) for k in (3, 4))
    order = np.lexsort((doc, term))
    return Index(
        hashes, weight,
        np.array([r[1] for r in full], np.int64), np.array([r[2] for r in full], np.float64),
        smallest(np.bincount(term, minlength=len(weight))), smallest(doc[order]), smallest(count[order]),
        (sum(y for _, y, _, _ in rows) + 0.5) / (len(rows) + 1.0),
    )


def calibrated(index: Index, votes: np.ndarray, labels: np.ndarray) -> None:
    """Logistic regression of the label on the vote, by Newton steps with a
    small penalty; a class that is absent leaves a flat curve at its rate."""
    x = np.stack([votes, np.ones(len(votes))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        grad = x.T @ (labels - p) - 1e-2 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.shift = float(max(beta[0], 0.0)), float(beta[1])


def labelled_examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, toxic, text`` of the training sample, one row an id.

    Of rows that repeat a doc_id in ``labels`` the largest label counts, in
    ``docs`` the text of smallest hash. The sample is the ids with the smallest
    hashes, at most ``MOST_EXAMPLES``.
    """
    known = (
        labels.filter("toxic is not null and doc_id is not null")
        .filter(remainder(F.col("doc_id"), 4) != 2)
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(MOST_EXAMPLES)
    )
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
        .join(F.broadcast(known), "id")
        .groupBy("id").agg(F.first("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"))
        .select("id", "toxic", "t.text")
    )


def example_terms(examples: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``id, toxic, term hashes, times`` of every example, by id."""
    kind = "id long, toxic int, terms array<long>, times array<long>"
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            text, term, times = term_counts(batch.column(2))
            ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=arrow.names).cast(arrow)

    # At most MOST_EXAMPLES rows.
    found = examples.mapInArrow(run, kind).toArrow().sort_by("id")
    lists = [found.column(n).combine_chunks() for n in ("terms", "times")]
    columns = [[lst[i].values.to_numpy() for i in range(found.num_rows)] for lst in lists]
    return list(zip(found.column("id").to_pylist(), found.column("toxic").to_pylist(), *columns, strict=True))


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """Learn from labelled training rows; document frequencies cover all
    documents."""
    examples = stage(labelled_examples(docs, labels))
    rows = example_terms(examples)
    toxic = np.array([r[1] for r in rows], np.int64)
    terms = np.concatenate([np.zeros(0, np.int64), *(r[2] for r in rows)])
    hashes, number = np.unique(terms, return_inverse=True)
    label = np.repeat(toxic, [len(r[2]) for r in rows])
    seen = [np.bincount(number[label == y], minlength=len(hashes)) for y in (1, 0)]
    proof = evidence(*seen, int((toxic == 1).sum()), int((toxic == 0).sum()))
    n, df = document_frequency(docs, hashes)
    weight = (np.log((1 + n) / (1 + df)) + 1) * np.where(proof >= CHANCE, proof, 1.0)
    ends = np.cumsum([0, *(len(r[2]) for r in rows)])
    index = build_index(hashes, weight, [(r[0], r[1], number[a:z], r[3]) for r, a, z in zip(rows, ends, ends[1:], strict=False)])
    found = voted(examples.select("id", "text", "toxic"), index, True).select("toxic", "vote").toArrow().sort_by([("vote", "ascending"), ("toxic", "ascending")])
    calibrated(index, found.column("vote").to_numpy(), found.column("toxic").to_numpy().astype(float))
    return index


def voted(rows: DataFrame, index: Index, examples: bool = False) -> DataFrame:
    """``id, vote, neighbours`` of rows ``id, text`` and ``toxic``, if there; an
    example is not its own neighbour."""
    shared = index.shared(rows.sparkSession)
    kind = "id long, vote double, neighbours array<long>" + (", toxic int" if examples else "")
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        place = {int(i): k for k, i in enumerate(index.ids)} if examples else {}
        for batch in source:
            text, term, times = known_counts(batch.column(1), index.hashes)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            ids = batch.column(0).to_pylist()
            vectors = [(term[a:z], index.vector(term[a:z], times[a:z].astype(float))) for a, z in zip(ends, ends[1:], strict=False)]
            votes, near = [], []
            for first in range(0, len(ids), TOGETHER):
                some = vectors[first : first + TOGETHER]
                for i, vector, begun in zip(ids[first : first + TOGETHER], some, index.common(some), strict=False):
                    docs, cosines = index.nearest(*vector, place.get(i, -1), begun=begun)
                    votes.append(index.vote(docs, cosines))
                    near.append(index.ids[docs[:3]].tolist())
            columns = [batch.column(0), pa.array(votes, pa.float64()), pa.array(near, arrow.field(2).type), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, kind)


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """``doc_id, score, neighbours`` (the nearest examples' ids, as evidence).

    Null and empty texts, and texts without a term of the examples, get the
    score of the base rate. Repeated rows are scored alike."""
    curve = 1 / (1 + F.exp(-(index.slope * F.col("vote") + index.shift)))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return voted(rows, index).select(F.col("id").alias("doc_id"), curve.alias("score"), "neighbours")


def op6_toxicity_neighbours(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, index).select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "neighbours",
    )
