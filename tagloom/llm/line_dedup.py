"""Repeated passages by winnowing over line hashes (operator 10).

A document is its lines that hold a word, compared without the separators at
their ends. A *run* at a line is the shortest stretch of lines from there with
at least ``RUN_WORDS`` words, a *gram* the same with ``GRAM_WORDS``. Of all
grams that lie inside the run at a line, the one with the least hash is the
line's fingerprint. Two equal runs choose the same gram, so a repeated stretch
of ``RUN_WORDS`` words always shares a fingerprint, although only a part of the
grams is kept.

Fingerprints found at two positions are matches. They are extended both ways by
runs read forwards, which reach a repeated stretch's first line, and runs read
backwards (the shortest stretch with ``RUN_WORDS`` words that *ends* at a line),
which reach its last one. Of any stretch of ``RUN_WORDS`` words or more each
line lies in a run of one kind within the stretch, so all lines of a repeated
stretch go, whichever earlier text it equals. Every run that equals an earlier
one, in the order of doc_id and line, is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.llm.components import own_exchange
from tagloom.llm.words import WordHashes, arrow_schema, free, mixed
from tagloom.operators.staging import stage

RUN_WORDS = 50
GRAM_WORDS = 20
PRINTS = "doc_id long, text_hash long, print long, gram int, starts array<int>, ends array<int>, runs array<long>"


def lines_of(text: str | None) -> tuple[list[bytes], list[int], list[int]]:
    """Lines that hold a word (stripped), their numbers and word counts."""
    kept, numbers, words = [], [], []
    for number, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        bare = line.strip(b" \t\n\x0b\x0c\r")
        if bare:
            kept.append(bare)
            numbers.append(number)
            words.append(len(bare.split()))
    return kept, numbers, words


def reach(words: np.ndarray, least: int) -> np.ndarray:
    """Last line of the shortest stretch from each line with ``least`` words;
    past the end where there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    return np.searchsorted(total, total[:-1] + least) - 1


def backward_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest stretch with ``RUN_WORDS`` words that
    ends at each line, where there is one."""
    total = np.concatenate([[0], np.cumsum(words)])
    start = np.searchsorted(total, total[1:] - RUN_WORDS, side="right") - 1
    end = np.flatnonzero(start >= 0)
    return start[end], end


def stretch_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the lines from each ``start`` to its ``end`` (inclusive)."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), odd)]), dtype=np.uint64)
        # Sum of h[i] * odd**-i, so that stretches compare after a shift.
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        backwards = np.cumprod(
            np.concatenate([[np.uint64(1)], np.full(len(h), inverse)]), dtype=np.uint64
        )
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * backwards[:-1], dtype=np.uint64)])
        sums = (total[end + 1] - total[start]) * powers[start]
        return mixed(sums + np.uint64(1) * (end - start + 1).astype(np.uint64))


def winnow(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Per run of either kind: its end and hash, the chosen gram with its hash,
    and its start. A backward run takes the gram of the forward run at its
    start, which lies in it. None if the document is shorter than a run."""
    run_end = reach(words, RUN_WORDS)
    full = int((run_end < len(h)).sum())
    if not full:
        return None
    gram_end = reach(words, GRAM_WORDS)
    grams = int((gram_end < len(h)).sum())
    run_end = run_end[:full]
    gram_hash = stretch_hash(h, np.arange(grams), gram_end[:grams])
    # Last gram that ends inside the run; gram ends never decrease.
    last = np.searchsorted(gram_end[:grams], run_end, side="right") - 1
    best = np.arange(full)
    width = int((last - best).max()) if full else 0
    low = gram_hash[:full].copy()
    for step in range(1, width + 1):
        at = np.arange(full) + step
        ok = at <= last
        value = gram_hash[np.minimum(at, grams - 1)]
        # The rightmost of equal minima, as both copies must choose alike.
        better = ok & (value <= low)
        low = np.where(better, value, low)
        best = np.where(better, at, best)
    start, end = backward_runs(words)
    other = run_end[start] != end
    start = np.concatenate([np.arange(full), start[other]])
    end = np.concatenate([run_end, end[other]])
    return end, stretch_hash(h, start, end), best[start], low[start], start


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chosen gram of each document, with the runs that chose it."""
    kind = arrow_schema(StructType.fromDDL(PRINTS))

    def made(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(rows, kind, strict=True)], schema=kind
        )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(100_000)
        for batch in source:
            rows: list[list] = [[] for _ in kind]
            size = 0
            for doc_id, text_hash, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, _, words = lines_of(value)
                found = winnow(hashes.of(lines), np.array(words, np.int64)) if lines else None
                if found is None:
                    continue
                end, run_hash, best, low, start = found
                order = np.argsort(best, kind="stable")
                cuts = np.flatnonzero(np.diff(best[order])) + 1
                for part in np.split(order, cuts):
                    one = (
                        doc_id, text_hash, low[part[0]].astype(np.int64), int(best[part[0]]),
                        start[part].astype(np.int32), end[part].astype(np.int32), run_hash[part].astype(np.int64),
                    )
                    for column, v in zip(rows, one, strict=True):
                        column.append(v)
                    size += len(part)
                if size > 200_000:
                    yield made(rows)
                    rows, size = [[] for _ in kind], 0
            yield made(rows)

    keyed = docs.select(
        F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t")
    )
    return keyed.mapInArrow(run, PRINTS)


def later_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, spans``: stretches to delete, as first and last line
    among the lines with a word; they may overlap."""
    place = ["doc_id", "text_hash"]
    prints = stage(fingerprints(docs, id_column, text))
    spot = F.struct(*place, "gram")
    matched = (
        prints.groupBy("print")
        .agg(F.min(spot).alias("a"), F.max(spot).alias("z"))
        .filter(~F.col("a").eqNullSafe(F.col("z")))
        .select(own_exchange("print"))
    )
    runs = prints.join(matched, "print", "left_semi").select(
        *place, F.explode(F.arrays_zip("starts", "ends", "runs")).alias("r")
    )
    runs = stage(runs.select(*place, "r.starts", "r.ends", "r.runs"))
    first = runs.groupBy("runs").agg(
        F.min(F.struct(*place, "starts")).alias("first"), F.count("*").alias("n")
    )
    again = runs.join(first.filter("n > 1").select(own_exchange("runs"), "first"), "runs").filter(
        ~F.struct(*place, "starts").eqNullSafe(F.col("first"))
    )
    return again.groupBy(*place).agg(F.collect_list(F.struct("starts", "ends")).alias("spans"))


ADDED = ("_lines", "_removed", "_spans")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with their text cleaned, plus ``_lines`` (lines with
    a word), ``_removed`` (how many of them went) and ``_spans`` (their first
    and last line numbers in the original text, joined where they touch). The
    three are named by ``free`` where ``docs`` has such columns.

    Lines without a word go with a removed line before them. A null text stays
    null; an empty one stays empty. A null doc_id comes first in the order. Rows
    that repeat both id and text count as one document and fare alike; rows
    that share an id only are ordered by the hash of their texts. A text whose
    own lines repeat keeps the first copy. Other columns pass through.
    """
    lines, removed, places, key, value = free(docs, *ADDED, "_key", "_hash")
    spans = later_runs(docs, id_column, text).select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), F.col("spans").alias(places)
    )
    known = docs.withColumns({key: F.col(id_column).cast("long"), value: F.xxhash64(text)})
    same = known[key].eqNullSafe(spans["id"]) & (known[value] == spans["h"])
    joined = known.join(spans, same, "left").select(*[known[c] for c in docs.columns], places)
    out = f"`{text}` string, `{lines}` int, `{removed}` int, `{places}` array<struct<first:int,last:int>>"
    return cleaned(joined, text, places, out)


def cleaned(joined: DataFrame, text: str, places: str, out: str) -> DataFrame:
    added = StructType.fromDDL(out)
    names = [f.name for f in added]
    others = [f for f in joined.schema if f.name not in names]
    schema = StructType(others + list(added))
    arrow = arrow_schema(schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts, spans = batch.column(text).to_pylist(), batch.column(places).to_pylist()
            done = [cut(t, s) for t, s in zip(texts, spans, strict=True)]
            made = list(zip(*done, strict=True)) or [()] * len(names)
            columns = [batch.column(f.name) for f in others]
            for values, name in zip(made, names, strict=True):
                columns.append(pa.array(values, arrow.field(name).type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.mapInArrow(run, schema)


def cut(text: str | None, spans: list[dict] | None) -> tuple[str | None, int, int, list[dict]]:
    if text is None:
        return None, 0, 0, []
    if not spans:
        return text, sum(1 for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip(b" \t\x0b\x0c\r")), 0, []
    _, numbers, _ = lines_of(text)
    gone = np.zeros(len(numbers) + 1, np.int64)
    for s in spans:
        gone[s["starts"]] += 1
        gone[s["ends"] + 1] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    kept, removed, going, merged = [], 0, False, []
    which = dict(zip(numbers, gone.tolist(), strict=True))
    for number, line in enumerate(text.split("\n")):
        # A line without a word shares the fate of the line before it.
        was, going = going, which.get(number, going)
        if not going:
            kept.append(line)
            continue
        removed += number in which
        if number in which:
            if was and merged:
                merged[-1]["last"] = number
            else:
                merged.append({"first": number, "last": number})
    return "\n".join(kept), len(numbers), removed, merged


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows with their repeats cut out; a row all of whose lines went is gone."""
    done = remove_repeats(docs)
    lines, removed, _ = map(F.col, free(docs, *ADDED))
    return done.filter((removed == 0) | (removed < lines)).select(*docs.columns)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document its lines with a word, those removed, their places and the
    text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id",
        F.col("_lines").cast("long").alias("n_lines"),
        F.col("_removed").cast("long").alias("n_removed"),
        F.transform("_spans", lambda s: F.struct(s.first.alias("first_line"), s.last.alias("last_line"))).alias("removed"),
        F.col("text").alias("kept_text"),
    )
