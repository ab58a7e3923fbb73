"""Packing token sequences by best-fit decreasing (operator 9).

Documents are dealt over shards of bounded size. A task encodes its shard, cuts
documents longer than a window into full windows, and packs the rest from the
longest to the shortest, each into the open window it fits most tightly. A
segment tree over the remaining capacity finds that window.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator, Sequence
from itertools import pairwise
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.llm.words import arrow_schema

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
# Text of one shard; a task holds the ids of its shard.
SHARD_BYTES = 8 << 20
# Words remembered per worker, and the longest that is.
MOST_WORDS, LONGEST_WORD = 600_000, 64
# A letter or digit, the marks that end its word, and what ends the word.
MARKS = r"([a-z0-9])([.,;:!?#*$%&]+)([ \t-\r]|\z)"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words; words recur, so they are remembered, and Arrow
    finds the distinct ones of a batch. The tokenizer also folds case and
    starts anew where a letter or digit meets sentence marks (apostrophes are
    none: they may belong to the letters after them), so texts that hold no
    control string are folded and cut there first: fewer words are new.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Of distinct words."""
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > MOST_WORDS:
            self.known.clear()
            missing = words
        self.known.update(zip(missing, self.encode(missing), strict=True))
        ids = [self.known[w] for w in words]
        for w in missing:
            if len(w) > LONGEST_WORD:
                del self.known[w]
        return ids

    def __call__(self, text: str | None) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        # Large offsets: splitting must not overflow on very long texts.
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # Copied, as Arrow's lower-casing misplaces the texts of a slice.
        texts = texts.take(pa.array(np.arange(len(texts))))
        folded = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS, r"\1 \2\3")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, folded)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
        word = coded.indices.to_numpy()
        taken = sizes[word]
        ends = np.cumsum(taken)
        # Place of each id among those of the distinct words.
        shift = (np.cumsum(sizes) - sizes)[word] - (ends - taken)
        at = np.repeat(shift, taken)
        at += np.arange(len(at))
        flat = np.frombuffer(b"".join(ids), "<u4")[at]
        last = np.cumsum(words.value_lengths().to_numpy())
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], last])]
        return [flat[low:high] for low, high in pairwise(cuts.tolist())]


def encoder(path: str) -> Encoder:
    """One per Python worker. Code sent by value brings its own globals with
    every task, so it is kept in a module that stays."""
    kept = sys.modules.setdefault("_tagloom_worker", ModuleType("_tagloom_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that counts
    the windows in each range of capacities."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, number: int) -> None:
        self.stacks[capacity].append(number)
        self._add(capacity, 1)

    def tightest(self, least: int) -> tuple[int, int] | None:
        """Take the window with the smallest capacity of ``least`` or more."""
        count, at = self.count, least + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        number = self.stacks[capacity].pop()
        self._add(capacity, -1)
        return capacity, number


def best_fit(lengths: Sequence[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Window number and offset per piece; longest first, ties by position."""
    opened, places, windows = OpenWindows(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = opened.tightest(lengths[i])
        if found is None:
            capacity, number, windows = window, windows, windows + 1
        else:
            capacity, number = found
        places[i] = (number, window - capacity)
        if capacity > lengths[i]:
            opened.put(capacity - lengths[i], number)
    return places


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row per piece with its ``ids``.

    Null and empty texts are the end id alone. Rows that repeat an id are
    packed as they come, each on its own. Rows are dealt to shards without a
    key, so no id or source can fill one. A sequence id is the shard and the
    number of the window in it.
    """
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("t"))
    whole = chosen.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    shards = max(1, -(-whole // SHARD_BYTES))
    arrow = arrow_schema(StructType.fromDDL(PIECES))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).batch, np.array([END_ID], "<u4")
        shard = TaskContext.get().partitionId()
        pieces: list[list] = []
        for batch in source:
            for doc_id, own in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.concatenate([own, end])
                n = len(ids)
                for start in range(0, n, window):
                    part = ids[start : start + window].tobytes()
                    pieces.append([doc_id, start, len(part) // 4, part, n])
        places = best_fit([p[2] for p in pieces], window)
        for low in range(0, len(pieces), 2000):
            rows = [
                (*p, (shard << 32) + number, offset)
                for p, (number, offset) in zip(pieces[low : low + 2000], places[low : low + 2000], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow
            )

    return chosen.repartition(int(shards)).mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(packed(docs, tokenizer_path()))
