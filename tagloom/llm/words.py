"""Words as every operator here reads them, in Python tasks and in Spark."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: what separates words (space and the ASCII controls 9 to 13).
SEPARATORS = "[\\x20\\x09-\\x0D]+"


def native_words(text: Column) -> Column:
    """``array<string>``; an empty or null text has no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def free(frame: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column is called so."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    """``bytes.split`` and ``bytes.lower`` know ASCII only, which is the rule."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """64-bit hash of each word, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbours; a shorter sequence is one whole."""
    step = np.uint64(0x9E3779B97F4A7C15)
    n = len(h)
    take = min(width, n)
    if n == 0:
        return h
    out = np.zeros(n - take + 1, np.uint64)
    for k in range(take):
        out = out * step + h[k : n - take + 1 + k]
    return mixed(out + np.uint64(take))


def crc_of_id(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def arrow_schema(kind) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch, the number of each token's word among
    them, and how many tokens each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # Copied, as Arrow's lower-casing misplaces the texts of a slice.
    texts = pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))
    split = pc.ascii_split_whitespace(texts)
    del texts
    flat, ends = split.flatten(), np.append(0, np.cumsum(split.value_lengths().to_numpy()))
    del split
    # White space at an end of a text leaves an empty piece there.
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    flat = flat.filter(full)
    words = flat.dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.diff(before[ends])


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, which after each batch gives back the memory
    that Arrow keeps for its next one: workers stay when their task has ended."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(source):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    return batches


def hashes_of(words: pa.Array) -> np.ndarray:
    listed = words.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed)).view(np.int64)
