"""Token ids from a learned vocabulary file, cut to head and tail.

The file is read once where the job is started and sent to the executors as
text, so they need no path of their own. A Python worker keeps the tokenizer
and the ids of words it has seen; texts arrive and ids leave in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Callable, Iterator
from dataclasses import replace
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tagloom.functions.tokens import SpecialTokens, check_lengths, portions, wrap

# A vocabulary file is broadcast, so its size is checked.
MOST_FILE_BYTES = 64 << 20
# Words remembered per worker, and the longest that is.
MOST_WORDS, LONGEST_WORD = 500_000, 64
# Words of texts that are looked up together.
GROUP_WORDS = 100_000
# New words encoded in one call.
CALL_WORDS = 10_000
# Names under which tokenizer files list their special tokens.
SPECIAL_NAMES = {
    "cls_id": ("[CLS]",), "sep_id": ("[SEP]",), "pad_id": ("[PAD]", "<pad>"),
    "bos_id": ("<s>", "<|startoftext|>"), "eos_id": ("</s>", "<|endoftext|>"),
}


def splits_at_blanks(tokenizer) -> bool:
    """Whether a text's ids are those of its pieces between blanks.

    That holds if the pre-tokenizer cuts out white space itself, or keeps only
    what is none, nothing is put before the first word, and no special token
    holds a blank or takes blanks around it. The settings are read, then texts
    that would show the contrary are tried.
    """
    settings = json.loads(tokenizer.to_str())
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in settings["added_tokens"]):
        return False
    parts = settings["pre_tokenizer"] or {}
    steps = parts.get("pretokenizers", [parts])
    if any(p.get("add_prefix_space") or p.get("type") in ("Metaspace", None) for p in steps):
        return False
    probes = ["a b", " a  b ", "ab\ncd\tef", "x\x0by\x0cz\rw", "é ́a ..  !a", "1 2  34 a1 b", "It 's o' clock", "   "]

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    return all(ids(p) == [i for w in p.encode().split() for i in ids(w.decode())] for p in probes)


class Encoder:
    """Ids of whole texts as the tokenizer gives them, without special tokens.

    Where a text's ids are those of its words, words are encoded once and
    remembered; other tokenizers get the whole texts.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = splits_at_blanks(self.tokenizer)
        #: Ids of a word as the bytes of 32-bit numbers.
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> Iterator[list[int]]:
        return (ids.tolist() for ids in self.arrays(texts))

    def arrays(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        plain = ["" if t is None else t for t in texts]
        if not self.by_word:
            yield from (np.array(ids, np.int32) for ids in self.encode(plain))
            return
        group: list[list[bytes]] = []
        size = 0
        for text in plain:
            # bytes.split knows ASCII white space only, which every such tokenizer drops.
            words = text.encode("utf-8", "replace").split()
            group.append(words)
            size += len(words)
            if size >= GROUP_WORDS:
                yield from self.looked_up(group)
                group, size = [], 0
        yield from self.looked_up(group)

    def looked_up(self, group: list[list[bytes]]) -> Iterator[np.ndarray]:
        """New words of a group of texts are encoded together."""
        used = set().union(*group)
        missing = [w for w in used if w not in self.known]
        if len(self.known) + len(missing) > MOST_WORDS:
            self.known.clear()
            missing = list(used)
        for a in range(0, len(missing), CALL_WORDS):
            part = missing[a : a + CALL_WORDS]
            for w, ids in zip(part, self.encode([w.decode() for w in part]), strict=True):
                self.known[w] = np.array(ids, np.int32).tobytes()
        for words in group:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
        for w in missing:
            if len(w) > LONGEST_WORD:
                del self.known[w]


def encoder(key: str, file: Broadcast) -> Encoder:
    """One per Python worker and file. Functions sent by value bring their own
    globals with every task, so it is kept in a module that stays."""
    kept = sys.modules.setdefault("_tagloom_subwords", ModuleType("_tagloom_subwords")).__dict__
    if key not in kept:
        kept[key] = Encoder(file.value)
    return kept[key]


class Subwords:
    """A tokenizer file of the `tokenizers` library, for use in columns."""

    def __init__(self, spark: SparkSession, path: str):
        size = os.path.getsize(path)
        if size > MOST_FILE_BYTES:
            raise ValueError(f"{path} has {size} bytes, more than {MOST_FILE_BYTES}")
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.file = spark.sparkContext.broadcast(text)
        self.key = hashlib.sha256(text.encode()).hexdigest()
        listed = {t["content"]: t["id"] for t in json.loads(text)["added_tokens"]}
        ids = {k: next((listed[n] for n in names if n in listed), None) for k, names in SPECIAL_NAMES.items()}
        #: As the file declares them. Without a padding token the end pads.
        self.special = SpecialTokens(**ids)
        if ids["pad_id"] is None:
            self.special = replace(self.special, pad_id=ids["eos_id"] or 0)

    def ids(self, text: Column) -> Column:
        """``array<int>``, all ids of whole texts; null texts are empty."""
        return self._function(lambda found: found)(text)

    def head_tail(self, text: Column, max_length: int = 512, head_ratio: float = 0.6) -> Column:
        """``array<int>`` model input: whole texts encoded, the middle cut out,
        wrapped in the special tokens, at most ``max_length`` ids. Only what is
        kept leaves the worker."""
        before, after = self.special.around()
        budget = check_lengths(max_length, head_ratio, len(before) + len(after))
        head = max(1, min(budget - 1, int(budget * head_ratio)))
        tail = budget - head

        def cut(found: np.ndarray) -> np.ndarray:
            if len(found) <= budget:
                return found
            return np.concatenate([found[:head], found[len(found) - tail :]])

        return F.slice(wrap(self._function(cut)(text), self.special), 1, max_length)

    def count(self, text: Column) -> Column:
        """How many ids a whole text has."""
        key, file = self.key, self.file

        @F.pandas_udf(IntegerType())
        def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = encoder(key, file)
            for batch in batches:
                for texts in portions(batch):
                    yield pd.Series([len(x) for x in encode.arrays(texts)], dtype="int32")

        return counts(text)

    def _function(self, cut: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
        key, file = self.key, self.file

        @F.pandas_udf(ArrayType(IntegerType()))
        def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = encoder(key, file)
            for batch in batches:
                for texts in portions(batch):
                    yield pd.Series([cut(x) for x in encode.arrays(texts)], dtype=object)

        return ids
