"""Token-id arrays: head-and-tail cut, special tokens, masks and padding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.binding import bind

Tokenizer = Callable[[Column], Column]
# Characters of text that a worker takes up at a time.
MOST_CHARS = 2 << 20


@dataclass(frozen=True)
class SpecialTokens:
    """Ids the model expects around the content. CLS/SEP win when both are
    set; otherwise BOS/EOS are used as far as they are defined."""

    cls_id: int | None = None
    sep_id: int | None = None
    bos_id: int | None = None
    eos_id: int | None = None
    pad_id: int = 0
    token_type_ids: bool = False

    def around(self) -> tuple[list[int], list[int]]:
        if self.cls_id is not None and self.sep_id is not None:
            return [self.cls_id], [self.sep_id]
        before = [] if self.bos_id is None else [self.bos_id]
        after = [] if self.eos_id is None else [self.eos_id]
        return before, after


def head_tail(items: Column, budget: int, head_ratio: float) -> Column:
    """At most ``budget`` items: the first part and the last part.

    The head takes ``int(budget * head_ratio)``, kept within 1..budget-1 so
    that neither side vanishes. With a budget of one there is no tail to take
    and the whole array follows the head; callers cut at ``max_length``.
    """
    head = max(1, min(budget - 1, int(budget * head_ratio)))
    tail = budget - head
    last = F.slice(items, -tail, tail) if tail > 0 else items
    both = F.concat(F.slice(items, 1, head), last)
    return F.when(F.size(items) > budget, both).otherwise(items)


def check_lengths(max_length: int, head_ratio: float, special_count: int) -> int:
    """Room left for content, or ValueError."""
    if max_length <= 0:
        raise ValueError(f"max_length must be positive, got {max_length}")
    if not 0.0 < head_ratio < 1.0:
        raise ValueError(f"head_ratio must lie in (0, 1), got {head_ratio}")
    budget = max_length - special_count
    if budget <= 0:
        raise ValueError(f"max_length={max_length} has no room for {special_count} special tokens")
    return budget


def int_array(values: list[int]) -> Column:
    if not values:
        return F.array().cast("array<int>")
    return F.array(*[F.lit(v).cast("int") for v in values])


def wrap(ids: Column, special: SpecialTokens) -> Column:
    before, after = special.around()
    return F.concat(int_array(before), ids, int_array(after))


def encode(
    text: Column,
    tokenizer: Tokenizer,
    special: SpecialTokens,
    max_length: int = 512,
    head_ratio: float = 0.6,
    special_count: int | None = None,
) -> Column:
    """``array<int>`` model input: tokenise the whole text, cut the middle,
    wrap in special tokens, and cut at ``max_length`` as a last resort."""
    before, after = special.around()
    count = len(before) + len(after) if special_count is None else special_count
    budget = check_lengths(max_length, head_ratio, count)
    return bind(
        tokenizer(F.coalesce(text, F.lit(""))),
        lambda ids: F.slice(wrap(head_tail(ids, budget, head_ratio), special), 1, max_length),
    )


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def token_type_ids(ids: Column) -> Column:
    return F.array_repeat(F.lit(0), F.size(ids))


def padded_width(longest: Column, multiple: int | None = 8) -> Column:
    if not multiple:
        return longest
    return (F.ceil(longest / F.lit(multiple)) * multiple).cast("int")


def pad(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value).cast("int"), width - F.size(ids)))


def words(text: Column) -> Column:
    """Non-empty pieces between blanks and line feeds."""
    # A one-character separator is not compiled to a regular expression.
    blanks = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.filter(F.split(blanks, " "), lambda w: w != "")


def hashed_id(word: Column, vocabulary: int = 50_000, reserved: int = 10) -> Column:
    """A stable id for a word, past the ids reserved for special tokens."""
    return (F.pmod(F.xxhash64(word), F.lit(vocabulary)) + reserved).cast("int")


def encode_words(
    text: Column,
    special: SpecialTokens,
    max_length: int = 512,
    head_ratio: float = 0.6,
    word_id: Callable[[Column], Column] = hashed_id,
) -> Column:
    """:func:`encode` with words as tokens, for use without a vocabulary file.

    The middle is cut before ids are made, so only the words that stay cost
    anything.
    """
    before, after = special.around()
    budget = check_lengths(max_length, head_ratio, len(before) + len(after))
    kept = bind(
        words(F.coalesce(text, F.lit(""))), lambda w: head_tail(w, budget, head_ratio)
    )
    ids = F.transform(kept, lambda w: word_id(w))
    return F.slice(wrap(ids, special), 1, max_length)


def portions(batch: pd.Series) -> Iterator[list[str]]:
    """Neighbouring texts of a batch, at most ``MOST_CHARS`` together, so that
    neither words nor ids of a whole batch are held; a longer text is alone."""
    part: list[str] = []
    size = 0
    for text in batch:
        if part and size + len(text or "") > MOST_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def vocabulary_tokenizer(load: Callable[[], Any]) -> Tokenizer:
    """A tokenizer object as an Arrow-batched function.

    ``load`` runs once per task and returns an object with
    ``encode_batch(list[str], add_special_tokens=False)`` whose items have
    ``ids`` (the interface of the `tokenizers` package).
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for batch in batches:
            for texts in portions(batch):
                encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
                yield pd.Series([np.array(e.ids, np.int32) for e in encoded], dtype=object)

    return ids
