"""Tokenizers take up a bounded part of a batch at a time."""

import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.functions import subwords, tokens

TEXTS = [None if i % 50 == 7 else "word " * (i % 40) + f"n{i}" for i in range(400)] + ["long " * 3000, "", None]


class Bounded:
    """Refuses more text at once than it was made for."""

    def encode_batch(self, texts, add_special_tokens):
        if len(texts) > 1 and sum(map(len, texts)) > 2 << 20:
            raise MemoryError("too much text at once")
        return [type("Encoded", (), {"ids": [ord(c) for c in t]}) for t in texts]


def test_portions_hold_every_text_in_order(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CHARS", 1000)
    parts = list(tokens.portions(pd.Series(TEXTS, dtype=object)))
    assert sum(parts, []) == TEXTS
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 1000 for p in parts)
    assert list(tokens.portions(pd.Series([], dtype=object))) == []


def test_a_plugged_in_tokenizer_never_gets_a_whole_batch(spark):
    texts = [f"{i} " * 2000 for i in range(900)] + ["x" * (3 << 20), "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    ids = tokens.vocabulary_tokenizer(Bounded)(F.coalesce("t", F.lit("")))
    got = {r["i"]: (r["n"], r["last"]) for r in table.select("i", F.size(ids).alias("n"), F.try_element_at(ids, F.lit(-1)).alias("last")).collect()}
    assert got == {i: (len(t or ""), ord(t[-1]) if t else None) for i, t in enumerate(texts)}


def test_subwords_remember_ids_in_small_form(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    monkeypatch.setattr(subwords, "CALL_WORDS", 3)
    with open(path) as f:
        encode = subwords.Encoder(f.read())
    assert list(encode(TEXTS)) == [plain.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert all(isinstance(ids, bytes) for ids in encode.known.values())
