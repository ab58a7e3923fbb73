"""Subword ids against the tokenizer itself, on whole texts."""

import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom import queries
from tagloom.functions import subwords

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    None, "", " ", "\n\t\x0b", "a", "It's 12 o'clock, isn't it?!", "é ́x", "　wide blank ", "<|endoftext|> x<|startoftext|>y",
    "<|endof text|>", "\x1c\x1d\x85", "İI ß ﬁ", "日本語 text 中文", "x" * 30_000, "word " * 20_000, "a\x00b", "😀 👨‍👩‍👧", "'s 't 've '", "def f(x):\n\treturn x\n",
]


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,by_word", [(WORD, True), (BYTE, False)])
def test_ids_are_the_tokenizers_own(spark, path, by_word, monkeypatch):
    with open(path) as f:
        encode = subwords.Encoder(f.read())
    assert encode.by_word == by_word
    want = plain(path)
    assert list(encode(ODD)) == [want(t) for t in ODD]
    # A small memory is emptied and filled again.
    monkeypatch.setattr(subwords, "MOST_WORDS", 3)
    assert list(encode(ODD)) == [want(t) for t in ODD]
    bpe = subwords.Subwords(spark, path)
    table = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").repartition(3)
    rows = table.select("i", bpe.ids(F.col("t")).alias("ids"), bpe.count(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["ids"] for r in rows} == {i: want(t) for i, t in enumerate(ODD)}
    assert all(r["n"] == len(r["ids"]) for r in rows)


def cut(ids, before, after, max_length, ratio):
    room = max_length - len(before) - len(after)
    if len(ids) > room:
        head = max(1, min(room - 1, int(room * ratio)))
        ids = ids[:head] + (ids[-(room - head):] if room > head else [])
    return (before + ids + after)[:max_length]


@pytest.mark.parametrize("max_length,ratio", [(512, 0.6), (7, 0.5), (3, 0.9), (100_000, 0.1)])
def test_head_and_tail_of_ids(spark, max_length, ratio):
    bpe, want = subwords.Subwords(spark, WORD), plain(WORD)
    assert bpe.special.around() == ([49406], [49407]) and bpe.special.pad_id == 49407
    table = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    for r in table.select("i", bpe.head_tail(F.col("t"), max_length, ratio).alias("ids")).collect():
        assert r["ids"] == cut(want(ODD[r["i"]]), [49406], [49407], max_length, ratio), r["i"]
    with pytest.raises(ValueError):
        bpe.head_tail(F.col("t"), 2)


def test_registered_queries_over_whole_texts(spark, sf_dir):
    want = plain(WORD)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    full = {i: want(r["text"]) for i, r in docs.items()}
    inputs = {i: cut(ids, [49406], [49407], 512, 0.6) for i, ids in full.items()}
    rows = queries.registered()["subword_head_tail"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["input_ids"] for r in rows} == inputs
    assert all(r["attention_mask"] == [1] * len(r["input_ids"]) for r in rows)
    order = sorted(docs)
    for r in queries.registered()["subword_padding"](spark, sf_dir).collect():
        batch = order[r["batch_id"] * 16 : r["batch_id"] * 16 + 16]
        width = -(-max(len(inputs[i]) for i in batch) // 8) * 8
        real = inputs[r["doc_id"]]
        assert r["doc_id"] in batch and r["width"] == width
        assert r["input_ids"] == real + [49407] * (width - len(real))
        assert r["attention_mask"] == [1] * len(real) + [0] * (width - len(real))
    for r in queries.registered()["subword_budget"](spark, sf_dir).collect():
        sizes = [len(full[i]) for i, d in docs.items() if d["lang"] == r["lang"]]
        assert (r["documents"], r["tokens"], r["longest"]) == (len(sizes), sum(sizes), max(sizes))
        assert (r["cut"], r["tokens_lost"]) == (sum(n > 510 for n in sizes), sum(max(0, n - 510) for n in sizes))


def test_files_are_checked(spark, tmp_path, monkeypatch):
    with open(WORD) as f:
        settings = json.load(f)
    settings["added_tokens"][0]["lstrip"] = True
    assert not subwords.Encoder(json.dumps(settings)).by_word
    monkeypatch.setattr(subwords, "MOST_FILE_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        subwords.Subwords(spark, WORD)
