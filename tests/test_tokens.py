import pytest
from pyspark.sql import functions as F
from stubs import Letters

from tagloom.functions import tokens
from tagloom.operators import batching

V = F.col("v")
CLS = tokens.SpecialTokens(cls_id=101, sep_id=102, pad_id=9, token_type_ids=True)


def expected(ids, special, max_length, ratio):
    before, after = special.around()
    budget = max_length - len(before) - len(after)
    if len(ids) > budget:
        head = max(1, min(budget - 1, int(budget * ratio)))
        tail = budget - head
        ids = ids[:head] + ids[-tail:]
    return (before + ids + after)[:max_length]


@pytest.mark.parametrize("max_length", [3, 4, 7, 12])
@pytest.mark.parametrize(
    "special",
    [CLS, tokens.SpecialTokens(bos_id=1, eos_id=2), tokens.SpecialTokens(bos_id=1), tokens.SpecialTokens()],
)
def test_encode(values, max_length, special):
    rows = [list(range(n)) for n in (0, 1, 2, 4, 5, 6, 9, 10, 11, 30)]
    got = values(
        tokens.encode(F.lit(""), lambda _: V, special, max_length, 0.6), rows, "array<int>"
    )
    assert got == [expected(r, special, max_length, 0.6) for r in rows]


def test_bad_arguments():
    for max_length, ratio in ((0, 0.6), (-1, 0.6), (8, 0.0), (8, 1.0), (2, 0.6)):
        with pytest.raises(ValueError):
            tokens.encode(V, tokens.words, CLS, max_length, ratio)


def test_words_are_cut_before_ids_are_made(values):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 3, 50)] + [None, " \n a  b\n"]
    early = values(tokens.encode_words(V, CLS, 12), texts, "string")
    whole = lambda t: F.transform(tokens.words(t), lambda w: tokens.hashed_id(w))
    assert early == values(tokens.encode(V, whole, CLS, 12), texts, "string")
    assert all(10 <= i < 50_010 for i in early[2][1:-1] if i not in (101, 102))


def test_vocabulary_tokenizer(values):
    tokenizer = tokens.vocabulary_tokenizer(Letters)
    got = values(tokens.encode(V, tokenizer, CLS, 6, 0.6), ["ab", "abcdefgh", None], "string")
    assert got == [[101, 97, 98, 102], [101, 97, 98, 103, 104, 102], [101, 102]]


def test_batches_and_padding(spark):
    rows = [(7 * i, list(range(1 + (i * 5) % 13))) for i in range(50)]
    df = spark.createDataFrame(rows, "ord long, input_ids array<int>").repartition(5)
    padded = batching.pad_batches(batching.number_batches(df, 8), CLS)
    got = sorted(padded.collect(), key=lambda r: r["ord"])
    for i, row in enumerate(got):
        batch = rows[i // 8 * 8:i // 8 * 8 + 8]
        longest = max(len(ids) for _, ids in batch)
        width = -(-longest // 8) * 8
        ids = rows[i][1]
        assert row["batch_id"] == i // 8 and row["width"] == width
        assert row["input_ids"] == ids + [9] * (width - len(ids))
        assert row["attention_mask"] == [1] * len(ids) + [0] * (width - len(ids))
        assert row["token_type_ids"] == [0] * width


def test_padding_without_rounding(spark):
    df = spark.createDataFrame([(1, [1]), (2, [1, 2, 3])], "ord long, input_ids array<int>")
    padded = batching.pad_batches(batching.number_batches(df, 2), CLS, multiple=None)
    assert {len(r["input_ids"]) for r in padded.collect()} == {3}
