"""Class bigrams in portions: bounded arrays, few files, the same results."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tagloom.llm import brown


class Shown:
    """Runs what a frame's mapInArrow would, in this process."""

    def __init__(self, spark, batches):
        self.sparkSession, self.batches = spark, batches

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def groupBy(self, *_):
        return self

    agg = groupBy


def blocks_of(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    return brown.blocks(docs).toArrow().to_batches()


def peak(run, batches):
    list(run(iter(batches)))
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def test_a_block_takes_few_bytes_a_token(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 20_000}" for _ in range(800)) for _ in range(1200)]
    batches = blocks_of(spark, texts)
    tokens = 1200 * 800
    shown = Shown(spark, batches)
    brown.pair_counts(shown, 64, lambda _, b: b.words % 64)
    assert peak(shown.run, batches)[0] < 20 * tokens
    frequent = brown.Lookup({})
    brown.rest_contexts(shown, frequent, np.random.default_rng(1).integers(1, 64, brown.UNITS))
    assert peak(shown.run, batches)[0] < 45 * tokens


def test_portions_of_any_size_give_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    sizes = np.concatenate([[0, 0, 900], rng.integers(0, 40, 60), [0]])
    values = rng.integers(1, 50, sizes.sum()).astype(np.int16)
    line = brown.between_ends(values, sizes)
    texts = np.split(values, np.cumsum(sizes)[:-1])
    assert line.tolist() == [0, *[x for t in texts for x in [*t.tolist(), 0]]]
    want = list(zip(line[:-1].tolist(), line[1:].tolist(), strict=True))
    for most in (1, 7, 64, 10_000):
        monkeypatch.setattr(brown, "PORTION", most)
        steps = [(int(a), int(b)) for left, right in brown.steps_of(line) for a, b in zip(left, right, strict=True)]
        assert steps == want
        spans = list(brown.portions(sizes))
        assert [s[0] for s in spans[1:]] == [s[1] for s in spans[:-1]] and spans[0][0] == 0 and spans[-1][1] == len(sizes)
        assert all(values[lo:hi].tolist() == [x for t in texts[a:z] for x in t.tolist()] for a, z, lo, hi in spans)
        assert all(hi - lo - sizes[z - 1] <= most for a, z, lo, hi in spans)
    assert list(brown.steps_of(brown.between_ends(values[:0], sizes[:0]))) == []


def test_the_table_of_words_has_few_files(spark):
    """However many partitions the shuffles have, and with every word."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(0, 90))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        counted = brown.fit(docs)[1]
        assert len(counted.inputFiles()) <= spark.sparkContext.defaultParallelism
        training = brown.blocks(docs)
        words = {r["word"]: r["n"] for r in brown.word_counts(training).collect()}
        assert {r["word"]: r["n"] for r in counted.collect()} == words and len(words) > brown.FREQUENT
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_scores_do_not_depend_on_the_portions(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8)) % 300}" for _ in range(rng.choice([0, 3, 700]))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model, counted = brown.fit(docs)
    known = brown.with_classes(brown.stage(brown.blocks(docs)), model.frequent, model.classes, model.common, counted)
    batches = known.toArrow().to_batches()
    tables = []
    for most in (1 << 18, 100):
        monkeypatch.setattr(brown, "PORTION", most)
        shown = Shown(spark, batches)
        shown.select = lambda *_: shown
        brown.scored_blocks(shown, model)
        tables.append(pa.Table.from_batches(list(shown.run(iter(batches)))))
    assert tables[0].equals(tables[1]) and tables[0].num_rows == len(texts)
