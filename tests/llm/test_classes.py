"""Word classes of the language model: every word's own, by the largest gain."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import brown


def likelihood(joint):
    return brown.plogp(joint).sum() - 2 * brown.plogp(joint.sum(1)).sum()


def joint_of(texts, class_of):
    out = np.zeros((brown.CLASSES, brown.CLASSES))
    for words in texts:
        line = [0, *[class_of[w] for w in words], 0]
        np.add.at(out, (line[:-1], line[1:]), 1)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}{rng.choice(['ing', 'eds', 'ate'])}" for i in range(120)]
    out = [[vocabulary[int(rng.paretovariate(0.7)) % 120] for _ in range(rng.randint(0, 60))] for _ in range(90)]
    return [*out, ["twice", "twice", "twice"], []]


def test_every_other_word_takes_the_class_of_its_largest_gain(spark, texts, monkeypatch):
    monkeypatch.setattr(brown, "BLOCK_BYTES", 700)
    training = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    words = sorted({w for t in training for w in t})
    column = pa.array(words, pa.large_string())
    hashes, endings = brown.hashes_of(column), brown.ending_units(column)
    frequent = brown.Lookup({int(h): 1 + i for i, h in enumerate(hashes[:15])})
    classes = np.random.default_rng(3).integers(1, brown.CLASSES, brown.UNITS)
    classes[0] = 0
    units = frequent.of(hashes, endings)
    class_of = {w: int(classes[u]) for w, u in zip(words, units, strict=True)}
    joint = joint_of(training, class_of)
    table = brown.blocks(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert table.count() > 4
    got = {r["word"]: r["class"] for r in brown.rest_classes(brown.rest_contexts(table, frequent, classes), classes, joint).collect()}
    assert set(got) == set(hashes[15:].tolist())
    start, moved = likelihood(joint), 0
    used = [y for y in range(1, brown.CLASSES) if joint[y].any()]
    for w, h in zip(words[15:], hashes[15:].tolist(), strict=True):
        gain = {y: likelihood(joint_of(training, class_of | {w: y})) - start for y in used}
        assert gain[got[h]] > max(gain.values()) - 1e-5, w
        moved += got[h] != class_of[w]
    assert moved > 20
    # Alike endings, unlike neighbours: no block of words moves as one.
    alike = {}
    for h, e in zip(hashes[15:].tolist(), endings[15:].tolist(), strict=True):
        alike.setdefault(e, set()).add(got[h])
    assert max(map(len, alike.values())) > 1


def test_exchange_ends_where_no_unit_gains():
    rng = np.random.default_rng(5)
    line = np.concatenate([[0], *([*rng.zipf(1.4, rng.integers(1, 40)) % 200 + 1, 0] for _ in range(200))])
    counts = np.zeros((brown.UNITS, brown.UNITS))
    np.add.at(counts, (line[:-1], line[1:]), 1)
    order = np.argsort(-counts.sum(0), kind="stable")
    classes = brown.exchange(counts, order[order != 0])
    assert classes[0] == 0 and (classes[1:] > 0).all()
    best = likelihood(brown.class_counts(counts, classes))
    for u in order[1:12].tolist():
        for y in range(1, brown.CLASSES):
            other = classes.copy()
            other[u] = y
            assert likelihood(brown.class_counts(counts, other)) <= best + 1e-4


def test_runs_of_a_value_stay_together():
    rows = [0, 0, 1, 1, 1, 1, 1, 2, 5, 5]
    for cut in range(1, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + cut])], names=["k"]) for i in range(0, 10, cut)]
        tables = [t.column("k").to_pylist() for t in brown.whole_runs(iter(batches))]
        assert sum(tables, []) == rows
        assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:], strict=False))
