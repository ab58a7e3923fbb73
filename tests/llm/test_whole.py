"""Operators on documents do the whole job where an earlier round cut it."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import embeddings, line_dedup, near_dup, quality

# ---- line dedup -----------------------------------------------------------


def common_stretches(texts):
    """Lines of later copies in maximal common stretches of RUN_WORDS words."""
    split = [line_dedup.lines_of(t) for t in texts]
    gone = defaultdict(set)
    for b, (lines, numbers, counts) in enumerate(split):
        for a in range(b + 1):
            other = split[a][0]
            for i in range(len(other)):
                for j in range(i + 1 if a == b else 0, len(lines)):
                    if other[i] != lines[j] or (i and j and other[i - 1] == lines[j - 1]):
                        continue
                    n = 0
                    while i + n < len(other) and j + n < len(lines) and other[i + n] == lines[j + n]:
                        n += 1
                    if sum(counts[j : j + n]) >= line_dedup.RUN_WORDS:
                        gone[b] |= set(numbers[j : j + n])
    return gone


def test_repeated_stretches_go_to_their_last_line(spark):
    rng = random.Random(11)

    def line(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    passage = [line(n) for n in (7, 55, 30, 12, 3, 20, 9)]
    texts = [
        "\n".join([line(8), *passage[:2], line(60)]),
        # Equal to the first text in two lines, to the third in all of them.
        "\n".join([*passage, line(70)]),
        "\n".join([line(4), *passage]),
        "\n".join(passage[1:3]),
        "\n".join([line(51), *passage[3:], "", line(10)]),
        "\n".join([line(10)] * 9 + ["end"] + passage[:1]),
        "\n".join(["x y"] * 40),
    ]
    for _ in range(25):
        picked = []
        for _ in range(rng.randint(1, 4)):
            low = rng.randrange(len(passage))
            picked += [*passage[low : rng.randint(low, len(passage))], line(rng.randint(1, 30))]
        texts.append("\n".join(picked))
    want = common_stretches(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in line_dedup.remove_repeats(docs).collect()}
    assert {i: r["_removed"] for i, r in got.items() if r["_removed"]} == {i: len(w) for i, w in want.items()}
    # 55 and 30 words: a run ends after the first line.
    assert got[3]["text"] == "" and got[2]["text"] == texts[2].split("\n")[0]


# ---- near duplicates --------------------------------------------------------


def test_pipeline_drops_near_copies_from_80_percent_on(spark):
    """Pairs of 100 words whose last words differ: similarity (96 - n) / (96 + n)."""
    rows = []
    for n in range(3, 18):
        words = [f"p{n}w{i}" for i in range(100)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[: 100 - n] + [f"new{i}" for i in range(n)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, kept in ((80, corpus_pipeline.near_duplicates(spark, docs, "")), (85, near_dup.one_of_each(docs))):
        want = {2 * n for n in range(3, 18)} | {2 * n + 1 for n in range(3, 18) if 100 * (96 - n) < percent * (96 + n)}
        assert {r["doc_id"] for r in kept.collect()} == want


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_within_the_distance_share_a_key(percent):
    rng = np.random.default_rng(7)
    most = near_dup.distance(percent)
    a = rng.integers(0, 256, (300, near_dup.POSITIONS)).astype(np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dup.POSITIONS, most, replace=False)
        row[at] ^= rng.integers(1, 256, most).astype(np.uint8)
    assert (near_dup.keys_of(a, most) == near_dup.keys_of(b, most)).any(axis=1).all()


# ---- quality ------------------------------------------------------------------


@pytest.mark.parametrize("most", [10_000, 1])
def test_languages_with_other_alphabets_are_compared_with_themselves(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "MOST_BROADCAST", most)
    rng = random.Random(3)

    def text(letters):
        words = ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(150)]
        return " ".join(words).capitalize() + "."

    letters = {"pt": "abcdeilmnoprstuvã", "ru": "абвгдеиклмнопрст", "zz": "abcde", None: "абвabc"}
    rows = [(i, text(letters[lang]), lang) for i, lang in enumerate(["pt"] * 20 + ["ru"] * 10 + ["zz"] + [None, "pt"] * 2)]
    rows += [(100, text("абвгде"), "pt"), (101, "я " * 150, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc"]["doc_id"]: r for r in quality.assess(docs, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    # Only the Russian text among the Portuguese ones and the repeated word go.
    assert {i for i, r in got.items() if not r["kept"]} == {100, 101}
    assert all(got[i]["char_divergence"] == 0 for i, _, lang in rows if lang is None)


# ---- embeddings -----------------------------------------------------------------


def test_rows_without_an_id_do_not_take_part_in_components(spark):
    rng = np.random.default_rng(2)
    big = 1 << 53
    rows = []
    for k in range(12):
        base = rng.normal(size=8)
        for j in range(6):
            vector = (base + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.3])).tolist()
            rows.append((None if j in (1, 3) else big + 1 + 16 * k + j, vector))
    rows.sort(key=lambda r: rng.random())
    got = embeddings.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()
    x = np.array([v for _, v in rows])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    close = x @ x.T >= embeddings.COSINE
    np.fill_diagonal(close, False)
    ids = [i for i, _ in rows if i is not None]
    up = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(close), strict=True):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and up[i] != up[j]:
                up[i] = up[j] = min(up[i], up[j])
                changed = True
    assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] is not None} == up
    assert all(r["component_id"] is None and r["kept"] for r in got if r["vec_id"] is None)
    assert sorted(r["n_links"] for r in got) == sorted(close.sum(1).tolist())
    assert sum(up[i] != i for i in ids) > 20
