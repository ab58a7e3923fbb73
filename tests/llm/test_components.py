"""Links leave a task as stars, and few rows take few tasks and steps."""

import random
from pathlib import Path

import numpy as np
import pytest

from tagloom.llm import components, near_dup


def brute_components(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.fixture
def many_partitions(spark):
    """AQE joins no partitions, as where their number is fixed."""
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_graphs_take_few_steps_and_files(spark, monkeypatch, many_partitions):
    tables = []
    real = components.stage
    monkeypatch.setattr(components, "stage", lambda df: tables.append(real(df)) or tables[-1])
    # Stars of several tasks over the same rows, which agree on their centres in part.
    edges = [(10 * c, 10 * c + k) for c in range(300) for k in range(1, 10)]
    edges += [(10 * c + 1, 10 * c + k) for c in range(300) for k in range(2, 10)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == brute_components(edges)
    assert len(got) == 3000
    # The edges, and one step that makes them stars; it needs no second to see that.
    assert len(tables) == 2
    for table in tables:
        files = {Path(f) for f in table.inputFiles()}
        assert len(files) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [tuple(rng.sample(range(-60, 60), 2)) for _ in range(70)] + [(7, 7)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(900, 1000 + i) for i in range(seed)]
    rows = [*edges, (None, 3), (1, None)]
    got = components.connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert sorted((r["node"], r["component"]) for r in got) == sorted(want.items())


def test_links_of_a_block_are_stars_about_the_least_id():
    base = np.arange(100, dtype=np.uint64)
    chain = [np.sort(np.append(base[k:], base[:k] + np.uint64(1000))) for k in range(0, 30, 5)]
    other = [base + np.uint64(5000), base + np.uint64(5000), base + np.uint64(9000)]
    ids = np.array([50, 40, 7, 60, 30, 20, 8, 3, 1])
    edges = near_dup.true_links(ids, chain + other, 85)
    assert sorted(map(sorted, edges)) == [[3, 8], [7, 20], [7, 30], [7, 40], [7, 50], [7, 60]]


@pytest.mark.parametrize("n", [40, 700])
def test_pairs_of_a_large_group_are_not_joined_one_by_one(monkeypatch, n):
    calls = []
    real = near_dup.Forest.join
    monkeypatch.setattr(near_dup.Forest, "join", lambda self, a, b: calls.append(1) or real(self, a, b))
    group = np.arange(n) % 7 == 3
    x, y = np.nonzero((group[:, None] == group[None, :]) & (np.arange(n)[:, None] < np.arange(n)[None, :]))
    forest = near_dup.Forest(n)
    joins = forest.joined(x, y)
    assert len(joins) == n - 2
    assert {forest.root(i) for i in np.flatnonzero(group).tolist()} == {3}
    assert {forest.root(i) for i in np.flatnonzero(~group).tolist()} == {0}
    assert len(calls) <= max(256, n) * 4
