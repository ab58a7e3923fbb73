import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tagloom.operators import ordering, splits
from tagloom.operators.ordering import seeded_hash


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(2 * i + s, f"src::C-{i:04d}::h{i}", s) for i in range(100) for s in (0, 1)]
    return spark.createDataFrame(rows, "ord long, group_id string, label int")


def sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_split_sizes_groups_and_repeatability(pairs):
    split = splits.fit_group_split(pairs, seed=42).assign(pairs)
    assert sizes(split) == {"train": 160, "val": 20, "test": 20}
    overlap = splits.split_overlap(split).first()
    assert overlap.asDict() == {"groups": 100, "train_val": 0, "train_test": 0, "val_test": 0}
    again = splits.fit_group_split(pairs.repartition(7), seed=42).assign(pairs)
    assert split.exceptAll(again).isEmpty()
    other = splits.fit_group_split(pairs, seed=43).assign(pairs)
    assert not split.exceptAll(other).isEmpty()


@pytest.mark.parametrize("groups, want", [(0, {}), (1, {"test": 1}), (5, {"train": 4, "test": 1}), (10, {"train": 8, "val": 1, "test": 1})])
def test_few_groups(spark, groups, want):
    df = spark.createDataFrame([(i, f"g{i}") for i in range(groups)], "ord long, group_id string")
    assert sizes(splits.fit_group_split(df).assign(df)) == want


def test_rows_without_a_group_stay_together(spark):
    rows = [(i, None if i % 4 == 0 else f"g{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, group_id string")
    fitted = splits.fit_group_split(df)
    split = fitted.assign(df)
    assert fitted.groups == 151 and split.filter("group_id IS NULL").select("split").distinct().count() == 1
    per = {r["split"]: r["n"] for r in split.groupBy("split").agg(
        F.count_distinct(F.coalesce("group_id", F.lit("-"))).alias("n")).collect()}
    assert per == {"train": 120, "val": 15, "test": 16}


def test_overlap_is_seen(spark):
    rows = [("a", "train"), ("a", "val"), ("b", "test"), ("b", "val"), ("c", "train")]
    df = spark.createDataFrame(rows, "group_id string, split string")
    assert splits.split_overlap(df).first().asDict() == {"groups": 3, "train_val": 1, "train_test": 0, "val_test": 1}


def test_one_group_with_a_third_of_the_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "ord long, group_id string")
    split = splits.fit_group_split(df).assign(df)
    assert split.filter("group_id = 'hot'").select("split").distinct().count() == 1
    assert split.count() == 900
    # Assigning is a projection: rows are not moved.
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()


def test_shuffle_split_is_pythons_shuffle(pairs):
    keys = [f"src::C-{i:04d}::h{i}" for i in range(100)]
    random.Random(42).shuffle(keys)
    want = {k: "train" if i < 80 else "val" if i < 90 else "test" for i, k in enumerate(keys)}
    split = splits.shuffle_split(pairs.repartition(5), seed=42)
    got = {r["group_id"]: r["split"] for r in split.collect()}
    assert got == want and sizes(split) == {"train": 160, "val": 20, "test": 20}


def test_shuffle_sample_is_pythons_sample(spark):
    # Groups of uneven size, first seen in mixed order.
    rng = random.Random(9)
    rows = [(o, f"g{rng.choice([0, 0, 0, 0, 1, 2, rng.randrange(3, 40)])}") for o in range(300)]
    groups = {}
    for o, g in rows:
        groups.setdefault(g, []).append(o)
    keys = list(groups)
    random.Random(5).shuffle(keys)
    cut = int(len(keys) * 0.8)
    train = [o for g in keys[:cut] for o in groups[g]]
    want = random.Random(5).sample(train, 30)
    df = spark.createDataFrame(rows, "ord long, group_id string").repartition(4)
    split = splits.shuffle_split(df, seed=5, place="place").filter("split = 'train'")
    assert split.count() == len(train)
    got = splits.shuffle_sample(split, 30, 5, "place")
    assert sorted(r["ord"] for r in got.collect()) == sorted(want)
    assert splits.shuffle_sample(split, None, 5, "place") is split
    assert splits.shuffle_sample(split, 1000, 5, "place") is split


def test_shuffle_split_refuses_too_many_groups(pairs, monkeypatch):
    monkeypatch.setattr(splits, "DRIVER_GROUPS", 99)
    with pytest.raises(ValueError):
        splits.shuffle_split(pairs)


def test_sample_rows(pairs):
    sample = splits.sample_rows(pairs, 37, seed=1)
    assert sample.count() == 37 and sample.distinct().count() == 37
    assert sample.exceptAll(pairs).isEmpty()
    assert sample.exceptAll(splits.sample_rows(pairs.repartition(6), 37, seed=1)).isEmpty()
    assert splits.sample_rows(pairs, None, 1) is pairs
    assert splits.sample_rows(pairs, 200, 1) is pairs
    assert splits.sample_rows(pairs, 500, 1) is pairs
    assert splits.sample_rows(pairs, 0, 1).count() == 0


def test_first_rows(spark):
    rows = [(o,) for o in random.Random(3).sample(range(10_000_000), 500)]
    df = spark.createDataFrame(rows, "ord long").repartition(6)
    for n in (1, 7, 499):
        got = sorted(r["ord"] for r in splits.first_rows(df, n).collect())
        assert got == sorted(r[0] for r in rows)[:n]
    assert splits.first_rows(df, 500) is df and splits.first_rows(df, None) is df


def test_epoch_order(pairs):
    one = {r["ord"]: r["position"] for r in splits.epoch_order(pairs, 42, 1).collect()}
    two = {r["ord"]: r["position"] for r in splits.epoch_order(pairs, 42, 2).collect()}
    assert sorted(one.values()) == sorted(two.values()) == list(range(1, 201))
    assert one != two


def test_ranked_equals_a_global_sort(spark):
    @settings(max_examples=5, deadline=None)
    @given(
        st.lists(st.integers(0, 1 << 30), min_size=1, max_size=80, unique=True)
        | st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=80, unique=True)
    )
    def check(orders):
        df = spark.createDataFrame([(o, o % 3) for o in orders], "ord long, k int").repartition(3)
        bucket = ordering.ord_levels(F.col("ord"))
        got = {r["ord"]: r["rank"] for r in ordering.ranked(df, [F.col("ord")], bucket).collect()}
        assert got == {o: i + 1 for i, o in enumerate(sorted(orders))}
        per = ordering.ranked(df, [F.col("ord")], bucket, by=["k"])
        for k in range(3):
            mine = sorted(o for o in orders if o % 3 == k)
            assert {r["ord"]: r["rank"] for r in per.collect() if r["k"] == k} == {
                o: i + 1 for i, o in enumerate(mine)
            }

    check()


def test_keys_at_edges(spark):
    df = spark.range(100).select(F.col("id").alias("ord")).withColumn("_hash", seeded_hash(1, F.col("ord")))
    order = [r["_hash"] for r in df.orderBy("_hash").collect()]
    place = ordering.hash_place(F.col("_hash"))
    total, rows = ordering.keys_at(df, ["_hash"], place, lambda n: (0, 1, 50, 50, n, n + 1))
    assert total == 100
    assert [r and r["_hash"] for r in rows] == [None, order[0], order[49], order[49], order[99], None]
    assert ordering.keys_at(df.limit(0), ["_hash"], place, lambda n: [1]) == (0, [None])


@pytest.mark.parametrize("ends", [(0, 500), (-(1 << 63), (1 << 63) - 1)])
def test_keys_at_descends_into_dense_and_sparse_keys(spark, monkeypatch, ends):
    monkeypatch.setattr(ordering, "SLICES", 8)
    monkeypatch.setattr(ordering, "LEAF_ROWS", 5)
    rng = random.Random(3)
    keys = sorted({*ends, *[rng.randint(*ends) for _ in range(300)], *range(ends[0] + 9, ends[0] + 99)})
    df = spark.createDataFrame([(k,) for k in keys], "ord long")
    total, rows = ordering.keys_at(df, ["ord"], F.col("ord"), lambda n: (1, 2, 60, 61, n // 2, n))
    assert total == len(keys)
    assert [r["ord"] for r in rows] == [keys[p - 1] for p in (1, 2, 60, 61, total // 2, total)]
    with pytest.raises(ValueError, match="place"):
        ordering.keys_at(df.union(spark.range(1).select(F.lit(None).cast("long"))), ["ord"], F.col("ord"), lambda n: [1])


def test_only_the_coarsest_level_is_summed_in_one_place(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    df = spark.range(100).withColumnRenamed("id", "ord")
    out = StringIO()
    with redirect_stdout(out):
        ordering.ranked(df, [F.col("ord")], ordering.ord_levels(F.col("ord"))).explain()
    assert out.getvalue().count("SinglePartition") == 1
    # One row a parent of 2**48 keys: as the keys are longs, at most 2**16.
    sizes = df.select(ordering.ord_levels(F.col("ord")).bucket.alias("_bucket"), F.lit(1).alias("_n"))
    top = sizes.select(ordering.ord_levels(F.col("ord")).parents[0](F.col("_bucket")).alias("p")).distinct()
    assert top.count() == 1 and 64 - ordering.TOP_BITS == 16

