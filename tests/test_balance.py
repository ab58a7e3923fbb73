import pytest

from tagloom.operators import balance


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, 1 if i < 5 else 0, f"row {i}") for i in range(1000)]
    return spark.createDataFrame(rows, "ord long, label int, code string").repartition(4)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 16 + [(1,)] * 4, "label int")
    got = {r["class_id"]: r["weight"] for r in balance.class_weights(df, 2).collect()}
    assert got == {0: 20 / 32, 1: 20 / 8}


def test_empty_classes_count_as_one_row(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(2,)] * 3, "label int")
    got = {r["class_id"]: (r["n"], r["weight"]) for r in balance.class_weights(df, 4).collect()}
    assert got == {
        0: (6, pytest.approx(11 / 24)), 1: (1, pytest.approx(11 / 4)),
        2: (3, pytest.approx(11 / 12)), 3: (1, pytest.approx(11 / 4)),
    }


def test_balanced_sample(skewed):
    drawn = balance.balanced_sample(skewed, seed=3)
    rows = drawn.collect()
    assert sum(r["draws"] for r in rows) == 1000
    assert len({r["ord"] for r in rows}) == len(rows)
    rare = [r["draws"] for r in rows if r["label"] == 1]
    assert 430 < sum(rare) < 570
    assert len(rare) == 5 and min(rare) > 60
    again = balance.balanced_sample(skewed.repartition(9), seed=3)
    assert drawn.exceptAll(again).isEmpty()


def test_expanded_sample_repeats_rows(skewed, monkeypatch):
    # Small chunks, so that one row's draws are spread over several.
    monkeypatch.setattr(balance, "DRAW_BITS", 4)
    expanded = balance.balanced_sample(skewed, seed=3, expand=True)
    assert expanded.columns == skewed.columns and expanded.count() == 1000
    counts = {r["ord"]: r["count"] for r in expanded.groupBy("ord").count().collect()}
    drawn = balance.balanced_sample(skewed, seed=3).collect()
    assert counts == {r["ord"]: r["draws"] for r in drawn}


def test_nothing_to_draw_from(skewed):
    assert balance.balanced_sample(skewed.limit(0), seed=1).isEmpty()
    assert balance.balanced_sample(skewed.limit(0), seed=1, expand=True).isEmpty()
