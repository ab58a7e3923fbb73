import random

import pytest
from pyspark.sql import functions as F

from tagloom import schemas
from tagloom.functions import text
from tagloom.operators import corpus, labels

CODE = "int main(void) { return 0; }"


def raw(spark, rows):
    schema = "ord long, " + ", ".join(f"{c} string" for c in schemas.RAW_FIX.names)
    return spark.createDataFrame(rows, schema)


def test_fan_out(spark):
    rows = [
        (0, "CVE-1", "h1", "https://x/org/repo", "cwe_079", " XSS ", " C ", "bad()\r\n", " good() "),
        (1, "CVE-2", None, "https://x/org/", None, None, None, None, "fixed"),
        (2, None, "h3", None, "nan", "n", "Go", "same", "same"),
        (3, "CVE-4", "h4", "u", "1", "n", "C", "  ", "\t"),
    ]
    got = [r.asDict() for r in corpus.fan_out_pairs(raw(spark, rows), "src").orderBy("ord").collect()]
    assert [(r["ord"], r["id"], r["label"], r["code"]) for r in got] == [
        (0, "CVE-1-vuln", 1, "bad()"), (1, "CVE-1-fixed", 0, "good()"),
        (3, "CVE-2-fixed", 0, "fixed"),
        (4, "None-vuln", 1, "same"), (5, "None-fixed", 0, "same"),
    ]
    first, second = got[0], got[1]
    assert first["cwe"] == "CWE-79" and first["cwe_name"] == "XSS"
    assert second["cwe"] == "" and second["cwe_name"] == ""
    assert first["group_id"] == second["group_id"] == "src::CVE-1::h1"
    assert (first["project"], first["language"], first["source"]) == ("repo", "C", "src")
    assert got[2]["group_id"] == "src::CVE-2::None" and got[2]["project"] == ""
    by_cve = corpus.fan_out_pairs(raw(spark, rows[:1]), "src", ("cve_id",))
    assert by_cve.first()["group_id"] == "src::CVE-1"


def test_first_occurrence_survives_however_rows_are_spread(spark):
    rng = random.Random(5)
    rows = [(o, f"t{rng.randrange(40)}" if o % 3 else "hot", o % 2) for o in range(600)]
    want = {}
    for o, t, y in rows:
        want.setdefault(t, (o, y))
    df = spark.createDataFrame(rows, "ord long, code string, label int")
    for parts in (1, 7):
        kept = corpus.first_per_fingerprint(df.repartition(parts), text.fingerprint(F.col("code")))
        assert {r["code"]: (r["ord"], r["label"]) for r in kept.collect()} == want


def test_duplicates_shrink_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "ord long, code string")
    plan = corpus.first_per_fingerprint(df, F.md5("code"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_filters(spark):
    rows = [(0, "a" * 30, 1, "CWE-1"), (1, "b" * 29, 1, ""), (2, "é" * 30, 0, "")]
    df = spark.createDataFrame(rows, "ord long, code string, label int, cwe string")
    assert [r["ord"] for r in df.filter(corpus.long_enough(30)).orderBy("ord").collect()] == [0, 2]
    assert [r["ord"] for r in corpus.task_rows(df, "classification").collect()] == [0]
    assert corpus.task_rows(df, "detection").count() == 3


def test_labelled_only(spark):
    df = spark.createDataFrame([("x", 1), (None, 0), ("y", None)], "code string, label int")
    assert sorted(corpus.labelled_only(df).collect()) == [("", 0), ("x", 1)]


def tail(spark):
    sizes = {"big": 50, "tie-late": 30, "tie-early": 30, "short": 29, "rare": 1}
    order = ["tie-early", "big", "tie-late", "short", "rare"]
    names = [n for n in order] + [n for n in order for _ in range(sizes[n] - 1)]
    return spark.createDataFrame(list(enumerate(names)), "ord long, cwe string").repartition(5)


def test_class_table_orders_by_count_then_first_seen(spark):
    frequency = labels.class_frequency(tail(spark), "cwe")
    for top_k, want in ((40, ["big", "tie-early", "tie-late"]), (2, ["big", "tie-early"]), (None, ["big", "tie-early", "tie-late"])):
        table = labels.class_table(frequency, 30, top_k).orderBy("id").collect()
        assert [(r["id"], r["name"]) for r in table] == list(enumerate(want))
    assert [tuple(r) for r in labels.with_other(labels.class_table(frequency, 30, 2)).orderBy("id").collect()] == [
        (0, "big"), (1, "tie-early"), (2, "OTHER"),
    ]


def test_more_classes_than_kept(spark):
    rows = [(i, f"c{i % 45:02d}") for i in range(45 * 30)]
    df = spark.createDataFrame(rows, "ord long, cwe string")
    table = labels.class_table(labels.class_frequency(df, "cwe"))
    assert table.count() == 40 and table.filter("name >= 'c40'").count() == 0


def test_encode_and_decode(spark):
    df = tail(spark)
    classes = labels.class_table(labels.class_frequency(df, "cwe"), 30, 2)
    encoded = labels.encode_labels(df, classes, "cwe", bound=2)
    got = {r["cwe"]: r["label"] for r in encoded.select("cwe", "label").distinct().collect()}
    assert got == {"big": 0, "tie-early": 1, "tie-late": 2, "short": 2, "rare": 2}
    assert encoded.count() == df.count()
    plain = labels.encode_labels(df, classes, "cwe", bound=None)
    assert plain.exceptAll(encoded).isEmpty()
    ids = spark.createDataFrame([(0,), (2,), (9,)], "label int")
    names = labels.decode_labels(ids, labels.with_other(classes), "label", bound=3).collect()
    assert {r["label"]: r["name"] for r in names} == {0: "big", 2: "OTHER", 9: "9"}
    inline = ids.select(labels.name_of(F.col("label"), ["a", "b", "c"]).alias("n")).collect()
    assert [r["n"] for r in inline] == ["a", "c", "9"]


def test_class_count(spark):
    df = spark.createDataFrame([(0,), (6,)], "label int")
    assert labels.class_count(df, 3).first()["num_labels"] == 7
    assert labels.class_count(df, 9).first()["num_labels"] == 9
    assert labels.class_count(df.limit(0), 0).first()["num_labels"] == 1


@pytest.mark.parametrize("most,bits", [(1_000_000, 1 << 28), (0, 1 << 28), (0, 1 << 16), (0, 4)])
def test_first_by_keys_equals_the_window(spark, monkeypatch, most, bits):
    monkeypatch.setattr(corpus, "MOST_BROADCAST", most)
    monkeypatch.setattr(corpus, "FILTER_BITS", bits)
    rng = random.Random(bits)
    rows = [(o, f"t{rng.randrange(60)}" if rng.random() < 0.6 else f"u{o}", "x") for o in rng.sample(range(-(1 << 40), 1 << 40), 400)]
    rows += [(1 << 50, None, "x"), ((1 << 50) + 1, None, "x"), ((1 << 50) + 2, "", "x")] + [(-5 - i, "hot", "x") for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, code string, _key string").repartition(5)
    mark = text.fingerprint(F.coalesce("code", F.lit("")))
    want = sorted(tuple(r) for r in corpus.first_per_fingerprint(df, mark).select("ord", "code_hash").collect())
    done = corpus.first_by_keys(df, mark)
    assert sorted((r["ord"], r["code_hash"]) for r in done.collect()) == want
    assert done.columns == [*df.columns, "code_hash"]
    none = corpus.first_by_keys(df.filter("code like 'u%'"), mark)
    assert none.count() == df.filter("code like 'u%'").count()
    assert corpus.first_by_keys(df.limit(0), mark).count() == 0


def test_texts_that_stay_are_not_moved(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    df = spark.createDataFrame([(i, f"t{i % 4}") for i in range(9)], "ord long, code string")
    out = StringIO()
    with redirect_stdout(out):
        corpus.first_by_keys(df, text.fingerprint(F.col("code"))).explain()
    assert "Exchange hashpartitioning" not in out.getvalue() and "BroadcastHashJoin" in out.getvalue()
