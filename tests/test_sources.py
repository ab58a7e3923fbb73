import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom import schemas
from tagloom.operators import staging
from tagloom.sources import documents, inventory, jsonl, npy, shards


def write_shards(spark, folder, shards_of_rows):
    """Parquet files of known names, each holding its rows in order."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(folder, exist_ok=True)
    fields = [(c, pa.string()) for c in [*schemas.RAW_FIX.names, "diff_with_context"]]
    for name, rows in shards_of_rows.items():
        table = pa.Table.from_pylist(rows, schema=pa.schema(fields))
        pq.write_table(table, f"{folder}/{name}", row_group_size=2)


def fix(i, **more):
    row = {
        "cve_id": f"CVE-{i}", "hash": f"h{i}", "repo_url": "https://h/o/p", "cwe_id": "CWE-79",
        "cwe_name": "n", "language": "C", "vulnerable_code": f"bad {i}", "fixed_code": f"good {i}",
        "diff_with_context": "x" * 100,
    }
    return {**row, **more}


def test_shards_keep_file_and_row_order(spark, tmp_path):
    folder = str(tmp_path / "with space" / "cvefixes")
    write_shards(spark, folder, {
        "train-00001.parquet": [fix(i) for i in range(5, 9)],
        "train-00000.parquet": [fix(i) for i in range(5)],
        "other.parquet": [fix(99)],
    })
    rows = shards.read_shards(spark, f"{folder}/train-*.parquet", schemas.RAW_FIX)
    assert [r["cve_id"] for r in rows.orderBy("ord").collect()] == [f"CVE-{i}" for i in range(9)]
    assert rows.select("ord").distinct().count() == 9
    plan = rows.select("ord", "hash")._jdf.queryExecution().executedPlan().toString()
    assert "vulnerable_code" not in plan and "diff_with_context" not in plan
    samples = shards.source("cvefixes")(spark, str(tmp_path / "with space"), {})
    got = [r["id"] for r in samples.orderBy("ord").collect()]
    assert got == [f"CVE-{i}-{s}" for i in range(9) for s in ("vuln", "fixed")]


def test_no_shards_and_no_such_source(spark, tmp_path, caplog):
    rows = shards.read_shards(spark, str(tmp_path / "train-*.parquet"), schemas.RAW_FIX)
    assert rows.isEmpty() and rows.columns == [*schemas.RAW_FIX.names, "ord"]
    assert "no files match" in caplog.text
    with pytest.raises(ValueError, match="cvefixes"):
        shards.source("nope")


def test_a_source_can_be_added(spark):
    @shards.register_source("mine")
    def mine(spark, raw_dir, settings):
        return spark.range(3)

    try:
        assert shards.source("mine")(spark, "", {}).count() == 3
    finally:
        del shards.SOURCES["mine"]


BAD = b'{"id": "a", "code": "x", "label": 1}\n\n   \n{"id": "b", "code": \n{"id": "c", "code": null, "label": 0}\n{"id": "d", "code": "y"}\n{"id": "e", "code": "z", "label": null}\n'


def test_lenient_strict_and_labelled(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_bytes(BAD)
    lenient = jsonl.read_lenient(spark, str(bad), schemas.LABELLED_INPUT)
    assert [r["id"] for r in lenient.collect()] == ["a", "c", "d", "e"]
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILED_READ_FILE"):
        jsonl.read_strict(spark, str(bad), schemas.LABELLED_INPUT).collect()
    good = tmp_path / "good.jsonl"
    good.write_bytes(BAD.replace(b'{"id": "b", "code": \n', b""))
    assert [tuple(r) for r in jsonl.read_labelled(spark, str(good)).collect()] == [("a", "x", 1), ("c", "", 0)]
    assert [r["code"] for r in jsonl.read_records(spark, str(good)).collect()] == ["x", "", "y", "z"]


def test_non_numeric_label_raises(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "a", "code": "x", "label": "one"}\n')
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILED_READ_FILE"):
        jsonl.read_labelled(spark, str(path)).collect()


def test_write_jsonl(spark, tmp_path):
    rows = [("é中😀\n", None, 1, "train"), ("b", "x", 0, "val")]
    df = spark.createDataFrame(rows, "code string, cwe string, label int, split string")
    plain = str(tmp_path / "deep" / "plain")
    assert jsonl.write_jsonl(df, plain) == 2
    assert jsonl.write_jsonl(df.coalesce(1), plain) == 2
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "deep" / "plain").glob("*.json"))
    first = text.splitlines()[0]
    assert "é中😀" in first and json.loads(first) == {"code": "é中😀\n", "cwe": None, "label": 1, "split": "train"}
    parts = str(tmp_path / "parts")
    assert jsonl.write_jsonl(df, parts, "split") == 2
    assert sorted(p for p in os.listdir(parts) if "=" in p) == ["split=train", "split=val"]


def test_text_files_and_literals(spark, tmp_path):
    (tmp_path / "a.c").write_bytes(b"int x;\n\xff\xfe// \xc3\xa9\n")
    rows = jsonl.read_text_files(spark, str(tmp_path / "a.c")).collect()
    assert [r["code"] for r in rows] == ["int x;\n// é\n"]
    assert jsonl.literal(spark, "a\nb").collect() == [("a\nb",)]


def test_json_documents(spark, tmp_path):
    path = str(tmp_path / "deep" / "label_map.json")
    content = documents.label_map("classification", ["CWE-79", "OTHER"], {"CWE-79": 0})
    documents.write_json(spark, path, content)
    assert documents.exists(spark, path) and not documents.exists(spark, path + "x")
    assert documents.read_json(spark, path) == {
        "task": "classification", "num_labels": 2,
        "id2name": {"0": "CWE-79", "1": "OTHER"}, "name2id": {"CWE-79": 0},
    }
    assert documents.names_by_id(content) == ["CWE-79", "OTHER"]
    assert documents.names_by_id({"num_labels": 3, "id2name": {"1": "b"}}) == ["0", "b", "2"]
    assert "name2id" not in documents.label_map("detection", ["safe", "vulnerable"])
    typed = spark.read.schema(schemas.LABEL_MAP).option("multiLine", True).json(path)
    assert typed.select(F.col("id2name")["1"]).first()[0] == "OTHER"


def test_runs(spark, tmp_path):
    metrics = {
        "threshold": 0.5, "accuracy": 0.7, "precision": 0.6, "recall": 0.5, "f1": 0.55, "mcc": 0.1,
        "roc_auc": 0.8, "pr_auc": 0.7, "tn": 4, "fp": 3, "fn": 2, "tp": 1,
    }
    for run, scores in (("one", [0.5, 0.6]), ("two", [0.4])):
        history = [
            {"epoch": e, "train_loss": 1.0 / e, "val": {**metrics, "f1": f}} for e, f in enumerate(scores, 1)
        ]
        content = {
            "task": "detection", "source": "s", "model": "m", "best_epoch": len(scores),
            "history": history, "val": metrics, "test": metrics,
        }
        documents.write_json(spark, str(tmp_path / run / "results.json"), content)
    runs = documents.read_runs(spark, str(tmp_path / "*" / "results.json"))
    epochs = documents.run_history(runs).orderBy("run", "epoch").collect()
    assert [(r["run"], r["epoch"], r["f1"]) for r in epochs] == [("one", 1, 0.5), ("one", 2, 0.6), ("two", 1, 0.4)]
    finals = documents.run_scores(runs)
    assert finals.count() == 4 and finals.filter("tp = 1 AND mcc = 0.1").count() == 4


def test_npy(spark, tmp_path):
    rng = np.random.default_rng(0)
    matrix, labels, probs = rng.random((25, 3)).astype("float32"), rng.integers(0, 2, 25), rng.random(25)
    np.save(tmp_path / "logits.npy", matrix)
    np.save(tmp_path / "labels_val.npy", labels)
    np.save(tmp_path / "probs_val.npy", probs)
    rows = npy.read_npy(spark, str(tmp_path / "logits.npy")).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(25))
    assert np.array_equal([r["values"] for r in rows], matrix.astype(float))
    split = spark.read.format("npy").option("rowsPerTask", 4).load(str(tmp_path / "probs_val.npy"))
    assert split.rdd.getNumPartitions() == 7
    assert [r["value"] for r in split.orderBy("row_id").collect()] == probs.tolist()
    scores = npy.read_scores(spark, str(tmp_path), "val").orderBy("row_id").collect()
    assert [(r["y"], r["score"]) for r in scores] == list(zip(labels.tolist(), probs.tolist()))
    with pytest.raises(Exception, match="probs_test"):
        npy.read_scores(spark, str(tmp_path), "test").collect()


def test_inventory(spark, tmp_path):
    for name, size in (("raw/a/x.bin", 10), ("raw/a/deep/y.bin", 5), ("raw/a/z.part", 99), ("raw/b/q", 1), ("raw/top", 7)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"0" * size)
    got = inventory.folder_sizes(spark, str(tmp_path / "raw")).orderBy("folder").collect()
    assert [tuple(r) for r in got] == [("a", 2, 15), ("b", 1, 1)]
    for name in ("models/m1/config.json", "models/m2/deep/config.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    got = inventory.model_folders(spark, str(tmp_path / "models")).orderBy("folder").collect()
    assert [tuple(r) for r in got] == [("m1", True), ("m2", False)]


def test_staging_uses_the_sessions_folder(spark):
    base = spark.conf.get(staging.DIR_OPTION)
    assert staging.scratch_dir(spark).startswith(base)
    df = spark.createDataFrame([(1, "a", [1.0])], "ord long, s string, v array<double>")
    staged = staging.stage(df)
    assert staged.collect() == df.collect() and staged.dtypes == df.dtypes
    assert base in staged.inputFiles()[0]
