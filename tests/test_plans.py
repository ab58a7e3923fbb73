import json
import os
import random
from pathlib import Path

import pytest
from stubs import BadWordScorer, LengthScorer
from test_sources import fix, write_shards

from tagloom import cli, settings
from tagloom.operators import scoring
from tagloom.plans import build, evaluate, model, predict, train
from tagloom.sources import documents, jsonl
from tagloom.streaming.scoring import score_new_files

PAD = "int main(void) { return 0; } // "


def corpus_rows():
    """60 fixes: two classes of 30 and 20 rows, a tail, doubles and blanks."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        cwe = "CWE-79" if i < 30 else "cwe_089" if i < 50 else f"CWE-{900 + i}"
        bad = PAD + f"strcpy(buffer, input_{i}); gets(line_{rng.randrange(9)});"
        good = PAD + f"strncpy(buffer, input_{i}, n); fgets(line, {rng.randrange(9)});"
        rows.append(fix(i, cwe_id=cwe, vulnerable_code=bad, fixed_code=good))
    rows.append(fix(60, vulnerable_code="short", fixed_code=None))
    rows.append(fix(61, vulnerable_code=rows[3]["vulnerable_code"], fixed_code=rows[3]["vulnerable_code"]))
    rows.append(fix(62, cwe_id=None, vulnerable_code=PAD + "x" * 300, fixed_code=" "))
    return rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    rows = corpus_rows()
    write_shards(spark, str(base / "raw" / "cvefixes"), {
        "train-00000.parquet": rows[:40], "train-00001.parquet": rows[40:],
    })
    config = settings.load_settings(None, {
        "task": {"min_class_samples": 20, "top_k_classes": 2},
        "data": {"max_code_chars": 200, "cache_dir": str(base / "out")},
        "training": {"output_dir": str(base / "runs")},
    })
    stats = build.build_corpus(spark, config, str(base / "raw"))
    return base, config, stats


def records(spark, base, task):
    return {
        s: build.read_split(spark, str(base / "out"), "cvefixes", task, s).collect()
        for s in ("train", "val", "test")
    }


def test_build_counts_and_documents(spark, built):
    base, _, stats = built
    # 60 pairs and one truncated sample; the short one and both doubles go.
    assert stats["source"] == "cvefixes" and stats["total_raw"] == 121
    out = base / "out"
    assert json.loads((out / "cvefixes_stats.json").read_text()) == stats
    detection, classes = stats["tasks"]["detection"], stats["tasks"]["classification"]
    assert detection["num_labels"] == 2 and sum(s["n"] for s in detection["splits"].values()) == 121
    assert sum(s["label_dist"].get("1", 0) for s in detection["splits"].values()) == 61
    assert classes["num_labels"] == 3 and sum(s["n"] for s in classes["splits"].values()) == 60
    names = json.loads((out / "cvefixes_classification_label_map.json").read_text())
    assert names["id2name"] == {"0": "CWE-79", "1": "CWE-89", "2": "OTHER"}
    assert names["name2id"] == {"CWE-79": 0, "CWE-89": 1}
    binary = json.loads((out / "cvefixes_detection_label_map.json").read_text())
    assert binary["id2name"] == {"0": "safe", "1": "vulnerable"} and binary["name2id"] == {"0": 0, "1": 1}


def test_build_records(spark, built):
    base, _, stats = built
    for task in build.TASKS:
        splits = records(spark, base, task)
        groups = {s: {r["group_id"] for r in rows} for s, rows in splits.items()}
        assert not groups["train"] & groups["val"] and not groups["train"] & groups["test"]
        assert not groups["val"] & groups["test"]
        for s, rows in splits.items():
            assert len(rows) == stats["tasks"][task]["splits"][s]["n"]
    every = [r for rows in records(spark, base, "detection").values() for r in rows]
    assert len({r["code_hash"] for r in every}) == len(every)
    double = [r for r in every if r["code"] == corpus_rows()[3]["vulnerable_code"]]
    assert [(r["id"], r["label"]) for r in double] == [("CVE-3-vuln", 1)]
    cut = [r for r in every if r["id"] == "CVE-62-vuln"][0]
    assert len(cut["code"]) > 200 and cut["cwe"] == ""
    assert {len(r["cwe"]) > 0 for r in every if r["label"] == 0} == {False}


def test_build_leaves_no_scratch_table(spark, built, tmp_path):
    base, config, _ = built
    scratch = Path(spark.conf.get("spark.checkpoint.dir")) / spark.sparkContext.applicationId
    before = set(scratch.iterdir())
    build.build_corpus(spark, config, str(base / "raw"), str(tmp_path), ["detection"])
    assert set(scratch.iterdir()) == before


def test_rebuild_gives_the_same_rows(spark, built, tmp_path):
    base, config, stats = built
    again = build.build_corpus(spark, config, str(base / "raw"), str(tmp_path))
    assert again == stats


def test_build_options(spark, built, tmp_path):
    base, config, _ = built
    capped = settings.merged(config, {"data": {"max_train_samples": 10, "max_eval_samples": 2, "dedup": False}})
    stats = build.build_corpus(spark, capped, str(base / "raw"), str(tmp_path / "a"), ["detection"], max_samples=50)
    sizes = {s: v["n"] for s, v in stats["tasks"]["detection"]["splits"].items()}
    assert stats["total_raw"] == 50 and sizes == {"train": 10, "val": 2, "test": 2}
    build.build_corpus(spark, config, str(base / "raw"), str(tmp_path / "b"), shared_split=True)
    where = {}
    for task in build.TASKS:
        for s in ("train", "val", "test"):
            for r in build.read_split(spark, str(tmp_path / "b"), "cvefixes", task, s).collect():
                assert where.setdefault(r["group_id"], s) == s
    capped = settings.merged(config, {"data": {"max_train_samples": 20}})
    stats = build.build_corpus(spark, capped, str(base / "raw"), str(tmp_path / "c"), ["detection"], like_shuffle=True)
    sizes = {s: v["n"] for s, v in stats["tasks"]["detection"]["splits"].items()}
    assert sizes["train"] == 20 and sizes["val"] == 12
    row = build.read_split(spark, str(tmp_path / "c"), "cvefixes", "detection", "val").first()
    assert set(row.asDict()) == set(build.schemas.RECORD.names)


def test_build_without_input(spark, built, tmp_path):
    _, config, _ = built
    stats = build.build_corpus(spark, config, str(tmp_path / "nothing"), str(tmp_path / "out"))
    assert stats == {"source": "cvefixes", "total_raw": 0, "tasks": {}}


@pytest.fixture(scope="module")
def trained(spark, built):
    _, config, _ = built
    results = train.train(spark, config, "first")
    return Path(config["training"]["output_dir"]) / "first", results


def test_train_run_folder(spark, trained):
    run, results = trained
    assert json.loads((run / "results.json").read_text())["test"]["tp"] == results["test"]["tp"]
    told = [e["val"]["f1"] for e in results["history"]]
    assert [e["epoch"] for e in results["history"]] == list(range(1, len(told) + 1))
    assert results["best_epoch"] == 1 + told.index(max(told))
    # Two epochs without a gain end the training, three are the most.
    assert len(told) == min(3, results["best_epoch"] + 2)
    losses = [e["train_loss"] for e in results["history"]]
    assert losses == sorted(losses, reverse=True)
    assert results["val"]["roc_auc"] > 0.5
    assert json.loads((run / "best" / "label_map.json").read_text())["num_labels"] == 2
    assert "run_name: first" in (run / "config.yaml").read_text()
    runs = documents.read_runs(spark, str(run / "results.json"))
    assert documents.run_history(runs).agg({"epoch": "max"}).first()[0] == len(told)


def test_patience_and_unmeasured_epochs(spark, built, tmp_path):
    _, config, _ = built
    rows, names = train.load_splits(spark, config)
    config = settings.merged(config, {"training": {"epochs": 9, "early_stopping_patience": 2}})
    scores = iter([0.2, 0.5, float("nan"), 0.5, 0.9])
    done = model.fit_epochs(rows["train"], config, 2, lambda _: ({}, next(scores)), features=64, iterations=1)
    assert done.best_epoch == 2 and [e["epoch"] for e in done.history] == [1, 2, 3, 4]
    assert not done.best.stages[-1].hasSummary
    done = model.fit_epochs(rows["train"], config, 2, lambda _: ({}, float("nan")), features=64, iterations=1)
    assert done.best is None and done.best_epoch == -1 and len(done.history) == 2


def test_tune_and_predict(spark, trained, tmp_path, capsys):
    run, _ = trained
    best, table = evaluate.tune(train.run_scores(spark, str(run)), "val", 0.9)
    assert best["recall"] >= 0.9 and table.count() == 9
    content = evaluate.threshold_document(best, 0.9, "val")
    documents.write_json(spark, str(run / "best" / "threshold.json"), content)
    loaded = predict.Predictor.load(spark, str(run / "best"))
    assert loaded.threshold == best["threshold"]
    assert predict.Predictor.load(spark, str(run / "best"), 0.7).threshold == 0.7
    score = model.load_scores(spark, str(run / "best"), None)
    one = predict.predict_one(loaded, score, jsonl.literal(spark, "gets(line);"))
    assert set(one) == {"label", "verdict", "confidence", "prob_safe", "prob_vulnerable", "threshold"}
    assert one["prob_safe"] + one["prob_vulnerable"] == pytest.approx(1.0)


@pytest.mark.parametrize("imbalance", ["none", "balanced_sampler"])
def test_other_imbalance_strategies(spark, built, imbalance):
    _, config, _ = built
    chosen = settings.merged(config, {"data": {"imbalance": imbalance}})
    rows, names = train.load_splits(spark, chosen)
    weighted = model.balance_rows(rows["train"], chosen, len(names))
    n = rows["train"].count()
    assert weighted.agg({"weight": "sum"}).first()[0] == pytest.approx(n)


def test_classification_training(spark, built):
    _, config, _ = built
    config = settings.merged(config, {"task": {"type": "classification"}})
    results = train.train(spark, config, "classes")
    assert {"accuracy", "macro_f1", "weighted_f1", "micro_f1", "top3_accuracy"} <= set(results["val"])
    run = Path(config["training"]["output_dir"]) / "classes"
    lines = (run / "report_test.txt").read_text().splitlines()
    assert len(lines) == 5 and lines[2].startswith("CWE-79")


INPUT = [
    {"id": "a", "code": "bad bad bad bad", "label": 1},
    {"id": None, "code": "bad", "label": 1},
    {"code": "fine"},
    {"id": "d", "label": 0},
]


@pytest.fixture
def records_file(tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in INPUT) + "\n\n")
    return path


def test_predict_file_with_a_plugged_in_scorer(spark, records_file):
    predictor = predict.Predictor("detection", ["safe", "vulnerable"], 0.5)
    counts = predict.predict_file(
        spark, predictor, model.plugged_scores("stubs:BadWordScorer"), str(records_file)
    )
    assert counts == {"correct": 2, "total": 3, "agreement": pytest.approx(2 / 3)}
    out = records_file.with_suffix(".pred.jsonl")
    rows = [json.loads(line) for p in sorted(out.glob("part-*")) for line in p.read_text().splitlines()]
    assert [r.get("id", "absent") for r in rows] == ["a", None, None, "d"]
    assert ["gold" in r for r in rows] == [True, True, False, True]
    assert rows[1]["pred"] == {
        "label": 0, "verdict": "safe", "confidence": 0.75, "prob_safe": 0.75,
        "prob_vulnerable": 0.25, "threshold": 0.5,
    }


def test_low_threshold_gives_low_confidence(spark, records_file):
    predictor = predict.Predictor("detection", ["safe", "vulnerable"], 0.25)
    scored = scoring.score(jsonl.read_records(spark, str(records_file)), BadWordScorer)
    row = predictor.shape(scored).filter("code = 'bad'").first()["pred"]
    assert (row["label"], row["verdict"], row["confidence"]) == (1, "vulnerable", 0.25)


def test_class_predictions(spark, records_file):
    predictor = predict.Predictor("classification", ["c0", "c1", "c2", "c3", "c4"], 0.5)
    scored = scoring.score(jsonl.read_records(spark, str(records_file)), LengthScorer)
    pred = predictor.shape(scored).filter("code = 'bad bad bad bad'").first()["pred"].asDict(recursive=True)
    assert (pred["label"], pred["cwe"], pred["confidence"]) == (3, "c3", 0.5)
    assert [c["cwe"] for c in pred["topk"]] == ["c3", "c0", "c1", "c2", "c4"]
    unnamed = predict.Predictor("classification", [], 0.5)
    assert unnamed.shape(scored).filter("code = ''").first()["pred"]["cwe"] == "0"


def test_streamed_scoring_matches_batch(spark, records_file, tmp_path):
    predictor = predict.Predictor("detection", ["safe", "vulnerable"], 0.5)
    score = model.plugged_scores("stubs:BadWordScorer")
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    for round_, want in ((1, 4), (2, 8)):
        (folder / f"{round_}.jsonl").write_text(records_file.read_text())
        query = score_new_files(spark, predictor, score, str(folder), out, state)
        assert query.awaitTermination(120)
        # Only the new file was scored.
        assert spark.read.text(out).count() == want
    batch = predict.prediction_lines(predictor.shape(score(jsonl.read_records(spark, str(records_file)))))
    assert spark.read.text(out).exceptAll(batch.union(batch)).isEmpty()


def test_older_checkpoints_cut_by_characters(spark, tmp_path):
    best = tmp_path / "run" / "best"
    best.mkdir(parents=True)
    limit = lambda: predict.Predictor.load(spark, str(best)).max_code_chars
    assert limit() is None
    for text, want in (
        ("model: {max_length: 512}", 8000), ("model: {max_code_chars: 10}", 10),
        ("model: {head_ratio: 0.6, max_code_chars: 10}", None), ("", 8000),
    ):
        (tmp_path / "run" / "config.yaml").write_text(text)
        assert limit() == want
    old = predict.Predictor("detection", ["safe", "vulnerable"], 0.5, max_code_chars=10)
    rows = jsonl.literal(spark, "a" * 100)
    assert old.prepare(rows).first()["code"].startswith("aaaaaa\n") and len(old.prepare(rows).first()["code"]) < 60
    with pytest.raises(FileNotFoundError):
        predict.Predictor.load(spark, str(tmp_path / "nowhere"))


def test_chosen_threshold():
    good, bad = '{"threshold": 0.2}', "{broken"
    assert scoring.chosen_threshold(0.7, good) == 0.7
    assert scoring.chosen_threshold(None, good) == 0.2
    for document in (bad, None, "{}", "[]", '{"threshold": "x"}'):
        assert scoring.chosen_threshold(None, document) == 0.5
    assert scoring.chosen_threshold(0.0, good) == 0.0


def test_default_output():
    assert predict.default_output("a.b/in.jsonl") == "a.b/in.pred.jsonl"
    assert predict.default_output("a.b/in") == "a.b/in.pred.jsonl"


def test_command_line(spark, built, trained, records_file, capsys, tmp_path):
    base, _, _ = built
    run, _ = trained
    out = str(tmp_path / "cli")
    cli.main(["build", "--raw-dir", str(base / "raw"), "--out-dir", out, "--task", "detection"])
    assert "classes=2" in capsys.readouterr().out
    best = str(run / "best")
    cli.main(["tune", "--run", str(run), "--target-recall", "0.9", "--write"])
    assert os.path.exists(f"{best}/threshold.json") and "threshold=" in capsys.readouterr().out
    cli.main(["evaluate", "--checkpoint", best, "--input", f"{out}/cvefixes_detection", "--sweep"])
    assert "roc_auc" in capsys.readouterr().out
    cli.main(["evaluate", "--checkpoint", best, "--input", str(records_file), "--max-samples", "2"])
    assert "\ntn\t" in capsys.readouterr().out
    cli.main(["predict", "--checkpoint", best, "--code", "gets(x);"])
    assert "verdict" in capsys.readouterr().out
    cli.main(["predict", "--checkpoint", best, "--input", str(records_file), "--scorer", "stubs:BadWordScorer"])
    assert "/3)" in capsys.readouterr().out
    cli.main(["sources"])
    assert capsys.readouterr().out.startswith("cvefixes")
    cli.main(["inventory", "--raw-dir", str(base / "raw")])
    assert "cvefixes" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["predict", "--checkpoint", best])


def test_a_scorer_is_told_its_checkpoint_and_settings(spark, tmp_path):
    run = tmp_path / "run"
    (run / "best").mkdir(parents=True)
    (run / "config.yaml").write_text('{"model": {"max_length": 256}}')
    checkpoint = str(run / "best")
    rows = spark.createDataFrame([("x",), ("y",)], "code string")
    for texts, n in ((rows, 2), (rows.limit(0), 0)):
        got = model.load_scores(spark, checkpoint, "stubs:EchoScorer")(texts).collect()
        assert [r["probs"] for r in got] == [[len(checkpoint), 256.0, 0.6]] * n
