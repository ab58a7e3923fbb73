"""Command line: ``python -m tagloom <command>``, or through spark-submit."""

from __future__ import annotations

import argparse
import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import schemas
from tagloom.functions.rates import rate_line
from tagloom.operators import thresholds
from tagloom.operators.splits import first_rows
from tagloom.operators.staging import stage
from tagloom.plans import build, evaluate, predict, train
from tagloom.plans.model import load_scores
from tagloom.session import build_session
from tagloom.settings import load_settings
from tagloom.sources import documents, inventory, jsonl
from tagloom.sources.shards import SOURCES


def _settings(args: argparse.Namespace) -> dict[str, Any]:
    """Command line over file over defaults; options not given change nothing."""
    sections: dict[str, dict[str, Any]] = {}
    for option, (section, key) in OVERRIDES.items():
        value = getattr(args, option, None)
        if value is not None:
            sections.setdefault(section, {})[key] = value
    return load_settings(args.config, sections)


OVERRIDES = {
    "task": ("task", "type"),
    "source": ("data", "source"),
    "cache_dir": ("data", "cache_dir"),
    "max_train_samples": ("data", "max_train_samples"),
    "max_eval_samples": ("data", "max_eval_samples"),
    "imbalance": ("data", "imbalance"),
    "output_dir": ("training", "output_dir"),
}


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    settings = load_settings(args.config, {"data": {"source": args.source}} if args.source else None)
    tasks = build.TASKS if args.task in (None, "both") else (args.task,)
    stats = build.build_corpus(
        spark, settings, args.raw_dir, args.out_dir, tasks, args.max_samples,
        args.shared_split, args.like_shuffle,
    )
    for task, info in stats["tasks"].items():
        sizes = ", ".join(f"{s}={c['n']:,}" for s, c in info["splits"].items())
        print(f"{task:<16} classes={info['num_labels']:<4} {sizes}")


def _train(spark: SparkSession, args: argparse.Namespace) -> None:
    results = train.train(spark, _settings(args), args.run_name)
    for split in ("val", "test"):
        print(f"[{split}] {rate_line(results[split])}")


def _print_rows(rows: DataFrame, order: str) -> None:
    print(*rows.columns, sep="\t")
    for row in rows.orderBy(order).toLocalIterator():
        print(*row, sep="\t")


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    predictor = predict.Predictor.load(spark, args.checkpoint, args.threshold)
    rows = jsonl.read_labelled(spark, args.input, schemas.RECORD)
    if args.max_samples:
        # Records from elsewhere have no `ord`; their place in the scan serves.
        place = F.coalesce("ord", F.monotonically_increasing_id())
        rows = first_rows(rows.withColumn("ord", place), args.max_samples)
    if rows.isEmpty():
        raise SystemExit("the input has no labelled rows")
    score = load_scores(spark, args.checkpoint, args.scorer, args.batch_size)
    scored = stage(score(predictor.prepare(rows)).drop("code"))
    if predictor.task == "detection":
        metrics = evaluate.detection_metrics(scored, predictor.threshold)
        for item in metrics.items():
            print(*item, sep="\t")
        if args.sweep:
            _print_rows(thresholds.sweep(evaluate.positive_scores(scored), "y", "score"), "threshold")
        return
    print(rate_line(evaluate.class_metrics(scored, len(predictor.names))))
    print(evaluate.report_text(scored, predictor.names))


def _tune(spark: SparkSession, args: argparse.Namespace) -> None:
    best, table = evaluate.tune(train.run_scores(spark, args.run), args.split, args.target_recall)
    _print_rows(table, "threshold")
    if best is None:
        print(f"no threshold reaches recall {args.target_recall:.0%} on {args.split}")
        return
    print(rate_line({k: v for k, v in best.items() if v is not None}))
    if args.write:
        content = evaluate.threshold_document(best, args.target_recall, args.split)
        documents.write_json(spark, f"{args.run.rstrip('/')}/best/threshold.json", content)


def _predict(spark: SparkSession, args: argparse.Namespace) -> None:
    predictor = predict.Predictor.load(spark, args.checkpoint, args.threshold)
    score = load_scores(spark, args.checkpoint, args.scorer, args.batch_size)
    if args.code or args.file:
        rows = jsonl.literal(spark, args.code) if args.code else jsonl.read_text_files(spark, args.file)
        print(predict.predict_one(predictor, score, rows.select("code")))
        return
    if not args.input:
        raise SystemExit("give one of --code, --file and --input")
    counts = predict.predict_file(spark, predictor, score, args.input, args.output)
    if counts["total"]:
        print(f"agreement {counts['agreement']:.4f} ({counts['correct']}/{counts['total']})")


def _inventory(spark: SparkSession, args: argparse.Namespace) -> None:
    tables = [inventory.folder_sizes(spark, args.raw_dir)]
    if args.models:
        tables.append(inventory.model_folders(spark, args.models))
    for table in tables:
        _print_rows(table, "folder")


def _sources(spark: SparkSession, args: argparse.Namespace) -> None:
    for name, read in sorted(SOURCES.items()):
        print(f"{name:<16} {(read.__doc__ or '').strip().splitlines()[0]}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tagloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple[str, dict[str, Any]]) -> None:
        sub = commands.add_parser(name)
        sub.set_defaults(run_command=run)
        for flag, kind in options:
            sub.add_argument(flag, **kind)

    text, number, real, flag = {"default": None}, {"type": int}, {"type": float}, {"action": "store_true"}
    needed = {"required": True}
    scoring_options = [
        ("--checkpoint", needed), ("--scorer", text), ("--threshold", real), ("--input", text),
    ]
    command(
        "build", _build, ("--config", text), ("--source", text), ("--task", text),
        ("--raw-dir", {"default": "data/raw"}), ("--out-dir", text), ("--max-samples", number),
        ("--shared-split", flag), ("--like-shuffle", flag),
    )
    command(
        "train", _train, ("--config", text), ("--source", text),
        ("--task", {"choices": build.TASKS}), ("--cache-dir", text), ("--run-name", text),
        ("--output-dir", text), ("--max-train-samples", number), ("--max-eval-samples", number),
        ("--imbalance", {"choices": ["none", "weighted_loss", "balanced_sampler"]}),
    )
    command(
        "evaluate", _evaluate, *scoring_options, ("--batch-size", {"type": int, "default": 32}),
        ("--sweep", flag), ("--max-samples", number),
    )
    command(
        "tune", _tune, ("--run", needed), ("--split", {"choices": ["val", "test"], "default": "val"}),
        ("--target-recall", {"type": float, "default": 0.90}), ("--write", flag),
    )
    command(
        "predict", _predict, *scoring_options, ("--output", text), ("--code", text),
        ("--file", text), ("--batch-size", {"type": int, "default": 16}),
    )
    command("inventory", _inventory, ("--raw-dir", {"default": "data/raw"}), ("--models", text))
    command("sources", _sources)
    return top


def main(arguments: list[str] | None = None) -> None:
    logging.basicConfig(format="[%(asctime)s] %(levelname)-7s %(message)s", level=logging.INFO)
    args = parser().parse_args(arguments)
    spark = build_session(f"tagloom-{args.command}")
    args.run_command(spark, args)


if __name__ == "__main__":
    main()
