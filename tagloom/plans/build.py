"""Raw fix commits -> split, labelled JSON Lines with dictionaries and counts."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tagloom import schemas
from tagloom.functions import text
from tagloom.operators import corpus, labels, splits
from tagloom.operators.staging import scratch_dir, stage
from tagloom.sources import documents, jsonl
from tagloom.sources.shards import source as find_source

log = logging.getLogger(__name__)

TASKS = ("detection", "classification")
# A dictionary document lists every class, so it has to stay a document.
MOST_CLASSES = 1_000_000


def task_path(out_dir: str, source: str, task: str) -> str:
    """Folder of a task's records, one ``split=...`` subfolder per split."""
    return f"{out_dir.rstrip('/')}/{source}_{task}"


def read_split(
    spark: SparkSession, out_dir: str, source: str, task: str, split: str
) -> DataFrame:
    """One split's records; the other splits' files are not opened."""
    return jsonl.read_strict(
        spark, f"{task_path(out_dir, source, task)}/split={split}", schemas.RECORD
    )


def distinct_samples(
    samples: DataFrame, settings: Mapping[str, Any], path: str, max_samples: int | None = None
) -> DataFrame:
    """Length filter, truncation, extraction limit and deduplication, staged
    at ``path``: every later pass reads only the columns it needs."""
    data = settings["data"]
    seen = Observation()
    short = ~corpus.long_enough(data["min_code_chars"])
    observed = samples.observe(
        seen, F.count(F.lit(1)).alias("read"), F.count_if(short).alias("short")
    )
    kept = observed.filter(~short)
    kept = splits.first_rows(kept, max_samples)
    kept = kept.withColumn("code", text.truncate_middle(F.col("code"), data["max_code_chars"]))
    if data["dedup"]:
        kept = corpus.first_by_keys(kept, text.fingerprint(F.col("code")), path=f"{path}-keys")
    staged = stage(kept, path)
    documents.remove(samples.sparkSession, f"{path}-keys")
    counts = seen.get
    log.info("read %s samples, %s too short", counts["read"], counts["short"])
    return staged


def encode_task(
    samples: DataFrame, task: str, settings: Mapping[str, Any]
) -> tuple[DataFrame, list[str], dict[str, int]]:
    """The task's rows with integer labels, class names in id order, and the
    codes of the classes that have one."""
    pool = corpus.task_rows(samples, task)
    if task == "detection":
        names = [labels.DETECTION_NAMES[i] for i in sorted(labels.DETECTION_NAMES)]
        return pool, names, {"0": 0, "1": 1}
    options = settings["task"]
    top_k = options.get("top_k_classes")
    classes = labels.class_table(
        labels.class_frequency(pool, "cwe"), options.get("min_class_samples", 30), top_k
    )
    if not top_k and classes.count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes; set task.top_k_classes")
    kept = [row["name"] for row in classes.orderBy("id").select("name").collect()]
    table = documents.dictionary(samples.sparkSession, kept)
    encoded = labels.encode_labels(pool, table, "cwe", bound=len(kept))
    return encoded, [*kept, labels.OTHER], {name: i for i, name in enumerate(kept)}


def split_task(
    encoded: DataFrame,
    settings: Mapping[str, Any],
    groups_of: DataFrame | None = None,
    like_shuffle: bool = False,
) -> DataFrame:
    """Add ``split`` and apply the caps. ``groups_of`` fits the split on other
    rows, for one split shared by both tasks."""
    data, seed = settings["data"], settings["seed"]
    shares = {"train": data["train_ratio"], "val": data["val_ratio"]}
    if like_shuffle and groups_of is not None:
        raise ValueError("a shared split cannot also follow a list shuffle; choose one")
    if like_shuffle:
        assigned = splits.shuffle_split(encoded, seed=seed, **shares, place="place")
    else:
        basis = encoded if groups_of is None else groups_of
        assigned = splits.fit_group_split(basis, seed=seed, **shares).assign(encoded)
    caps = {
        "train": data["max_train_samples"],
        "val": data["max_eval_samples"],
        "test": data["max_eval_samples"],
    }
    if any(cap is not None for cap in caps.values()):
        parts = []
        for split, cap in caps.items():
            rows = assigned.filter(F.col("split") == split)
            if like_shuffle:
                parts.append(splits.shuffle_sample(rows, cap, seed, "place"))
            else:
                parts.append(splits.sample_rows(rows, cap, seed))
        assigned = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return assigned.select(*encoded.columns, "split")


def split_counts(rows: DataFrame) -> dict[str, Any]:
    """Rows and label counts per split, from one small aggregate."""
    counts = labels.label_distribution(rows, "split").orderBy("split", "label").collect()
    result: dict[str, Any] = {s: {"n": 0, "label_dist": {}} for s in splits.SPLITS}
    for row in counts:
        result[row["split"]]["n"] += row["n"]
        result[row["split"]]["label_dist"][str(row["label"])] = row["n"]
    return result


def build_corpus(
    spark: SparkSession,
    settings: Mapping[str, Any],
    raw_dir: str,
    out_dir: str | None = None,
    tasks: Sequence[str] = TASKS,
    max_samples: int | None = None,
    shared_split: bool = False,
    like_shuffle: bool = False,
) -> dict[str, Any]:
    """Build the records of each task and return the statistics document.

    Each task is split on its own groups, so a group may be in train for one
    task and in test for the other; ``shared_split`` rules that out.
    """
    name = settings["data"]["source"]
    out_dir = (out_dir or settings["data"]["cache_dir"]).rstrip("/")
    samples = find_source(name)(spark, raw_dir, settings)
    scratch = scratch_dir(spark)
    try:
        staged = distinct_samples(samples, settings, scratch, max_samples)
        stats: dict[str, Any] = {"source": name, "total_raw": staged.count(), "tasks": {}}
        for task in tasks:
            basis = staged if shared_split else None
            counts = write_task(staged, task, settings, out_dir, basis, like_shuffle)
            if counts is None:
                log.warning("no usable samples for %s", task)
            else:
                stats["tasks"][task] = counts
    finally:
        documents.remove(spark, scratch)
    documents.write_json(spark, f"{out_dir}/{name}_stats.json", stats)
    return stats


def write_task(
    samples: DataFrame,
    task: str,
    settings: Mapping[str, Any],
    out_dir: str,
    groups_of: DataFrame | None = None,
    like_shuffle: bool = False,
) -> dict[str, Any] | None:
    """Encode, split and write one task; its part of the statistics."""
    spark, name = samples.sparkSession, settings["data"]["source"]
    encoded, names, codes = encode_task(samples, task, settings)
    if encoded.isEmpty():
        return None
    rows = split_task(encoded, settings, groups_of, like_shuffle)
    written = jsonl.write_jsonl(rows, task_path(out_dir, name, task), "split")
    log.info("%s: %s records", task, f"{written:,}")
    document = documents.label_map(task, names, codes)
    documents.write_json(spark, f"{out_dir}/{name}_{task}_label_map.json", document)
    return {"num_labels": len(names), "splits": split_counts(rows)}
