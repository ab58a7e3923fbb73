"""Registered queries of the numbered operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tagloom.llm import (
    brown,
    chat,
    embeddings,
    filter_audit,
    fixity,
    line_dedup,
    mixing,
    near_dup,
    packing,
    quadratic,
    quality,
    toxicity,
    turn_repair,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        embeddings.op1_embedding_near_dup,
        chat.op2_chat_format,
        fixity.op3_warc_fixity,
        near_dup.op4_near_duplicates,
        mixing.op5_entropy_mix,
        toxicity.op6_toxicity_neighbours,
        brown.op7_brown_classes,
        quality.op8_quality_divergence,
        packing.op9_best_fit_packing,
        line_dedup.op10_line_dedup,
        quadratic.op11_quadratic_quality,
        turn_repair.op12_turn_repair,
        filter_audit.op13_filter_potential,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
# Operators 5, 6, 7, 9, 10, 11 and the pipeline iterate, fit or encode: they are
# tested by brute force instead.
ORACLES: dict[str, str] = {
    "op1_embedding_near_dup": embeddings.ORACLE,
    "op2_chat_format": chat.ORACLE,
    "op3_warc_fixity": fixity.ORACLE,
    "op4_near_duplicates": near_dup.ORACLE,
    "op12_turn_repair": turn_repair.ORACLE,
    "op13_filter_potential": filter_audit.ORACLE,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
