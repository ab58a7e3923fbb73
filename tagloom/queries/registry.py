"""Name -> query, name -> equivalent SQL, and helpers both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.functions import text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _ORACLES[function.__name__] = sql
        return function

    return add


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL fragments ------------------------------------------------------


def sql_text(value: str) -> str:
    """A SQL string expression; control characters as chr() calls."""
    pieces, plain = [], ""
    for ch in value:
        if ch.isprintable() and ch != "'":
            plain += ch
            continue
        if plain:
            pieces.append(f"'{plain}'")
            plain = ""
        pieces.append(f"chr({ord(ch)})")
    if plain:
        pieces.append(f"'{plain}'")
    return "(" + " || ".join(pieces or ["''"]) + ")"


def sql_clean(column: str) -> str:
    unix = f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"trim({unix}, {sql_text(text.WHITE_SPACE)})"


def sql_truncate(column: str, max_chars: int, head: int) -> str:
    tail = max_chars - head
    cut = f"left({column}, {head}) || {sql_text(text.CUT_MARK)} || right({column}, {tail})"
    return f"CASE WHEN length({column}) > {max_chars} THEN {cut} ELSE {column} END"


def sql_class_id(column: str) -> str:
    upper = f"upper(trim({column}, {sql_text(text.WHITE_SPACE)}))"
    digits = f"regexp_replace({upper}, '[^0-9]', '', 'g')"
    unknown = ", ".join(f"'{u}'" for u in text.UNKNOWN_CLASS_IDS)
    return (
        f"CASE WHEN {column} IS NULL OR {upper} IN ({unknown}) OR {digits} = '' THEN '' "
        f"WHEN ltrim({digits}, '0') = '' THEN 'CWE-0' "
        f"ELSE 'CWE-' || ltrim({digits}, '0') END"
    )


def sql_split(groups: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> str:
    """``SELECT key, split``: groups in hash order, cut at truncated products."""
    return f"""
    SELECT {key}, CASE
        WHEN r <= CAST(floor(n * CAST({train} AS DOUBLE)) AS BIGINT) THEN 'train'
        WHEN r <= CAST(floor(n * CAST({train} AS DOUBLE)) AS BIGINT)
                + CAST(floor(n * CAST({val} AS DOUBLE)) AS BIGINT) THEN 'val'
        ELSE 'test' END AS split
    FROM (SELECT {key}, count(*) OVER () AS n,
                 row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) AS r
          FROM (SELECT DISTINCT {key} FROM {groups}))"""
