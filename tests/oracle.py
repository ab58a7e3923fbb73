"""Runs a registered query and its SQL twin and compares the results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=repr)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def compare(result, con, sql: str) -> str | None:
    """None when the DataFrame equals the SQL's rows, else what differs."""
    ours = _sorted_rows(result.columns, [tuple(r) for r in result.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    theirs = _sorted_rows(names, cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    for name, kind in result.dtypes:
        if KINDS.get(kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    if not ours[1]:
        return "both empty"
    different = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if different:
        a, b = different[0]
        return f"{len(different)} of {len(ours[1])} rows differ, as\n  {str(a)[:400]}\n  {str(b)[:400]}"
    return None
