"""Conversation structure repair by Wagner-Fischer target alignment (operator 12).

A conversation is sound when its role initials read ``(s?(ua)+)?``. Its turns
are aligned to the grammar string of every feasible length; the edits are Keep
(0), Rerole to user or assistant (1), Delete (2) and Insert of an empty user or
assistant turn (5). Blank and duplicate turns must go; a truncated turn that
stays adds 5. Of the cheapest alignments the one whose audit, the initials of
its edits in order, is least in ASCII order repairs the conversation.

The strings of all lengths end alike, so the alignments of the rows from ``i``
on to the last ``r`` symbols are one table for all lengths. Its rows are
computed only in the band that an incumbent's cost allows (Ukkonen); a cost
found beyond the band becomes the incumbent of the next, wider one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}
# Fixed: what separates words; a turn of nothing else is blank.
SEPARATORS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
FAR = np.int64(1) << 50
# Conversations look alike: repairs by pattern that a worker remembers, and up
# to what length.
MOST_REMEMBERED, SHORT = 100_000, 64


class Repair(NamedTuple):
    """``rows`` holds the numbers of the rows that stay, from 1, and 0 where a
    turn is inserted; ``roles`` their new roles, null where they keep theirs."""

    cost: int
    audit: str
    rows: list[int]
    roles: list[str | None]


class Table:
    """Cheapest alignments of the rows from ``i`` on to the last ``r`` symbols
    of the grammar string, within a band.

    A pattern has one letter a row: its role initial (``o`` for others), in
    capitals if truncated, or ``x`` if it must go. Deleting all ``x`` and
    capitals is the least any repair pays; ``slack`` is what it may pay above.
    With ``g`` other rows left, fewer than ``g`` symbols cost a deletion each
    and more an insertion or a truncated row, so ``r - g`` is bounded both ways.
    """

    def __init__(self, pattern: str, slack: int):
        self.pattern, self.n = pattern, len(pattern)
        self.below, above = slack // DELETE, slack // (CUT - DELETE)
        self.width = self.below + above + 1
        self.sound = np.concatenate([np.cumsum([c.islower() and c != "x" for c in pattern[::-1]])[::-1], [0]]).astype(int)
        self.climb = INSERT * np.arange(self.width)
        self.step = isqrt(self.n) + 1
        self.marks: dict[int, np.ndarray] = {}
        self.block: dict[int, np.ndarray] = {}

    def low(self, i: int) -> int:
        """The number of symbols at the start of row ``i``'s band."""
        return int(self.sound[i]) - self.below

    def last(self) -> np.ndarray:
        r = np.arange(self.width) + self.low(self.n)
        return np.where(r >= 0, INSERT * r, FAR)

    def before(self, i: int, after: np.ndarray) -> np.ndarray:
        """Row ``i`` from row ``i + 1``: delete, take, then insert."""
        low, letter = self.low(i), self.pattern[i]
        # Sound rows raise the band by one symbol.
        raised = low - self.low(i + 1)
        wide = np.concatenate([[FAR], after, [FAR]])
        row = wide[1 + raised : 1 + raised + self.width] + DELETE
        if letter != "x":
            odd = (np.arange(self.width) + low) % 2
            fits = odd if letter in "aA" else 1 - odd if letter in "uU" else 0
            taken = wide[raised : raised + self.width] + (REROLE - fits) + (CUT if letter.isupper() else 0)
            taken[: max(0, 1 - low)] = FAR
            row = np.minimum(row, taken)
        return np.minimum(np.minimum.accumulate(row - self.climb) + self.climb, FAR)

    def rows_down(self) -> Iterator[tuple[int, np.ndarray]]:
        """All rows from the last, of which every ``step``-th is remembered."""
        row = self.last()
        for i in range(self.n, -1, -1):
            if i < self.n:
                row = self.before(i, row)
            if i % self.step == 0 or i == self.n:
                self.marks[i] = row
            yield i, row

    def cost(self, i: int, r: int) -> int:
        at = r - self.low(i)
        return int(self.block[i][at]) if 0 <= at < self.width and r >= 0 else int(FAR)

    def audits(self, starts: list[tuple[int, int, str]]) -> list[str]:
        """The least audits of the cheapest alignments from cells on, after what
        is given. Rows between the remembered ones are computed again, for all
        cells at once."""
        done = [(i, r, [given]) for i, r, given in starts]
        for first in range(0, self.n + 1, self.step):
            top = min(self.n, first + self.step)
            self.block = {top: self.marks[top]}
            for k in range(top - 1, first - 1, -1):
                self.block[k] = self.before(k, self.block[k + 1])
            done = [self.walked(i, r, out, top) for i, r, out in done]
        return ["".join(out) for _, _, out in done]

    def walked(self, i: int, r: int, out: list[str], top: int) -> tuple[int, int, list[str]]:
        while i < top or (top == self.n and r):
            now = self.cost(i, r)
            if i < top and self.cost(i + 1, r) + DELETE == now:
                out.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + INSERT == now:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.pattern[i].lower() == ("a" if r % 2 else "u") else "R")
                i, r = i + 1, r - 1
        return i, r, out


def within(pattern: str, slack: int) -> tuple[int, str | None]:
    """The least cost in the band and, if the band holds all alignments of that
    cost, the least audit of it."""
    n = len(pattern)
    table = Table(pattern, slack)
    best, starts = DELETE * n, {}

    def offer(i: int, r: np.ndarray, costs: np.ndarray) -> None:
        """Keep the cheapest starts; of equal ones to as many symbols the latest,
        which deletes most before it and so has the lesser audit."""
        nonlocal best, starts
        least = int(costs.min(initial=FAR))
        if least > best:
            return
        if least < best:
            best, starts = least, {}
        for symbols in r[costs == least].tolist():
            starts.setdefault((symbols, i > 0), i)

    for i, row in table.rows_down():
        r = np.arange(table.width) + table.low(i)
        pairs = (r >= 2) & (r % 2 == 0) & (row < FAR)
        if i == 0:
            offer(0, r[pairs], row[pairs])
        # An opening system turn is kept at row i - 1, and all before it go.
        if i and pattern[i - 1] in "sS":
            offer(i, r[pairs], row[pairs] + DELETE * (i - 1) + (CUT if pattern[i - 1] == "S" else 0))
    if best > least_cost(pattern) + slack:
        return best, None
    audits = ["D" * n] if best == DELETE * n else []
    audits += table.audits([(i, r, "D" * (i - 1) + "K" if i else "") for (r, _), i in starts.items()])
    return best, min(audits)


def least_cost(pattern: str) -> int:
    """What any repair pays: all rows but sound ones are deleted, or cost more."""
    return DELETE * sum(not c.islower() or c == "x" for c in pattern)


def repair(pattern: str) -> Repair:
    """The cheapest repair of a pattern, of equal ones that with the least audit."""
    least = least_cost(pattern)
    slack, audit = 6, None
    while audit is None:
        slack = min(slack, DELETE * len(pattern) - least)
        cost, audit = within(pattern, slack)
        slack = min(4 * slack + 6, cost - least)
    size = len(audit) - audit.count("D")
    target = "s" * (size % 2) + "ua" * (size // 2)
    rows, roles, row = [], [], 0
    for edit in audit:
        row += edit != "I"
        if edit != "D":
            rows.append(0 if edit == "I" else row)
            roles.append(None if edit == "K" else NAMES[target[len(rows) - 1]])
    return Repair(cost, audit, rows, roles)


@lru_cache(maxsize=MOST_REMEMBERED)
def remembered(pattern: str) -> Repair:
    return repair(pattern)


REPAIR = (
    StructType()
    .add("cost", LongType())
    .add("audit", StringType())
    .add("rows", ArrayType(IntegerType()))
    .add("roles", ArrayType(StringType()))
)


@F.pandas_udf(REPAIR)
def repairs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for patterns in batches:
        done = [(remembered if len(p) <= SHORT else repair)(p) for p in patterns]
        yield pd.DataFrame(done, columns=list(Repair._fields))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: rows after the damage that the crc32
    of ``conv_id:turn`` deals them; a null is one space in it, as are null roles
    and texts. Dropped rows stay as rows that are ``gone``."""
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key) % 20).cast("int").alias("d"),
    )
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.col("d") == 0, F.when(F.col("d") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("gone"),
    )


def audited(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """One row per conversation: ``turns`` as given and in order, their faults
    counted, the ``cost`` and ``audit`` of the cheapest repair, and
    ``repaired``, an array of ``role, text``.

    Turns are ordered by turn (nulls first), ties by role and text; null roles
    and texts are one space. A row's first fault counts: blank (no character
    but separators), duplicate (role and text seen earlier), truncated (the
    last such character is no ``.``, ``!`` or ``?``). Rows that are ``gone``
    count for nothing but their conversation's existence. Rows without a
    conv_id are one conversation. No rows give no conversations. A conversation
    is one value, as its repair is, so its turns meet in one task.
    """
    space = F.lit(" ")
    flat = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).alias("gone"),
    ).repartition("conv_id")
    # One exchange: the window's rows and the group's already meet by conv_id.
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    last = F.right(F.rtrim("text", F.lit(SEPARATORS)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.col("seen") > 1, "duplicate").when(~last.isin(*ENDS), "truncated")
    turn = F.struct("turn", "role", "text", "seen", F.coalesce(fault, F.lit("")).alias("fault"))
    conversations = (
        flat.withColumn("seen", F.row_number().over(same))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.when(~F.col("gone"), turn))).alias("turns"))
        .withColumn("initials", F.transform("turns", lambda t: F.substring(t.role, 1, 1)))
    )
    def letter(t: Column, i: Column) -> Column:
        initial = F.get("initials", i)
        plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
        return (
            F.when(t.fault.isin("blank", "duplicate"), "x").when(t.fault == "truncated", F.upper(plain)).otherwise(plain)
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("turns", lambda t: t.fault == kind)).cast("long").alias(kind)

    numbers = F.array_compact(F.transform("turns", lambda t: t.turn.cast("decimal(20,0)")))
    span = F.array_max("numbers") - F.array_min("numbers") + 1 - F.size(F.array_distinct("numbers"))
    illegal = F.filter(
        "initials", lambda x, i: (i > 0) & ~F.concat(F.get("initials", i - 1), x).isin("su", "ua", "au")
    )
    described = conversations.withColumn("numbers", numbers).select(
        "conv_id", "turns",
        F.when(F.size("numbers") > 0, F.least(span, F.lit((1 << 63) - 1))).otherwise(0).cast("long").alias("gaps"),
        *[count(k) for k in ("blank", "duplicate", "truncated")],
        F.size(illegal).cast("long").alias("illegal"),
        F.array_join(F.transform("turns", letter), "").alias("pattern"),
    )
    made = described.withColumn("r", repairs("pattern"))
    repaired = F.zip_with(
        "r.rows", "r.roles",
        lambda i, role: F.struct(
            F.coalesce(role, F.get("turns", i - 1).role).alias("role"),
            F.when(i > 0, F.get("turns", i - 1).text).otherwise("").alias("text"),
        ),
    )
    return made.select(
        "conv_id", "turns", "gaps", "blank", "duplicate", "truncated", "illegal",
        "r.cost", "r.audit", repaired.alias("repaired"),
    )


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    return audited(rows, F.col("gone")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(said, 256).alias("repaired_sha256"),
    )


ORACLE = r"""
WITH RECURSIVE c AS (SELECT row_number() OVER () AS k, conv_id, turn, coalesce(role, ' ') AS role,
  coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
crc AS (SELECT k, (xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)),
      lambda g, i: xor(g >> 1, CASE WHEN g & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)) % 20 AS d FROM c),
m AS (SELECT c.k, conv_id, turn, d, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c JOIN crc ON crc.k = c.k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k, copy) AS seen,
  rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS trimmed FROM m),
f AS (SELECT *, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS px,
  count(*) OVER (PARTITION BY conv_id) AS n,
  CASE WHEN trimmed = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(trimmed, '[.!?]$') THEN 'truncated' ELSE '' END AS fault FROM o),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, any_value(n) AS n,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
move(st, y, nx) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
ins AS (SELECT * FROM (VALUES ('0', 0, '0'), ('0', 1, 'u'), ('0', 2, 'a'), ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'),
  ('u', 0, 'u'), ('u', 1, 'a'), ('u', 2, 'u'), ('a', 0, 'a'), ('a', 1, 'u'), ('a', 2, 'a')) AS t(st, k, nx)),
best(conv_id, i, st, cost, audit) AS (
  SELECT conv_id, n, st, cost, audit FROM sums,
    (VALUES ('0', 0, ''), ('a', 0, ''), ('u', 5, 'I'), ('s', 10, 'II')) AS e(st, cost, audit)
  UNION ALL
  SELECT conv_id, i, st, b.cost, b.audit FROM (
    SELECT b.conv_id, b.i - 1 AS i, ins.st, min({'cost': b.cost + 5 * ins.k + e.cost, 'audit': repeat('I', ins.k) || e.op || b.audit}) AS b
    FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i,
      LATERAL (SELECT b.st AS from_st, 'D' AS op, 2 AS cost
        UNION ALL SELECT st, 'K', CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END FROM move
          WHERE nx = b.st AND y = f.x AND f.fault NOT IN ('blank', 'duplicate')
        UNION ALL SELECT st, 'R', 1 + CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END FROM move
          WHERE nx = b.st AND y IN ('u', 'a') AND f.fault NOT IN ('blank', 'duplicate')) e
      JOIN ins ON ins.nx = e.from_st
    GROUP BY b.conv_id, b.i, ins.st)),
a AS (SELECT s.*, coalesce(b.b.cost, 0) AS cost, coalesce(b.b.audit, '') AS audit FROM (
    SELECT d.conv_id, coalesce(s.n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
      coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
    FROM (SELECT DISTINCT conv_id FROM c) d LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM d.conv_id) s
  LEFT JOIN (SELECT conv_id, min({'cost': cost, 'audit': audit}) AS b FROM best WHERE i = 0 AND st = '0' GROUP BY conv_id) b
    ON b.conv_id IS NOT DISTINCT FROM s.conv_id),
e AS (SELECT conv_id, length(replace(audit, 'D', '')) AS size, pos, audit[pos] AS op,
    length(replace(audit[:pos], 'I', '')) AS i, length(replace(audit[:pos], 'D', '')) AS r
  FROM a, LATERAL (SELECT unnest(generate_series(1, length(audit))) AS pos)),
p AS (SELECT e.conv_id, string_agg(CASE op WHEN 'K' THEN f.role WHEN 'D' THEN NULL
      ELSE CASE WHEN (e.size - e.r) % 2 = 0 THEN 'assistant' ELSE 'user' END END
    || ':' || CASE WHEN op = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY pos) AS said
  FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE op <> 'D' GROUP BY e.conv_id)
SELECT a.conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate,
  CAST(truncated AS BIGINT) AS truncated, CAST(illegal AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
  sha256(coalesce(said, '')) AS repaired_sha256
FROM a LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM a.conv_id"""
