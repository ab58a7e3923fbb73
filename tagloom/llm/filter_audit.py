"""Filter interaction audit by the Hart-Mas-Colell potential (operator 13).

Filters are the players of a game whose value for a coalition is the number of
documents that its filters remove. Documents are counted by the set of filters
they fail; from these counts come the values of all coalitions, and from them
the potential, coalition by coalition:

    P(empty) = 0,  |S| P(S) = v(S) + sum of P(S without i) over i in S.

The Shapley value of a filter is P(all) - P(all without it). What a filter
removes at a step of an order is the difference of two coalitions. Only
Spark's own expressions are used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.words import native_words
from tagloom.operators.staging import stage

# The coalitions of so many filters and all their orders stay a small table.
MOST_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """The filters A to D: short, repetitive, shouting, with symbols. Each is
    true where the text fails."""
    words = native_words(text)
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def bits(failures: Mapping[str, Column]) -> Column:
    """Failures as a set: bit ``i`` for the ``i``-th filter."""
    total = F.lit(0)
    for at, failed in enumerate(failures.values()):
        total = total + F.when(failed, F.lit(1 << at)).otherwise(0)
    return total


def failed_sets(
    docs: DataFrame, failures: Callable[[Column], Mapping[str, Column]] = text_failures,
    id_column: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """``doc_id, part, failed`` of each row; the last bit is set where a smaller
    doc_id anywhere has the same text.

    A null text is an empty one, a null part is ''. A row without an id has no
    smaller id and is none; rows that share an id and a text do not fail by
    each other. Texts are compared by their SHA-256.
    """
    clean = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    by_text = failures(F.col("text"))
    rows = stage(clean.select(
        "doc_id", "part", bits(by_text).alias("failed"), F.unhex(F.sha2("text", 256)).alias("same"),
    ))
    # A text that fills a third of the table is one row here, and a skewed key
    # of the join with one row on the other side, which is split at run time.
    first = (
        rows.groupBy("same")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select(F.substring("same", 1, 32).alias("same"), "first")
    )
    later = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(by_text))).otherwise(0)
    return rows.join(first, "same", "left").select("doc_id", "part", (F.col("failed") + later).alias("failed"))


def counted(rows: DataFrame, filters: int, marks: Mapping[str, Column]) -> DataFrame:
    """One row a part: ``n`` and the ``marks`` as arrays of counts, indexed by
    the set of filters that rows fail."""
    if not 1 <= filters <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, not {filters}")
    sums = {"n": F.count("*"), **{k: F.sum(F.coalesce(v, F.lit(False)).cast("long")) for k, v in marks.items()}}
    by_set = rows.groupBy("part", "failed").agg(*[v.alias(k) for k, v in sums.items()])
    # At most 2^filters rows a part meet here.
    maps = by_set.groupBy("part").agg(
        *[F.map_from_entries(F.collect_list(F.struct("failed", k))).alias(k) for k in sums]
    )
    sets = F.sequence(F.lit(0), F.lit((1 << filters) - 1))

    def listed(k: str) -> Column:
        return F.transform(sets, lambda s: F.coalesce(F.try_element_at(k, s), F.lit(0).cast("long"))).alias(k)

    return maps.select("part", *[listed(k) for k in sums])


def values(counts: Column, filters: int) -> Column:
    """What each coalition removes: the rows that fail any of its filters."""
    sets = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    return F.transform(
        sets,
        lambda s: F.aggregate(
            F.transform(sets, lambda m: F.when(m.bitwiseAND(s) != 0, F.get(counts, m)).otherwise(0)),
            F.lit(0).cast("long"),
            lambda a, b: a + b,
        ),
    )


def potentials(value: Column, filters: int) -> Column:
    """The potentials of all coalitions, times the least common multiple of the
    numbers up to ``filters``, so that they are whole numbers. Coalitions come
    after all their parts, so one pass over them is the recursion."""
    unit = lcm(*range(1, filters + 1))

    def of(done: Column, s: Column) -> Column:
        without = [
            F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(done, s.bitwiseXOR(F.lit(1 << i)))).otherwise(0)
            for i in range(filters)
        ]
        return F.get(value, s) * unit + sum(without[1:], without[0])

    empty = F.array(F.lit(0).cast("long"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit((1 << filters) - 1)), empty,
        lambda done, s: F.array_append(done, (of(done, s) / F.bit_count(s)).cast("long")),
    )


def steps(names: str) -> Column:
    """All orders of the filters, step by step: the order, the step, the bit of
    its filter and the set of filters before it. A constant of the plan."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(names[k] for k in order), step, i, before))
            before |= 1 << i
    return F.array(*[
        F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(i).alias("i"), F.lit(b).alias("before"))
        for o, k, i, b in rows
    ])


def audited(rows: DataFrame, names: str, marks: Mapping[str, Column]) -> DataFrame:
    """For each part, order of the filters and step, what the step's filter does.

    ``rows`` have ``part`` and ``failed``, the set of filters they fail as bits
    in the order of ``names``. ``kept`` and ``removed`` are after and by this
    step; ``redundant`` rows fail its filter but went before; ``unique_fails``
    fail no other filter; ``<mark>_lost`` are removed rows with the mark;
    ``shapley`` is what its filter removes, summed over all orders. Counts are
    whole numbers. No rows give no parts.
    """
    filters = len(names)
    everyone, unit = (1 << filters) - 1, lcm(*range(1, filters + 1))
    table = counted(rows, filters, marks)
    table = table.select(
        "part", F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"),
        *[values(F.col(k), filters).alias(k) for k in ("n", *marks)],
    ).withColumn("potential", potentials(F.col("n"), filters))
    steps_of = table.select("*", F.explode(steps(names)).alias("s")).select("*", "s.*")
    bit = F.expr("shiftleft(1, i)")
    before, after = F.col("before"), F.col("before").bitwiseOR(bit)

    def gain(k: str) -> Column:
        return F.get(k, after) - F.get(k, before)

    worth = F.get("potential", F.lit(everyone)) - F.get("potential", F.lit(everyone).bitwiseXOR(bit))
    return steps_of.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("n", after)).alias("kept"),
        gain("n").alias("removed"),
        (F.get("n", bit) - gain("n")).alias("redundant"),
        (F.get("n", F.lit(everyone)) - F.get("n", F.lit(everyone).bitwiseXOR(bit))).alias("unique_fails"),
        *[gain(k).alias(f"{k}_lost") for k in marks],
        (worth * (factorial(filters) // unit)).alias("shapley"),
    )


def with_labels(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` (quality 1) and ``toxic`` of their doc_id; a doc_id
    labelled more than once has what any of its rows says, without labels or
    without an id it has neither."""
    told = labels.groupBy(F.col(id_column).alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    told = told.filter("good or toxic").select(F.col("doc_id").bitwiseXOR(F.lit(0)).alias("doc_id"), "good", "toxic")
    return rows.join(told, "doc_id", "left")


def op13_filter_potential(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = with_labels(failed_sets(docs), labels)
    return audited(rows, "ABCDE", {"good": F.col("good"), "toxic": F.col("toxic")})


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w FROM d),
f AS (SELECT doc_id, part, {
    'A': len(w) < 200,
    'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (SELECT list_sort(list(k)) FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k)
      WHERE (k = 'A' AND f.f.A) OR (k = 'B' AND f.f.B) OR (k = 'C' AND f.f.C) OR (k = 'D' AND f.f.D)
        OR (k = 'E' AND f.f.E)) AS fails, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, coalesce(fails, []) AS fails, count(*) AS n, count(*) FILTER (good) AS good,
  count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE length(replace(replace(replace(replace(replace('ABCDE', a.x, ''), b.x, ''), c.x, ''), d.x, ''), e.x, '')) = 0),
s AS (SELECT o, step, substr(o, step, 1) AS k, list_filter(string_split(o, ''), lambda x, i: i < step) AS before
  FROM o, generate_series(1, 5) AS g(step)),
r AS (SELECT c.part, s.o, s.step, s.k,
  sum(c.n) FILTER (NOT list_contains(c.fails, s.k) AND NOT list_has_any(c.fails, s.before)) AS kept,
  sum(c.n) FILTER (list_contains(c.fails, s.k) AND NOT list_has_any(c.fails, s.before)) AS removed,
  sum(c.n) FILTER (list_contains(c.fails, s.k) AND list_has_any(c.fails, s.before)) AS redundant,
  sum(c.n) FILTER (c.fails = [s.k]) AS unique_fails,
  sum(c.good) FILTER (list_contains(c.fails, s.k) AND NOT list_has_any(c.fails, s.before)) AS good_lost,
  sum(c.toxic) FILTER (list_contains(c.fails, s.k) AND NOT list_has_any(c.fails, s.before)) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM r"""
