"""Quadratic discriminant, turn repair and filter audit against plain Python."""

import functools
import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import filter_audit, quadratic, turn_repair


def brute_repair(pattern):
    """A search over all edits from the end; longer audits come from putting an
    edit before the best of what follows, so the order of ties is kept."""
    follow = {"0": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(pattern) and state in "0a" else []

        def add(cost, edit, rest):
            if rest:
                found.append((cost + rest[0], edit + rest[1]))

        if inserted < 4:
            for y in follow[state].replace("s", ""):
                add(5, "I", best(i, y, inserted + 1))
        if i < len(pattern):
            add(2, "D", best(i + 1, state, 0))
            cut = 5 * pattern[i].isupper()
            for y in follow[state] if pattern[i] != "x" else "":
                if pattern[i].lower() == y:
                    add(cut, "K", best(i + 1, y, 0))
                if y != "s":
                    add(1 + cut, "R", best(i + 1, y, 0))
        return min(found, default=None)

    return best(0, "0", 0)


def test_repairs_equal_a_search_over_all_edits():
    rng = random.Random(5)
    patterns = ["", "x", "s", "S", "su", "sua", "SUA", "aaaa", "uuuu", "ssss", "oooo", "xxxx"]
    patterns += ["".join(rng.choice("suaosuauauaSUAOx") for _ in range(rng.randrange(12))) for _ in range(2500)]
    long = "su" + "au" * 70
    patterns += [
        "".join(c if rng.random() < 0.75 else rng.choice("uaxUAso") for c in long[: rng.randrange(140)])
        for _ in range(60)
    ]
    for pattern in patterns:
        done = turn_repair.repair(pattern)
        assert (done.cost, done.audit) == brute_repair(pattern), pattern
        assert len(done.rows) == len(done.roles) == len(done.audit) - done.audit.count("D")


def test_a_long_conversation_is_cut_into_blocks():
    done = turn_repair.repair("u" + "ua" * 2000 + "xU")
    assert (done.cost, done.audit) == (6, "D" + "K" * 4000 + "DD")


def conversation_rows():
    rng = random.Random(2)
    rows = []
    for conv in [*range(160), None]:
        turn = 0
        for _ in range(rng.randrange(1, 9)):
            turn += rng.choice([1, 1, 1, 2, 0])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", "tool", None])
            text = rng.choice(["Yes.", "No!", "Why?  ", "so it goes", " \t\x0b", "", None, "A. b\n", "é…"])
            rows.append((conv, rng.choice([turn] * 9 + [None]), role, text))
    return rows


def plain_audits(rows):
    kept = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        d = zlib.crc32(name.encode()) % 20
        role = "user" if d == 4 else role
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        kept.setdefault(conv, []).extend([(turn is not None, turn or 0, role, text)] * (d != 0) * (2 if d == 3 else 1))
    out = {}
    for conv, turns in kept.items():
        turns.sort()
        seen, pattern, faults = set(), "", []
        for _, _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            pattern += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        numbers = {t for known, t, _, _ in turns if known}
        cost, audit = brute_repair(pattern)
        target = (["system"] if (len(audit) - audit.count("D")) % 2 else []) + ["user", "assistant"] * len(audit)
        said, at = [], 0
        for edit in audit:
            row = turns[at] if edit != "I" else None
            at += edit != "I"
            if edit != "D":
                role = row[2] if edit == "K" else target[len(said)]
                said.append(f"{role}:{row[3] if row else ''}")
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(turns, turns[1:], strict=False)]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def query_over(spark, tmp_path, name, tables):
    for table, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
    from tagloom.llm import catalog

    return catalog.QUERIES[name](spark, str(tmp_path))


def in_duckdb(sql, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    found = con.sql(sql)
    names = found.columns
    return sorted(
        (tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=lambda r: tuple(map(str, r))
    )


def sorted_rows(frame):
    return sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=lambda r: tuple(map(str, r)))


def test_turn_repair_of_odd_rows(spark, tmp_path):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = table.withColumns({"gone": F.lit(1), "pattern": F.lit("x"), "turns": F.lit(0), "r": F.lit(0)})
    got = query_over(spark, tmp_path, "op12_turn_repair", {"conversations": clashing})
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in got.collect()} == plain_audits(rows)
    assert sorted_rows(got) == in_duckdb(turn_repair.ORACLE, tmp_path, "conversations")


def test_turn_repair_keeps_its_turns_and_says_what_stays(spark):
    rows = [(1, 3, "user", "Thanks."), (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (2, -(1 << 63), "a", None)]
    rows += [(2, (1 << 63) - 1, None, "x" * 500_000)]
    done = turn_repair.audited(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by_id = {r["conv_id"]: r for r in done.collect()}
    assert [t["text"] for t in by_id[1]["turns"]] == ["Be kind.", "Hi?", "Thanks."]
    assert [tuple(t) for t in by_id[1]["repaired"]] == [
        ("system", "Be kind."), ("user", "Hi?"), ("assistant", "Thanks.")
    ]
    assert (by_id[1]["audit"], by_id[1]["gaps"]) == ("KKR", 1)
    assert (by_id[2]["audit"], by_id[2]["gaps"]) == ("DD", (1 << 63) - 1)
    assert turn_repair.audited(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_one_exchange_repairs_turns(spark, sf_dir):
    from io import StringIO
    from contextlib import redirect_stdout

    out = StringIO()
    with redirect_stdout(out):
        turn_repair.op12_turn_repair(spark, sf_dir).explain()
    assert out.getvalue().count("Exchange hashpartitioning") == 1


def document_rows():
    rng = random.Random(9)
    words = ["alpha", "beta", "Gamma", "delta", "EPSILON", "zeta", "x#", "eta|", "theta"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 250]))), rng.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(i, " ".join(f"w{k}" for k in range(220)), "en") for i in range(60, 64)]
    rows += [(i, rows[i % 7][1], "fr") for i in range(64, 90)]
    rows += [(3, rows[3][1], "en"), (3, "another text", "en"), (None, rows[3][1], "en"), (None, None, "fr"), (95, None, None)]
    return rows + [(96, "A" * 400_000, "de"), (97, "é " * 300, "de"), (98, "\x0b\x0c \t", "de")]


def plain_failures(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = [w.decode() for w in text.encode().split()]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and doc_id > first[text],
        }
        out.append((lang or "", {k for k, v in fails.items() if v}, doc_id))
    return out


def test_filter_audit_equals_all_orders(spark, tmp_path):
    rows = document_rows()
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 99, 2)] + [(4, None, 1), (None, 1, 1), (500, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"part": F.lit("q"), "failed": F.lit(1), "same": F.lit(0), "good": F.lit(True)}
    )
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = query_over(spark, tmp_path, "op13_filter_potential", {"documents": docs, "labels": told})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    want, shapley = {}, {}
    failures = plain_failures(rows)
    for part in {p for p, _, _ in failures}:
        mine = [(f, i) for p, f, i in failures if p == part]
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, k in enumerate(order, 1):
                removed = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                want[part, "".join(order), step] = [
                    len(left), len(removed), sum(k in f for f, _ in gone), sum(f == {k} for f, _ in mine),
                    sum(i in good for _, i in removed), sum(i in toxic for _, i in removed),
                ]
                gone = gone + removed
                shapley[part, k] = shapley.get((part, k), 0) + len(removed)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    found = got.collect()
    assert len(found) == len(want)
    for r in found:
        at = r["part"], r["filter_order"], r["step"]
        assert [r[c] for c in names] == want[at], at
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]
    assert sorted_rows(got) == in_duckdb(filter_audit.ORACLE, tmp_path, "documents", "labels")


def test_filter_audit_of_nothing_and_of_other_filters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    rows = filter_audit.failed_sets(empty).withColumn("good", F.lit(True))
    assert filter_audit.audited(rows, "ABCDE", {"good": F.col("good")}).count() == 0
    two = spark.createDataFrame([("p", 1)] * 3 + [("p", 2)] * 2 + [("p", 3), ("p", 0)], "part string, failed int")
    found = {(r["filter_order"], r["step"]): r for r in filter_audit.audited(two, "XY", {}).collect()}
    assert [found["XY", 1]["removed"], found["XY", 2]["removed"]] == [4, 2]
    assert [found["XY", 1]["shapley"], found["XY", 2]["shapley"]] == [7, 5]
    with pytest.raises(ValueError):
        filter_audit.audited(two, "ABCDEFG", {})


def plain_scores(x, y, weight, to_common, to_identity, at):
    """Log-odds by the textbook formula, with matrix inverses."""
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.maximum(np.average((x - mean) ** 2, axis=0, weights=weight), 0))
    scale[scale <= 1e-9] = 1
    z, t = (x - mean) / scale, (at - mean) / scale
    covs, means, shares = [], [], []
    for k in (0, 1):
        w = weight[y == k]
        means.append(np.average(z[y == k], axis=0, weights=w))
        d = z[y == k] - means[-1]
        covs.append((d * w[:, None]).T @ d / w.sum())
        shares.append(w.sum() / weight.sum())
    common = shares[0] * covs[0] + shares[1] * covs[1]
    logs = []
    for k in (0, 1):
        cov = (1 - to_common) * covs[k] + to_common * common
        cov = (1 - to_identity) * cov + to_identity * np.eye(len(mean))
        d = t - means[k]
        logs.append(np.log(shares[k]) - np.linalg.slogdet(cov)[1] / 2 - np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) / 2)
    return np.clip(logs[1] - logs[0], -30, 30)


def test_moments_and_scores_equal_the_textbook(spark):
    rng = np.random.default_rng(4)
    n = 400
    y = (rng.random(n) < 0.7).astype(int)
    x = rng.normal(size=(n, quadratic.SIZE)) * (1 + y[:, None]) + 0.7 * y[:, None]
    x[:, 3] = 2.5
    weight = rng.integers(1, 4, n)
    rows = [(int(a), int(i % 5), int(w), list(map(float, b))) for i, (a, b, w) in enumerate(zip(y, x, weight, strict=True))]
    table = spark.createDataFrame(rows, "label int, fold int, weight long, x array<double>").repartition(7)
    found = quadratic.moments(table)
    whole = [sum((found[k, f] for f in range(5)), quadratic.NOTHING) for k in (0, 1)]
    model = quadratic.fitted(whole, 0.2, 0.01)
    np.testing.assert_allclose(model.log_odds(x), plain_scores(x, y, weight, 0.2, 0.01, x), rtol=1e-6, atol=1e-6)
    # The losses that choose the shrinkage are those of the folds left out.
    choices = [(0.0, 0.01), (1.0, 0.2)]
    models = [
        [quadratic.fitted([whole[k] + quadratic.Moments(0, 0, 0) - found[k, f] for k in (0, 1)], *c) for f in range(5)]
        for c in choices
    ]
    fold = np.arange(n) % 5
    want = []
    for c in choices:
        total = 0.0
        for f in range(5):
            odds = plain_scores(x[fold != f], y[fold != f], weight[fold != f], *c, x[fold == f])
            total += (weight[fold == f] * np.logaddexp(0, -odds * np.where(y[fold == f] == 1, 1, -1))).sum()
        want.append(total)
    np.testing.assert_allclose(quadratic.losses(table, models), want, rtol=1e-6)


def test_statistics_of_odd_texts():
    for text in (None, "", " \n\x0b", "a", "é", "\ud800", "x " * 300_000, "A" * 300_000, "\n\n..!?"):
        found = quadratic.statistics(text)
        assert len(found) == quadratic.SIZE and np.isfinite(found).all()
    assert quadratic.statistics(None) == quadratic.statistics("")
    one = dict(zip(quadratic.STATISTICS, quadratic.statistics("Ab ab, #1\nAb ab, #1"), strict=True))
    assert one["words"] == pytest.approx(np.log(7))
    assert one["repeated_lines"] == pytest.approx(np.arcsin(np.sqrt(1 / 2)))
    assert one["capitals"] == pytest.approx(np.arcsin(np.sqrt(2 / 8)))
    assert one["symbols"] == pytest.approx(np.arcsin(np.sqrt(2 / 19)))


def test_quality_scores_of_odd_tables(spark):
    docs = spark.createDataFrame(
        [(i, ("good words here. " * (i % 9 + 3)) if i % 3 else "BAD!! $$$ " * (i % 7 + 2), "r") for i in range(90)]
        + [(None, "text", "r"), (200, None, "r"), (201, "", "r"), (5, "BAD!! $$$ " * 4, "r")],
        "doc_id long, text string, label string",
    ).withColumns({"x": F.lit(1), "held_out": F.lit(0), "score": F.lit("s"), "weight": F.lit(2)})
    labels = [(i, int(i % 3 > 0)) for i in range(90)] + [(None, 1), (7, None), (8, 5), (900, 0), (10, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    held = F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    rows = quadratic.scored(docs, told, held).collect()
    assert len(rows) == 94 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["doc_id"] % 3 > 0) for r in rows if r["held_out"] and r["doc_id"] not in (5, 201))
    # Labels of held-out rows change nothing, whatever they say.
    flipped = told.withColumn("quality", F.when(F.col("doc_id") % 4 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quadratic.scored(docs, flipped, held).collect()
    key = lambda r: (str(r["doc_id"]), r["score"])
    for a, b in zip(sorted(rows, key=key), sorted(again, key=key), strict=True):
        assert a["score"] == pytest.approx(b["score"], abs=1e-9)
    one = quadratic.scored(docs, told.filter("quality = 1"), held).collect()
    assert all(r["score"] == pytest.approx(1) and r["predicted"] == 1 for r in one)
    none = quadratic.scored(docs, told.limit(0), held).collect()
    assert all(r["score"] == 0.5 for r in none)
    assert quadratic.scored(docs.limit(0), told, held).count() == 0


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    done = quadratic.op11_quadratic_quality(spark, folder)
    assert done.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = done.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
