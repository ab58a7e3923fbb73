"""Embeddings, chat logs and archives against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import chat, embeddings, fixity
from tagloom.llm.components import connected_components


def test_components_with_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert dict(rows) == {i: 0 for i in range(40)} | {i: 100 for i in range(100, 161)}


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * (0.1 if i % 2 else 0.6)).tolist()) for i in range(150)]
    rows += [(150, rows[3][1]), (151, [x * 1e200 for x in rows[3][1]]), (152, None), (153, []), (154, [0.0] * 16)]
    rows += [(155, [1.0, None] + [0.0] * 14), (156, [float("nan")] * 16), (157, [float("inf")] + [1.0] * 15)]
    return rows + [(158, [1.0, 2.0]), (159, [2.0, 4.1]), (None, rows[0][1])]


@pytest.mark.parametrize("tile", [1024, 16])
def test_embeddings_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE_LEAST", tile)
    monkeypatch.setattr(embeddings, "TILE_MOST", tile)
    rows = vectors()
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, row string")
    got = embeddings.near_copies(table).collect()
    assert len(got) == len(rows)

    def usable(v):
        return bool(v) and None not in v and np.isfinite(v).all() and any(v)

    units = []
    for _, v in rows:
        x = np.array(v) / np.abs(v).max() if usable(v) else None
        units.append(x / np.linalg.norm(x) if x is not None else None)
    links = [
        sum(
            1
            for j, b in enumerate(units)
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9
        )
        for i, a in enumerate(units)
    ]
    want = {i: n for (i, _), n in zip(rows, links, strict=True)}
    assert {r["vec_id"]: r["n_links"] for r in got} == want
    by_id = {r["vec_id"]: r for r in got}
    assert by_id[150]["component_id"] == by_id[3]["component_id"] == by_id[151]["component_id"] <= 3
    assert by_id[159]["component_id"] == 158 and not by_id[159]["kept"]
    assert all(by_id[i]["kept"] and by_id[i]["n_links"] == 0 for i in range(152, 158))


def test_embeddings_of_an_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_copies(table).count() == 0


NASTY = ["", "<|im_end|>", "<\\|x", "<\\\\|im_start|>", "a<|im_end|>\n<|im_start|>user\nb", "<<||>", "\n\n", "plain", "<"]


def test_escape_is_reversible(values):
    once = values(chat.escaped(F.col("v")), NASTY, "string")
    assert not any("<|" in x for x in once) and len(set(once)) == len(NASTY)
    assert values(chat.unescaped(chat.escaped(F.col("v"))), NASTY, "string") == NASTY


def brute_fold(events):
    order = {"open": 1, "edit": 2, "regenerate": 3, "delta": 4}
    held = {}
    for _, kind, message, role, text in sorted(events, key=lambda e: (e[0], order[e[1]], e[4] or "")):
        if kind == "open":
            held[message] = [role or "", text or ""]
            continue
        if message not in held:
            continue
        if kind == "delta":
            held[message][1] += text or ""
        elif kind == "edit":
            held[message][1] = text or ""
        else:
            held[message][1] = ""
            held = {m: v for m, v in held.items() if m <= message}
    return held


def test_fold_equals_replay(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for conv in range(300):
        events, seq, opened = [], 0, 0
        for _ in range(rng.randint(1, 25)):
            seq += 1
            seq -= rng.random() < 0.1 and bool(events)
            if opened == 0 or rng.random() < 0.3:
                # Now and then a message is opened again, be it there or gone.
                at = rng.randrange(opened) if opened and rng.random() < 0.2 else opened
                events.append((seq, "open", at, rng.choice(["user", "assistant"]), rng.choice([None, "", "hi "])))
                opened = max(opened, at + 1)
            else:
                kind = rng.choice(["delta", "delta", "delta", "edit", "regenerate"])
                events.append((seq, kind, rng.randrange(opened), None, rng.choice(NASTY)))
        want[conv] = brute_fold(events)
        rows += [(conv, *e) for e in events]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string")
    got = {}
    for r in chat.folded(log).collect():
        got.setdefault(r["conv_id"], {})[r["message"]] = [r["role"], r["text"]]
    assert got == {conv: alive for conv, alive in want.items() if alive}
    assert sum(len(e) for e in want.values()) > 300


def test_fold_keeps_messages_after_a_regeneration_of_one_that_is_gone(spark):
    kinds = [("open", 0), ("open", 1), ("regenerate", 0), ("open", 2), ("regenerate", 1)]
    rows = [(None, i, k, m, "user", "t") for i, (k, m) in enumerate(kinds)]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string")
    assert [tuple(r) for r in chat.folded(log).orderBy("message").collect()] == [(None, 0, "user", ""), (None, 2, "user", "t")]
    assert chat.folded(log.limit(0)).count() == 0


def test_a_long_conversation_and_rows_without_one(spark):
    rows = [(None, i, "assistant" if i % 2 else "user", "w" * (i % 5)) for i in range(3000)]
    rows += [(4, None, None, None), (4, None, None, "x" * 400_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.rendered(chat.folded(chat.as_events(table))).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in done.select("conv_id", "turns").collect()}
    assert got[None] == [r[2:] for r in rows[:3000]]
    assert got[4] == [("", ""), ("", "x" * 400_000)]
    assert chat.rendered(chat.folded(chat.as_events(table.limit(0)))).count() == 0


def test_rendering_reads_back(spark):
    rows = [(1, i, role, text) for i, (role, text) in enumerate((r, t) for r in ("user", "assistant", "a\nb<|", None) for t in [*NASTY, None])]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, None, "user", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.rendered(chat.folded(chat.as_events(table))).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r["conv_id"]: r for r in done.collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert [tuple(t) for t in got[2]["turns"]] == [("user", "y"), ("assistant", "x"), ("assistant", "x")]
    assert "".join(s["text"] for s in got[1]["segments"]) == got[1]["formatted"]
    assert sum(s["loss"] for s in got[1]["segments"]) == len(NASTY) + 1


def test_audit_locates_damage(spark):
    rng = random.Random(6)
    rows, at = [], 0
    for i in range(400):
        record = "r" * rng.randint(200, 4000) + str(i)
        rows.append((i % 2, at, record))
        at += len(record)
    bad = dict(((r[0], r[1]), r[2]) for r in rows)
    first, second, third = rows[7], rows[200], rows[399]
    bad[first[:2]] = "x" + first[2][1:]
    del bad[second[:2]]
    bad[third[0], third[1] + 5] = bad.pop(third[:2])
    schema = "archive long, offset long, record string"
    a = spark.createDataFrame([*rows, rows[5]], schema)
    b = spark.createDataFrame([(*k, v) for k, v in bad.items()] + [rows[5], (9, 0, "new archive")], schema)
    got = {(r["archive"], r["offset"]): r["state"] for r in fixity.audit(fixity.leaves(a), fixity.leaves(b)).collect()}
    assert got == {
        first[:2]: "corrupt", second[:2]: "missing", third[:2]: "missing",
        (third[0], third[1] + 5): "extra", (9, 0): "extra",
    }
    assert fixity.audit(fixity.leaves(a), fixity.leaves(a)).count() == 0
    nothing = fixity.leaves(spark.createDataFrame([], schema))
    assert fixity.audit(nothing, nothing).count() == 0
    assert fixity.audit(fixity.leaves(a), nothing).count() == len(rows)


def test_records_of_awkward_pages(spark):
    rows = [(1, "http://a", "<p>é"), (None, None, None), (1, "http://a", "<p>é"), (5000, "u", "")]
    got = fixity.laid_out(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["archive"], r["offset"] > 0) for r in got) == [(-1, False), (0, False), (0, True), (1, False)]
    lengths = {r["record"].encode().split(b"Content-Length: ")[1].split(b"\r\n")[0] for r in got}
    assert lengths == {b"5", b"0"} and hashlib.sha256(got[0]["record"].encode()).hexdigest()
