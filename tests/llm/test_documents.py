"""Operators on documents against plain Python, on a small awkward table."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import brown, line_dedup, mixing, near_dup, packing, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, kept string, _hash string"


def awkward_rows():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "the of and word Ü tion ing".split() for b in "abcdefgh"]

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)) + "."

    passage = "\n".join(line(9) for _ in range(8))
    base = line(200)
    words = base.split()
    rows = []
    for i in range(60):
        text = "\n".join(line(rng.randint(1, 14)) for _ in range(rng.randint(1, 20)))
        if i % 7 == 0:
            text = f"{line(5)}\n{passage}\n{text}"
        if i % 9 == 4:
            edited = list(words)
            for _ in range(rng.randint(0, 6)):
                edited[rng.randrange(len(edited))] = "edit"
            text = " ".join(edited)
        rows.append((i, text, ("en", "de", None, "xx")[i % 4], (None, "s1", "s2", "a", "b")[i % 5]))
    rows += [(60, None, "en", "a"), (61, "", "en", "a"), (62, " \t\n\x0b", None, None), (63, "one two", "en", "b")]
    rows += [(64, rows[4][1], "en", "a"), (65, "x " * 30_000, "fr", "s1"), (66, "One two", "en", "b")]
    rows += [rows[3], (None, line(40), "en", "a"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), 1, "k", "h") for r in rows]


ROWS = awkward_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, lower=True):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


# ---- near duplicates -----------------------------------------------------


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(docs):
    sets = defaultdict(list)
    for r in ROWS:
        sets[r[0]].append(shingle_set(r[1]))
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            for a in sets[i]:
                for b in sets[j]:
                    if a and b and 100 * len(a & b) >= 85 * len(a | b):
                        x, y = root(i), root(j)
                        up[max(x, y)] = min(x, y)
    got = near_dup.classes(docs).collect()
    assert len(got) == len(ROWS)
    assert any(r["kept"] is False for r in got)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == root(r["doc_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in ids if root(i) == i} | {None}


def test_one_id_with_several_texts_loses_none(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    near_b = b.replace("b39", "other")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, near_b), (9, c), (11, b), (5, b), (20, ""), (20, None), (None, a)]
    # One id that is the first of two sets that nothing links, and a crowd of
    # rows with that id.
    rows += [(1, " ".join(f"p{i}" for i in range(9))), (1, "q r s"), (2, "q r s")] + [(1, f"z{i} z{i} y x w v") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_gone": F.lit(1), "same": F.lit(2)})
    got = near_dup.classes(docs).collect()
    assert len(got) == len(rows)
    # 5 holds a and b, 7 holds near_b and c: all are one by their ids.
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 5, 7, 9, 11)} == {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert all(r["kept"] == (r["doc_id"] in (3, 1, 20, None)) for r in got)
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [r for r in rows if r not in ((5, a), (7, near_b), (9, c), (11, b), (2, "q r s"))]
    assert left == sorted(want, key=str)


def test_every_close_signature_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (200, near_dup.POSITIONS)).astype(np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dup.POSITIONS, near_dup.MOST_DIFFERENT, replace=False)
        row[at] ^= rng.integers(1, 256, len(at)).astype(np.uint8)
    assert ((near_dup.keys_of(a) == near_dup.keys_of(b)).any(axis=1)).all()


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(near_dup, "SET_BLOCK", 3)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:i], "new", *words[i + 1 :]])) for i in range(25)]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


# ---- line dedup -----------------------------------------------------------


def brute_lines(rows):
    """Delete every run of RUN_WORDS words that equals an earlier one."""
    order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    seen, gone = {}, defaultdict(set)
    runs = []
    for place, (_, _, text) in enumerate(order):
        lines, numbers, counts = line_dedup.lines_of(text)
        for i in range(len(lines)):
            total, j = 0, i
            while j < len(lines) and total < line_dedup.RUN_WORDS:
                total += counts[j]
                j += 1
            if total >= line_dedup.RUN_WORDS:
                runs.append((place, i, j, tuple(lines[i:j]), numbers))
    for place, i, _, key, _ in runs:
        seen.setdefault(key, (place, i))
    for place, i, j, key, numbers in runs:
        if seen[key] != (place, i):
            gone[order[place][1:]] |= set(numbers[i:j])
    return gone


def test_line_dedup_equals_brute_force(docs):
    # Ids that name one text each, so that the order does not hang on a hash.
    gone = brute_lines([r for r in ROWS if r[0] is not None])
    got = line_dedup.remove_repeats(docs.filter("doc_id is not null"))
    added = [c for c in got.columns if c not in docs.columns]
    assert set(docs.columns) < set(got.columns)
    texts = {r[0]: r[1] for r in ROWS}
    removed = 0
    for r in got.collect():
        text = texts[r["doc_id"]]
        if text is None:
            assert r["text"] is None
            continue
        want = gone.get((r["doc_id"], text), set())
        assert r[added[1]] == len(want)
        assert {n for s in r[added[2]] for n in range(s["first"], s["last"] + 1)} >= want
        removed += len(want)
        kept, going = [], False
        for n, line in enumerate(text.split("\n")):
            going = n in want if line.strip() else going
            if not going:
                kept.append(line)
        assert r["text"] == "\n".join(kept)
    assert removed > 40


def test_equal_runs_choose_equal_fingerprints():
    rng = random.Random(2)
    shared = [f"shared line {rng.random()} with some words" for _ in range(12)]

    def prints(before, after):
        lines = [*before, *shared, *after]
        raw = [x.encode() for x in lines]
        counts = np.array([len(x.split()) for x in raw])
        from tagloom.llm.words import WordHashes

        return set(line_dedup.winnow(WordHashes().of(raw), counts)[3].tolist())

    a = prints([f"a {rng.random()}" for _ in range(7)], [])
    b = prints([f"b {rng.random()} x y" for _ in range(3)], [f"c {rng.random()}" for _ in range(30)])
    assert a & b


# ---- quality ----------------------------------------------------------------


def brute_quality(text):
    w = [x.decode() for x in words_of(text, lower=False)]
    text = text or ""
    lines = [x for x in text.split("\n") if x.encode().split()]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.assess(docs, ["doc_id", "text"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = brute_quality(r["doc"]["text"])
        assert tuple(r[n] for n in names) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])
        assert 0 <= r["char_divergence"] <= 1 and 0 <= r["word_divergence"] <= 1
    assert quality.accepted(docs).columns == docs.columns


# ---- mixing -------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)


def test_mix_meets_targets(docs):
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words_of(r[1]))
    want = brute_targets(dict(sizes))
    table = mixing.sized(docs, "doc_id", "source", "text")
    first, second = (sorted(mixing.mixed(table).collect(), key=str) for _ in range(2))
    assert first == second
    rows = Counter((r[0], r[3], len(words_of(r[1]))) for r in ROWS)
    taken = Counter()
    for r in first:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"] * rows[(r["doc_id"], r["source"], r["size"])]
    for source, target in want.items():
        # Copies are whole, so one document that outweighs its source sets a limit.
        largest = max(len(words_of(r[1])) for r in ROWS if r[3] == source)
        assert abs(taken[source] - target) <= largest / 2, source
    drawn = mixing.sampled(docs)
    assert drawn.columns == docs.columns
    assert max(Counter(r["doc_id"] for r in drawn.filter("doc_id <> 3").collect()).values()) <= 2


# ---- packing ------------------------------------------------------------------


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.packed(docs, packing.tokenizer_path()).collect()
    want = Counter()
    for r in ROWS:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [packing.END_ID]
        want[r[0], np.array(ids, "<u4").tobytes()] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for places in by_sequence.values():
        at = 0
        for p in sorted(places, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW
    for (doc_id, ids), n in want.items():
        own = by_doc[doc_id, len(ids) // 4]
        for p in own:
            assert bytes(p["ids"]) in {
                i[4 * p["start"] : 4 * (p["start"] + p["length"])] for d, i in want if d == doc_id
            }
        assert sum(p["length"] for p in own) >= n * len(ids) // 4
    assert sum(p["length"] for p in pieces) == sum(n * len(i) // 4 for (_, i), n in want.items())


@pytest.mark.parametrize("text", ["<|endoftext|> a", "Don't STOP", "naïve x y", "a\x1cb", "l'été 12,5%", "́x ́"])
def test_words_encode_as_the_whole_text(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = np.frombuffer(packing.Encoder(packing.tokenizer_path())(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_batch_encodes_as_its_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    parts = ["a", "Z", "É", "×", "ß", "3", "²", "Σ", "'s", "’", ".", ",", "!?", "<|endoftext|>", "<|", " ", "\n", "\x85", "é"]
    rng = random.Random(5)
    texts = [None, "", " "] + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500)]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in encode.batch(pa.array(texts))] == want
    assert [i.tolist() for i in encode.batch(pa.array(texts)[200:])] == want[200:]
    assert encode.batch(pa.array([], pa.string())) == []


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    room, want = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(c, -n) for n, c in enumerate(room) if c >= lengths[i]]
        if fits:
            at = -min(fits)[1]
        else:
            at = len(room)
            room.append(100)
        room[at] -= lengths[i]
        want[i] = 100 - room[at]
    got = packing.best_fit(lengths, 100)
    assert len({n for n, _ in got}) == len(room)
    assert sorted(o + n for (_, o), n in zip(got, lengths, strict=True)) == sorted(want)


# ---- language model -------------------------------------------------------------


def test_language_model(docs, empty, monkeypatch):
    monkeypatch.setattr(brown, "COMMON", 10)
    model, counted = brown.fit(docs)
    got = brown.scored(docs, model, counted).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    training = [r for r in ROWS if not held(r[0])]
    count = Counter(w for r in training for w in words_of(r[1]))
    ends, n = len(training), sum(count.values()) + len(training)
    v = len(count) + 1
    assert len(got) == len(ROWS)
    texts = defaultdict(list)
    for r in ROWS:
        texts[r[0]].append(r[1])
    for r in got:
        found = False
        for text in texts[r["doc_id"]]:
            w = words_of(text)
            base = sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w) + np.log10((ends + 1) / (n + v + 1))
            found |= abs(base - r["base_score"]) < 1e-6 * abs(base) and r["n_tokens"] == len(w) + 1
            found &= r["train_tokens"] == n
        assert found and r["score"] < 0
    assert np.allclose((10**model.step).sum(1), 1)
    # Emissions of a class, its unseen slot included, add up to one.
    frequent = {int(h): int(model.classes[u]) for h, u in zip(model.frequent.keys, model.frequent.values, strict=True)}

    def class_of(w):
        word = pa.array([w.decode()], pa.large_string())
        own = frequent.get(int(brown.hashes_of(word)[0]))
        return int(model.classes[brown.ending_units(word)[0]]) if own is None else own

    # Scores are transitions times emissions, word by word.
    want = defaultdict(list)
    for i, text, *_ in ROWS:
        line = [0, *[class_of(w) for w in words_of(text)], 0]
        total = sum(model.step[a, b] - model.norm[b] for a, b in zip(line, line[1:], strict=False))
        total += sum(np.log10(count[w] + brown.ALPHA) for w in words_of(text)) + np.log10(ends + brown.ALPHA)
        want[i].append(total)
    for r in got:
        assert any(abs(r["score"] - x) < 1e-6 * abs(x) for x in want[r["doc_id"]])
    mass = Counter()
    kinds = Counter()
    for w, c in count.items():
        cls = class_of(w)
        mass[cls] += c + brown.ALPHA
        kinds[cls] += 1
    for cls, total in mass.items():
        assert abs((total + brown.ALPHA) / 10 ** model.norm[cls] - 1) < 1e-9
    model, counted = brown.fit(empty)
    assert all(np.isfinite(r["score"]) for r in brown.scored(docs, model, counted).collect())


# ---- toxicity ---------------------------------------------------------------------


def test_nearest_neighbours_are_exact():
    rng = np.random.default_rng(4)
    terms = [str(i).encode() for i in range(40)]
    rows = []
    for i in range(900):
        t = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        rows.append((i, int(rng.integers(0, 2)), t, rng.integers(1, 4, len(t))))
    index = toxicity.build_index(terms, rng.uniform(1, 3, 40), rows)
    dense = np.zeros((len(index.ids), 40))
    by_id = {r[0]: r for r in rows}
    for k, i in enumerate(index.ids):
        dense[k, by_id[i][2]] = index.vector(by_id[i][2], by_id[i][3].astype(float))
    for _ in range(60):
        t = np.sort(rng.choice(40, 4, replace=False))
        q = index.vector(t, np.ones(4))
        cosines = dense[:, t] @ q
        ids, got = index.nearest(t, q)
        assert np.allclose(np.sort(cosines)[::-1][: len(got)], got)
        assert len(got) == min(toxicity.NEIGHBOURS, int((cosines > 0).sum()))


def test_toxicity_votes_equal_brute_force(spark):
    """Terms, document frequencies, evidence, cosines and votes of a whole
    table, by dictionaries."""
    where = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{where}/{name}.parquet") for name in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    told = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}

    def bag(text):
        bare = (w.strip(toxicity.EDGES.encode()) for w in words_of(text))
        return Counter(w for w in bare if w)

    bags = {i: bag(t) for i, t in texts.items()}
    toxic = sum(told.values())
    seen = [Counter(w for i, y in told.items() if y == want for w in bags[i]) for want in (1, 0)]
    many = Counter(w for b in bags.values() for w in b)

    def term_weight(w):
        cells = [(seen[0][w], toxic), (seen[1][w], len(told) - toxic)]
        p = sum(k for k, _ in cells) / len(told)
        gain = 0.0
        for k, n in cells:
            for part, rate, all_rate in ((k, k / n, p), (n - k, 1 - k / n, 1 - p)):
                if part:
                    gain += 2 * part * (np.log(rate) - np.log(all_rate))
        proof = np.sqrt(max(gain, 0.0))
        return (np.log((1 + len(texts)) / (1 + many[w])) + 1) * (proof if proof >= toxicity.CHANCE else 1.0)

    weight = {w: term_weight(w) for w in {w for i in told for w in bags[i]}}
    assert len(index.hashes) == len(weight) and 0 < toxic < len(told)

    def vector(b):
        v = {w: (1 + np.log(c)) * weight[w] for w, c in b.items() if w in weight}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = {i: vector(bags[i]) for i in told}
    base = (toxic + 0.5) / (len(told) + 1)
    place = {int(i): n for n, i in enumerate(index.ids)}
    got = {r["id"]: r for r in toxicity.voted(docs.selectExpr("doc_id as id", "text"), index).collect()}
    assert got.keys() == texts.keys()
    for i, b in bags.items():
        own = vector(b)
        near = [(sum(x * e.get(w, 0.0) for w, x in own.items()), place[j], told[j]) for j, e in examples.items()]
        near = sorted((-round(c, 12), n, c, y) for c, n, y in near if c > 0)[: toxicity.NEIGHBOURS]
        near = [(c, y) for _, _, c, y in near]
        vote = (sum(c * y for c, y in near) + toxicity.PRIOR * base) / (sum(c for c, _ in near) + toxicity.PRIOR)
        assert abs(vote - got[i]["vote"]) < 1e-9


def test_toxicity_repeated_ids(spark):
    """All rows of an id are one example; every row is scored."""
    rows = [(1, f"text number {n} with words") for n in range(50)] + [(3, None), (4, ""), (None, "words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i or 0) % 2) for i in (1, 1, 3, 4, 6, None)], "doc_id long, toxic int")
    examples = toxicity.labelled_examples(docs, labels)
    assert examples.count() == examples.select("id").distinct().count()
    assert toxicity.scored(docs, toxicity.fit(docs, labels)).count() == len(rows)


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op6_toxicity_neighbours(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.9 * len(rows)


def test_toxicity_without_labels_or_text(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0


# ---- empty tables -------------------------------------------------------------------


def test_empty_tables(empty):
    assert near_dup.classes(empty).count() == 0
    assert line_dedup.remove_repeats(empty).count() == 0
    assert quality.assess(empty, ["doc_id"]).count() == 0
    assert mixing.sampled(empty).count() == 0
    assert packing.packed(empty, packing.tokenizer_path()).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, function in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), function(spark, docs, folder)
        assert docs.columns == columns and docs.count() <= 2 * before
    packed = corpus_pipeline.run(spark, folder).collect()
    by_sequence = Counter()
    for p in packed:
        by_sequence[p["sequence_id"]] += p["length"]
    assert packed and max(by_sequence.values()) <= packing.WINDOW
