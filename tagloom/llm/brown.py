"""Language model scoring by Brown class-based bigrams (operator 7).

    P(word | previous) = P(class | previous class) * P(word | class)

Texts are read once and kept as numbers, in blocks of neighbouring texts with
the distinct words of each. Exchange clustering assigns every word of the
training text to a class of its own choice. It starts from units: one of the
``FREQUENT`` commonest words, or an ending shared by other words; the end of a
text is a unit in a class of its own. Units are moved one by one to the class
that raises the likelihood of the class bigrams most, until none moves; the
counts behind it are a Spark aggregate over the bigrams of the whole training
text, of a size that the units fix. Then each other word, however rare, is moved by the same gain, worked out
in Spark from all its neighbours' classes. Only a word that the training text
lacks keeps the class of its ending.

Transitions and emissions use exact counts of every word of the training text.
Common words are looked up in a bounded broadcast table, the others by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.llm.words import arrow_schema, coded, hashes_of, remainder, tidied
from tagloom.operators.staging import stage

FREQUENT = 2000
ENDINGS = 500
CLASSES = 64
# Words whose counts every task holds; the rest are joined.
COMMON = 50_000
# Text of a block. A longer text is a block of its own.
BLOCK_BYTES = 8 << 20
# Tokens of a block that a task works on at once, and words whose gains it works out at once.
PORTION = 1 << 18
WORDS_AT_ONCE = 1024
# Tokens of the input for each file of the table of words, whatever the partitions of its shuffle.
TOKENS_A_FILE = 4_000_000
# Counts up to which gains are read from a table.
LISTED = 32
# Pseudo-counts of an emission and of a class transition.
ALPHA, BETA = 0.5, 1.0
END_UNIT, END_CLASS = 0, 0
UNITS = 1 + FREQUENT + ENDINGS


def ending_units(words: pa.Array) -> np.ndarray:
    """The units of words that are not frequent: by their last three characters,
    without sentence marks."""
    tails = pc.utf8_slice_codeunits(pc.ascii_rtrim(words, characters=".,;:!?"), start=-3).dictionary_encode()
    units = hashes_of(tails.dictionary).view(np.uint64) % np.uint64(ENDINGS)
    return 1 + FREQUENT + units.astype(np.int64)[tails.indices.to_numpy()]


BLOCK = "block long, doc_id array<long>, training array<boolean>, size array<int>, at binary, words binary, endings binary"


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``BLOCK_BYTES`` together, as spans of rows."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(size) - size) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    return zip(cuts, cuts[1:], strict=False)


def portions(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Neighbouring texts of about ``PORTION`` tokens together, as spans of texts
    and of tokens. A portion is as much longer as its last text is."""
    ends = np.append(0, np.cumsum(sizes))
    cuts = [0, *(np.flatnonzero(np.diff((ends[:-1] + np.arange(len(sizes))) // PORTION)) + 1).tolist(), len(sizes)]
    return ((a, z, int(ends[a]), int(ends[z])) for a, z in zip(cuts, cuts[1:], strict=False))


def one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def packed(x: np.ndarray) -> pa.Array:
    """One value: the numbers' bytes by place, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.array([len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)], pa.binary())


def unpacked(value: pa.Scalar, kind: type) -> np.ndarray:
    raw, width = value.as_py(), np.dtype(kind).itemsize
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(width, n).T.copy().reshape(-1).view(kind)


def blocks(docs: DataFrame) -> DataFrame:
    """Texts as numbers. ``at`` has each token's place in ``words``, the hashes
    of the block's distinct words, commonest first."""
    arrow = arrow_schema(StructType.fromDDL(BLOCK))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for a, z in slices(whole.column(3)):
                batch = whole.slice(a, z - a)
                if not batch.num_rows:
                    continue
                words, at, sizes = coded(batch.column(3))
                order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.int32)
                rank[order] = np.arange(len(words))
                arrays = rank[at], hashes_of(words)[order], ending_units(words)[order].astype(np.int16)
                columns = [
                    batch.column(0).slice(0, 1), one_list(batch.column(1)), one_list(batch.column(2)),
                    one_list(pa.array(sizes.astype(np.int32))), *map(packed, arrays),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names).cast(arrow)

    rows = docs.select(
        F.monotonically_increasing_id().alias("block"), F.col("doc_id").cast("long").alias("doc_id"),
        (remainder(F.col("doc_id"), 7) != 2).alias("training"), "text",
    )
    return rows.mapInArrow(tidied(run), BLOCK)


class Block:
    """Arrays of one row of :func:`blocks`."""

    def __init__(self, row: dict):
        self.sizes = row["size"].values.to_numpy().astype(np.int64)
        self.training = row["training"].values.to_numpy(zero_copy_only=False)
        self.at = unpacked(row["at"], np.int32)
        self.words = unpacked(row["words"], np.int64) if "words" in row else None
        self.endings = unpacked(row["endings"], np.int16).astype(np.int64) if "endings" in row else None

    def trained(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and sizes of the training texts."""
        return self.at[np.repeat(self.training, self.sizes)], self.sizes[self.training]


def each_block(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in source:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            yield row, Block(row)


def word_counts(table: DataFrame) -> DataFrame:
    """``word (hash), n, ending``: counted per block, then by Spark."""
    kind = "word long, n long, ending int"
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in each_block(source):
            n = np.bincount(b.trained()[0], minlength=len(b.words)).astype(np.int64)
            seen = n > 0
            columns = [b.words[seen], n[seen], b.endings[seen].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    return (
        table.mapInArrow(tidied(run), kind)
        .groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"))
    )


class Lookup:
    """Values of a bounded table of word hashes."""

    def __init__(self, table: dict[int, int]):
        keys = np.fromiter(table.keys(), np.int64, len(table))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.fromiter(table.values(), np.int64, len(table))[order]

    def of(self, hashes: np.ndarray, missing: int | np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.broadcast_to(missing, hashes.shape)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.values[at], missing)


def between_ends(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The tokens of texts in one row, with the end (0) before, between and
    after them."""
    out = np.zeros(len(values) + len(sizes) + 1, values.dtype)
    token = np.ones(len(out), bool)
    token[np.append(0, np.cumsum(sizes + 1))] = False
    out[token] = values
    return out


def steps_of(line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each token of a row with the next one, ``PORTION`` at a time."""
    for low in range(0, len(line) - 1, PORTION):
        piece = line[low : low + PORTION + 1]
        yield piece[:-1], piece[1:]


def pair_counts(table: DataFrame, width: int, codes_of: Callable[[dict, Block], np.ndarray]) -> DataFrame:
    """``a, b, n``: bigrams of the numbers that ``codes_of`` gives a block's
    distinct words, over the training texts, ends included. A task counts in
    one array whose size ``width`` fixes."""
    kind = "a int, b int, n long"
    arrow = arrow_schema(StructType.fromDDL(kind))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width * width, np.int64)
        for row, b in each_block(source):
            at, sizes = b.trained()
            for left, right in steps_of(between_ends(codes_of(row, b).astype(np.int16)[at], sizes)):
                code, n = np.unique(left.astype(np.int32) * width + right, return_counts=True)
                counts[code] += n
        for low in range(0, len(counts), PORTION):
            code = low + np.flatnonzero(counts[low : low + PORTION])
            columns = [(code // width).astype(np.int32), (code % width).astype(np.int32), counts[code]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    return table.mapInArrow(tidied(run), kind).groupBy("a", "b").agg(F.sum("n").alias("n"))


def unit_bigrams(table: DataFrame, frequent: Lookup) -> DataFrame:
    """``a, b, n``: bigrams of units, from which the exchange starts."""
    return pair_counts(table, UNITS, lambda _, b: frequent.of(b.words, b.endings))


def plogp(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n * np.log(np.maximum(n, 1e-300)), 0.0)


def exchange(counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Class of every unit, from the table of unit bigrams. Units start dealt
    by frequency; one after the other takes its best class, counts being brought
    up to date with each move, until none moves. Ties take the lower class; the
    end never moves."""
    classes = np.zeros(UNITS, np.int64)
    classes[order] = 1 + np.arange(len(order)) % (CLASSES - 1)
    classes[END_UNIT] = END_CLASS
    member = np.eye(CLASSES)[classes]
    # By unit: classes that follow it, classes that precede it.
    right, left = counts @ member, counts.T @ member
    joint = class_counts(counts, classes)
    own, totals, n = np.diag(counts), counts.sum(1), joint.sum(1)
    moved = True
    while moved:
        moved = False
        for u in order.tolist():
            total, x, s = totals[u], classes[u], own[u]
            if not total or u == END_UNIT:
                continue
            r, l = right[u].copy(), left[u].copy()
            r[x] -= s
            l[x] -= s
            joint[x] -= r
            joint[:, x] -= l
            joint[x, x] -= s
            n[x] -= total
            now = plogp(joint)
            diagonal = np.diag(joint)
            gain = (plogp(joint + r) - now).sum(1) + (plogp(joint + l[:, None]) - now).sum(0)
            # The cell of a class with itself takes both sides at once.
            gain += plogp(diagonal + r + l + s) - plogp(diagonal + r) - plogp(diagonal + l) + np.diag(now)
            # A word's neighbours stay, whichever class it joins.
            gain -= 2 * (plogp(n + total) - plogp(n))
            gain[END_CLASS] = -np.inf
            y = int(np.argmax(np.round(gain, 6)))
            if gain[y] <= gain[x] + 1e-5:
                y = x
            joint[y] += r
            joint[:, y] += l
            joint[y, y] += s
            n[y] += total
            if y != x:
                moved, classes[u] = True, y
                right[:, x] -= counts[:, u]
                right[:, y] += counts[:, u]
                left[:, x] -= counts[u]
                left[:, y] += counts[u]
    return classes


def class_counts(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Bigrams of classes, from those of units."""
    member = np.eye(CLASSES)[classes]
    return member.T @ counts @ member


def rest_contexts(table: DataFrame, frequent: Lookup, classes: np.ndarray) -> DataFrame:
    """``word, ending, context``: for each block and word that is not frequent
    the classes it stands between, a byte for each neighbour: the class that
    follows, ``CLASSES`` and the class that precedes, or twice ``CLASSES`` for
    the word after itself."""
    kind = "word long, ending int, context binary"
    arrow = arrow_schema(StructType.fromDDL(kind))
    shared = table.sparkSession.sparkContext.broadcast((frequent, classes))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes = shared.value
        for _, b in each_block(source):
            at, sizes = b.trained()
            # Place 0 is the end.
            near = np.append(END_CLASS, classes[frequent.of(b.words, b.endings)]).astype(np.uint8)
            rest = np.append(False, frequent.of(b.words, -1) < 0)
            # A key is a word's place, then the code in the lowest byte; as short as the places allow.
            kind = np.min_scalar_type(256 * len(rest))
            keys = [np.zeros(0, kind)]
            for left, right in steps_of(between_ends(at + np.int32(1), sizes)):
                one, two = rest[left], rest[right]
                same = left[one & (left == right)].astype(kind)
                after, before = left[one].astype(kind), right[two].astype(kind)
                keys += [after * 256 + near[right[one]], before * 256 + near[left[two]] + CLASSES, same * 256 + 2 * CLASSES]
            key = np.concatenate(keys)
            del keys
            key.sort()
            code, word = key.astype(np.uint8), key >> 8
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
            number = word[heads] - 1
            ends = np.append(heads, len(code)).astype(np.int32)
            context = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(code)])
            columns = [pa.array(b.words[number]), pa.array(b.endings[number].astype(np.int32)), context]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names).cast(arrow)

    return table.mapInArrow(tidied(run), kind)


def whole_runs(source: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Rows sorted by a column, with all rows of a value in one table."""
    kept: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        begin = int(np.searchsorted(values, values[-1]))
        if begin or (kept and kept[0].column(column)[0].as_py() != values[-1]):
            head = [*kept, batch.slice(0, begin)]
            yield pa.Table.from_batches([h for h in head if h.num_rows], schema=batch.schema)
            kept = []
        kept.append(batch.slice(begin))
    if kept:
        yield pa.Table.from_batches(kept)


class Gains:
    """What moving a word to a class adds to the likelihood of class bigrams,
    its own occurrences taken out of the counts first."""

    def __init__(self, joint: np.ndarray):
        self.joint, self.n = joint, joint.sum(1)
        k = np.arange(LISTED + 1)[:, None, None]
        # [times, class of the context, class joined]
        self.follow = plogp(joint.T + k) - plogp(joint.T)
        self.precede = plogp(joint + k) - plogp(joint)

    def added(self, table: np.ndarray, cells: np.ndarray, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = table[np.minimum(k, LISTED).astype(np.int64), c]
        many = k > LISTED
        out[many] = plogp(cells[c[many]] + k[many, None]) - plogp(cells[c[many]])
        return out

    def of(self, r: np.ndarray, l: np.ndarray, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Gains of words (rows) by class. ``r`` and ``l`` count the classes
        after and before them, ``s`` themselves after themselves, which ``r``
        and ``l`` leave out; ``x`` are their classes."""
        joint, word = self.joint, np.arange(len(x))
        gain, total = np.zeros(r.shape), r.sum(1) + s
        stay = np.zeros(len(x))
        for side, table, cells in ((r, self.follow, joint.T), (l, self.precede, joint)):
            w, c = np.nonzero(side)
            if len(w):
                heads = np.flatnonzero(np.diff(w, prepend=-1))
                gain[w[heads]] += np.add.reduceat(self.added(table, cells, c, side[w, c]), heads)
            other = c != x[w]
            w, c = w[other], c[other]
            cell = cells[c, x[w]]
            stay += np.bincount(w, plogp(cell) - plogp(cell - side[w, c]), len(x))

        def rise(j: np.ndarray, k: np.ndarray) -> np.ndarray:
            return plogp(j + k) - plogp(j)

        # A cell of the class left has lost what the word's other side held.
        for one, two, cells in ((l, r[word, x], joint), (r, l[word, x], joint.T)):
            w, y = np.nonzero((one > 0) & (two[:, None] > 0))
            cell = cells[y, x[w]]
            gain[w, y] += rise(cell - one[w, y], two[w]) - rise(cell, two[w])
        # The cell of a class with itself takes both sides at once.
        w, y = np.nonzero(((r > 0) & (l > 0)) | (s[:, None] > 0))
        cell, both = joint[y, y], r[w, y] + l[w, y] + s[w]
        gain[w, y] += rise(cell, both) - rise(cell, r[w, y]) - rise(cell, l[w, y])
        both = (r + l)[word, x] + s
        own = joint[x, x]
        stay += plogp(own) - plogp(own - both)
        gain -= 2 * rise(self.n, total[:, None])
        gain[word, x] = stay - 2 * rise(self.n[x] - total, total)
        # All words would choose an empty class at once, each as its only word.
        gain[:, (self.n == 0) | (np.arange(CLASSES) == END_CLASS)] = -np.inf
        return gain


def rest_classes(found: DataFrame, classes: np.ndarray, joint: np.ndarray) -> DataFrame:
    """``word, n, class`` of words that are not frequent: their count and the
    class of the largest gain, the lower one of equals. Rows of a word meet by
    Spark's shuffle."""
    kind = "word long, n long, class int"
    arrow = arrow_schema(StructType.fromDDL(kind))
    shared = found.sparkSession.sparkContext.broadcast((classes, joint))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, joint = shared.value
        gains = Gains(joint)
        for table in whole_runs(source):
            words = table.column("word").to_numpy()
            new = np.append(True, words[1:] != words[:-1])
            heads = np.flatnonzero(new)
            x = classes[np.minimum.reduceat(table.column("ending").to_numpy(), heads)]
            lists = table.column("context").combine_chunks()
            flat = np.frombuffer(b"".join(lists.to_pylist()), np.uint8)
            group = np.repeat(np.cumsum(new) - 1, pc.binary_length(lists).to_numpy())
            width = 2 * CLASSES + 1
            for a in range(0, len(heads), WORDS_AT_ONCE):
                size = min(WORDS_AT_ONCE, len(heads) - a)
                lo, hi = np.searchsorted(group, [a, a + size])
                counts = np.bincount((group[lo:hi] - a) * width + flat[lo:hi], minlength=size * width).reshape(size, width).astype(float)
                own, current = counts[:, -1], x[a : a + size]
                n = counts[:, :CLASSES].sum(1).astype(np.int64)
                r, l = counts[:, :CLASSES].copy(), counts[:, CLASSES:-1].copy()
                r[np.arange(size), current] -= own
                l[np.arange(size), current] -= own
                best = np.argmax(np.round(gains.of(r, l, own, current), 6), 1)
                columns = [pa.array(words[heads[a : a + size]]), pa.array(n), pa.array(best.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(tidied(run), kind)


class Model:
    """What tasks need to score a text; its size does not grow with the corpus.
    The words that are not common are in the table of counts."""

    def __init__(self, frequent, classes, joint, common, counts, kinds, total, distinct):
        self.frequent, self.classes, self.common = frequent, classes, common
        back = joint.sum(0) + BETA
        back /= back.sum()
        smooth = joint + BETA * CLASSES * back[None, :]
        self.step = np.log10(smooth / smooth.sum(1, keepdims=True))
        # One slot per class for words never seen, besides its distinct words.
        self.norm = np.log10(np.maximum(counts + ALPHA * (kinds + 1), ALPHA))
        self.total, self.distinct = total, distinct
        self.ends = float(counts[END_CLASS])


def joined(bigrams: DataFrame, size: int) -> np.ndarray:
    """The bigrams of ``size`` numbers as a table on the driver."""
    found = bigrams.toArrow()
    out = np.zeros((size, size))
    out[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of words, their counts and classes, from the
    training rows."""
    return fit_blocks(stage(blocks(docs)))[:2]


def fit_blocks(table: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """As ``fit``, and the blocks with their words' classes."""
    texts = F.sum(F.size(F.filter("training", lambda t: t))), F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda n, k: n + k))
    ends, tokens = (n or 0 for n in table.select(*texts).first())
    top = word_counts(table).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    own = {r["word"]: 1 + i for i, r in enumerate(top)}
    frequent = Lookup(own)
    bigrams = joined(unit_bigrams(table, frequent), UNITS)
    order = np.argsort(-bigrams.sum(0), kind="stable")
    classes = exchange(bigrams, order[order != END_UNIT])
    joint = class_counts(bigrams, classes)
    spark = table.sparkSession
    # At most FREQUENT rows.
    leading = spark.createDataFrame([(r["word"], r["n"], int(classes[own[r["word"]]])) for r in top], "word long, n long, class int")
    files = max(spark.sparkContext.defaultParallelism, tokens // TOKENS_A_FILE)
    counted = stage(leading.union(rest_classes(rest_contexts(table, frequent, classes), classes, joint)).coalesce(files))
    totals = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    kinds, mass = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counted.groupBy("class").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect():
        kinds[r["class"]], mass[r["class"]] = r["k"], r["n"]
    kinds[END_CLASS], mass[END_CLASS] = int(ends > 0), ends
    common = {r["word"]: (r["n"], r["class"]) for r in counted.orderBy(F.desc("n"), "word").limit(COMMON).collect()}
    known = stage(with_classes(table, frequent, classes, common, counted))
    final = joined(pair_counts(known, CLASSES, class_codes), CLASSES)
    model = Model(frequent, classes, final, common, mass, kinds, totals["n"] + ends, totals["v"] + (ends > 0))
    return model, counted, known


def class_codes(row: dict, _: Block) -> np.ndarray:
    return unpacked(row["class"], np.int8)


def with_classes(table: DataFrame, frequent: Lookup, classes: np.ndarray, common: dict, counted: DataFrame) -> DataFrame:
    """The blocks with the ``class`` and the training count ``n`` of each of
    their words; a word the training text lacks has its ending's class."""
    places = "block long, place int, word long"
    found = "block long, places binary, ns binary, classes binary"
    known = "block long, doc_id array<long>, training array<boolean>, size array<int>, at binary, n binary, class binary"
    arrow = {k: arrow_schema(StructType.fromDDL(k)) for k in (places, found, known)}
    listed = Lookup({w: n for w, (n, _) in common.items()}), Lookup({w: c for w, (_, c) in common.items()})
    shared = table.sparkSession.sparkContext.broadcast((frequent, classes, *listed))

    def looked_for(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, count, _ = shared.value
        for batch in source:
            for block, value in zip(batch.column(0), batch.column(1), strict=True):
                words = unpacked(value, np.int64)
                place = np.flatnonzero(count.of(words, -1) < 0)
                columns = [np.full(len(place), block.as_py()), place.astype(np.int32), words[place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow[places])

    def gathered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(source):
            block = rows.column("block").to_numpy()
            cuts = [*np.flatnonzero(np.diff(block, prepend=block[0] - 1)).tolist(), len(block)]
            place, n, of = (rows.column(k).to_numpy() for k in ("place", "n", "class"))
            for a, z in zip(cuts, cuts[1:], strict=False):
                arrays = place[a:z].astype(np.int32), n[a:z].astype(np.int64), of[a:z].astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 1]), *map(packed, arrays)], schema=arrow[found])

    def same(row: dict) -> list[pa.Array]:
        return [pa.array([row[k].as_py()], arrow[known].field(k).type) for k in ("block", "doc_id", "training", "size", "at")]

    def begun(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes, count, kind = shared.value
        for row, b in each_block(source):
            of = kind.of(b.words, classes[frequent.of(b.words, b.endings)])
            arrays = count.of(b.words, 0).astype(np.int64), of.astype(np.int8)
            yield pa.RecordBatch.from_arrays([*same(row), *map(packed, arrays)], schema=arrow[known])

    def filled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                n, of = unpacked(row["n"], np.int64), unpacked(row["class"], np.int8)
                if row["places"].is_valid:
                    place = unpacked(row["places"], np.int32)
                    n[place], of[place] = unpacked(row["ns"], np.int64), unpacked(row["classes"], np.int8)
                yield pa.RecordBatch.from_arrays([*same(row), packed(n), packed(of)], schema=arrow[known])

    sought = table.select("block", "words").mapInArrow(tidied(looked_for), places)
    met = (
        sought.join(counted, "word").select("block", "place", "n", "class")
        .repartition("block").sortWithinPartitions("block").mapInArrow(tidied(gathered), found)
    )
    return table.mapInArrow(tidied(begun), known).join(met, "block", "left").mapInArrow(tidied(filled), known)


SCORED = "doc_id long, n_tokens long, n_known long, base double, score double"


def scored(docs: DataFrame, model: Model, counted: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    A null or empty text is one end. Repeated rows are scored alike; a model
    of an empty training table has no known token and finite scores.
    """
    table = stage(blocks(docs))
    return scored_blocks(with_classes(table, model.frequent, model.classes, model.common, counted), model)


def scored_blocks(known: DataFrame, model: Model) -> DataFrame:
    shared = known.sparkSession.sparkContext.broadcast((model.step, model.norm, model.ends))
    arrow = arrow_schema(StructType.fromDDL(SCORED))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, norm, ends = shared.value
        # By the number of a step: its class times CLASSES plus the next one's.
        steps = (step - norm).reshape(-1)
        for row, b in each_block(source):
            classes = unpacked(row["class"], np.int8).astype(np.int16)
            n = unpacked(row["n"], np.int64).astype(float)
            # By distinct word: whether the training text has it, and what it adds to the scores.
            known, base, score = (n > 0).astype(float), np.log10(n + 1), np.log10(n + ALPHA)
            for a, z, low, high in portions(b.sizes):
                sizes, at = b.sizes[a:z], b.at[low:high]
                line = between_ends(classes[at], sizes)
                # Every text has one step more than it has words.
                walked = np.add.reduceat(steps[line[:-1] * CLASSES + line[1:]], np.cumsum(sizes + 1) - sizes - 1)
                text_of = np.repeat(np.arange(len(sizes)), sizes)

                def added(value: np.ndarray, at=at, text_of=text_of, most=len(sizes)) -> np.ndarray:
                    return np.bincount(text_of, value[at], most)

                columns = [
                    row["doc_id"].values.slice(a, z - a),
                    pa.array(sizes + 1),
                    pa.array(added(known).astype(np.int64) + int(ends > 0)),
                    pa.array(added(base) + np.log10(ends + 1)),
                    pa.array(walked + added(score) + np.log10(ends + ALPHA)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names).cast(arrow)

    base = float(np.log10(model.total + model.distinct + 1))
    return known.mapInArrow(tidied(run), SCORED).select(
        "doc_id", "n_tokens", "n_known",
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * base).alias("base_score"),
        "score",
    )


def op7_brown_classes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, _, known = fit_blocks(stage(blocks(docs)))
    return scored_blocks(known, model).withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
