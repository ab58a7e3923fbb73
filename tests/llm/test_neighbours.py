"""Nearest labelled examples: all cosines, common terms as a matrix."""

import tracemalloc

import numpy as np

from tagloom.llm import toxicity


def examples(n, terms, share, seed=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = np.flatnonzero(rng.random(terms) < share)
        rows.append((i, int(rng.integers(0, 2)), t, rng.integers(1, 5, len(t))))
    return rows, rng.uniform(1, 9, terms)


def test_common_terms_are_not_read_posting_by_posting():
    rows, weight = examples(2500, 240, 0.9)
    index = toxicity.build_index(np.arange(240), weight, rows)
    t = np.arange(240)
    q = index.vector(t, np.ones(len(t)))
    index.nearest(t, q)
    postings = sum(len(r[2]) for r in rows)
    tracemalloc.start()
    index.nearest(t, q)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert postings > 150_000 and most < 8 * postings


def test_common_and_rare_terms_together_give_every_cosine(monkeypatch):
    """Against a table of all cosines; a vector's result is the same, to the
    bit, alone and in any batch."""
    share = np.concatenate([np.full(20, 0.5), np.full(80, 0.05), np.full(20, 0.001)])
    rows, weight = examples(700, 120, share)
    rows += [(700 + i, 1, rows[5][2], rows[5][3]) for i in range(40)]
    whole = toxicity.build_index(np.arange(120), weight, rows)
    dense = np.zeros((len(whole.ids), 120))
    by_id = {r[0]: r for r in rows}
    for k, i in enumerate(whole.ids):
        dense[k, by_id[i][2]] = whole.vector(by_id[i][2], by_id[i][3].astype(float))
    rng = np.random.default_rng(2)
    vectors = []
    for n in (0, 1, 3, 30, 100, 120):
        for _ in range(40):
            t = np.sort(rng.choice(120, n, replace=False))
            vectors.append((t, whole.vector(t, rng.integers(1, 9, n).astype(float))))
    vectors.append((rows[5][2], whole.vector(rows[5][2], rows[5][3].astype(float))))
    for most in (0, 13, 120):
        monkeypatch.setattr(toxicity, "DENSE", most)
        index = toxicity.build_index(np.arange(120), weight, rows)
        for vector, begun in zip(vectors, index.common(vectors), strict=False):
            t, q = vector
            cosines = np.round(dense[:, t] @ q, 12)
            want = np.lexsort((np.arange(len(cosines)), -cosines))[: toxicity.NEIGHBOURS]
            want = want[cosines[want] > 0]
            got, found = index.nearest(t, q, begun=begun)
            assert np.allclose(found, cosines[want], atol=1e-11)
            assert np.allclose(cosines[got], found, atol=1e-11)
            alone = index.nearest(t, q)
            assert np.array_equal(alone[0], got) and np.array_equal(alone[1], found)
            but = index.nearest(t, q, int(got[0]) if len(got) else 0)[0]
            assert not len(got) or got[0] not in but
