"""Hard negatives against brute force in Python integers; the tree's eliminations against all distances."""

import math

import numpy as np
import pytest

from codeloom.llm import hardneg as H


def brute(rows, positives=5, negatives=5, low=80, high=100, every=100, scale=256):
    good = [(i, n, tuple(math.floor(scale * x) for x in v)) for i, v, n in rows
            if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in good if i % every == 0}):
        label, v = min((n, w) for i, n, w in good if i == a)
        others = [(-sum(x * y for x, y in zip(v, w)), i, n) for i, n, w in good if i != a and len(w) == len(v)]
        for s, p, _ in sorted(o for o in others if o[2] == label)[:positives]:
            fit = sorted((t, i) for t, i, n in others if n != label and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def rows_of(seed=1, n=500, dim=8, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.3
    rows = [(int(i), [float(np.float32(a)) for a in v], int(rng.integers(labels))) for i, v in enumerate(x)]
    same = rows[7][1]
    rows += [(1000 + i, same, i % 3) for i in range(90)]                          # ties, a hot vector
    rows += [(2000, None, 1), (2010, [float("nan")] * dim, 1), (2020, [None] + same[1:], 1), (2030, [float("inf")] + same[1:], 1),
             (None, same, 1), (2040, same, None), (2050, [1.0, 2.0], 0), (2051, [3.0, 4.0], 0), (2052, [2.0, 5.0], 1), (2060, [1e6] * dim, 2),
             (2061, [1e6] * dim, 2), (2070, [], 1), (2071, [], 2), (2080, [0.0] * dim, 1), (2081, [0.0] * dim, 2), rows[3], rows[10],
             (20, same, 3), (2090, [-v for v in same], 0)]
    return rows


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, leaf int, v string")
    got = sorted(tuple(r) for r in H.mine(df.repartition(4), **kw).collect())
    assert got == brute(rows, **kw)
    return got


def test_against_brute_force(spark, monkeypatch):
    assert len(check(spark, rows_of(), every=10)) > 500
    monkeypatch.setattr(H, "LEAF_ROWS", 60)
    monkeypatch.setattr(H, "CHUNK", 30)
    monkeypatch.setattr(H, "BLOCK", 8)
    monkeypatch.setattr(H, "PIECE", 2)
    check(spark, rows_of(2, 300), every=20)
    check(spark, rows_of(3, 60, 3, 2), every=5, positives=3, negatives=7, low=50, high=90)


def test_all_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 16)
    check(spark, [(i, [1.0, 2.0], i % 2) for i in range(200)], every=50)
    check(spark, [(i, [0.0, 0.0], i % 2) for i in range(40)], every=10)


def test_few_rows(spark):
    check(spark, [(0, [1.0], 1)])
    check(spark, [(0, [1.0], 1), (1, [1.0], 1)])
    check(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)])
    assert H.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_tree_keeps_every_vector_in_a_window(spread):
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)] + spread * rng.normal(size=(3000, 16))))
    t = H.Tree(x[:500].astype(np.int64), 20)
    t.ranges = {}
    t.measure(x, t.ranges)
    leaf, q = t.walk(x), x[:40]
    s = q @ x.T
    low, high = np.quantile(s, [0.97, 0.999], axis=1)
    visited = dict(t.reach(q, low[:, None], high[:, None]))
    scored = 0
    for i in range(len(q)):
        mine = {n for n, rows in visited.items() if i in rows}
        assert set(leaf[(s[i] >= low[i]) & (s[i] <= high[i])]) <= mine
        scored += np.isin(leaf, list(mine)).sum()
    if spread < 1:                                                  # groups of vectors: most are eliminated
        assert scored < 0.4 * s.size


def test_blobs():
    for a in ([], [1, -5], [127, -128], [128], [1 << 40], [H.LOWEST, H.HIGHEST]):
        assert H.unpack(H.pack(np.array(a, np.int64))).tolist() == a
