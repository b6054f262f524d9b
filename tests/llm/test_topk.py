"""Top-k search against brute force in Python integers."""

import math

import numpy as np

from codeloom.llm import topk as T


def brute(rows, k, every):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for q, v in good:
        if q % every or q in done:
            continue
        done.add(q)
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def rows_of(seed=1, n=400, dim=8, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.1 * spread
    rows = [(int(i), [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(80)]                 # ties, a hot vector
    rows += [(2000, None), (2010, [float("nan")] * dim), (2020, [None] + same[1:]), (2030, [float("inf")] + same[1:]),
             (None, same), (2040, [1.0, 2.0]), (2041, [3.0, 4.0]), (2050, [1e9] * dim), (rows[3][0], rows[3][1]), (2060, [])]
    return rows


def check(spark, rows, k, every, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cell string, dim int")
    got = sorted(tuple(r) for r in T.top_k(df.repartition(4), k, every, **kw).collect())
    assert got == brute(rows, k, every)


def test_against_brute_force(spark, monkeypatch):
    check(spark, rows_of(), 10, 10)
    monkeypatch.setattr(T, "CHUNK", 40)
    monkeypatch.setattr(T, "BLOCK", 16)
    check(spark, rows_of(2), 5, 10)
    check(spark, rows_of(3, 30), 50, 10)


def test_far_cells_are_not_visited(spark):
    cells = [{"cell": (2 << 16) + i, "dim": 2, "n": 50, "radius": 1.0, "queries": 1, "query_radius": 1.0} for i in range(3)]
    pivots = {2: np.array([[100.0, 0.0], [0.0, 100.0], [-100.0, 0.0]])}
    pairs = T._visits(pivots, cells, 10)
    assert ((2 << 16), (2 << 16)) in pairs and ((2 << 16), (2 << 16) + 2) not in pairs


def test_empty(spark):
    assert T.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
