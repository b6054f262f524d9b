"""SimHash with Golay keys against brute force over all pairs."""

import itertools
import random

import numpy as np
import xxhash

from codeloom.llm import simhash as S


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(rows):
    ids = [i for i, _ in rows]
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = min([x for x in (low.get(r), d) if x is not None], default=None)
    return [low[find(i)] for i in range(len(rows))], fps


def test_perfect_code_and_keys_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    e = S._TABLE[S._remainder(words)]
    assert (np.bitwise_count(e.astype(np.uint64)) <= 3).all() and (S._remainder(words ^ e) == 0).all()
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(0, 4):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, k, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        ra, ka = S.golay_keys(base)
        rb, kb = S.golay_keys(other)
        met = set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))
        assert {r for r, _ in met} == set(range(len(base)))


def _rows():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(150, 400))]
        for c in range(rnd.randint(1, 8)):
            w = list(words)
            for _ in range(c // 2):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((len(rows) * 3, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "ONE  two"), (None, rows[0][1]),
             (0, rows[0][1]), (1005, "É é x"), (1006, "é É x"), (1007, "a b\x1cc d e f")]
    return rows


def test_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", S.F.lit("clash"))
    got = sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in S.near_duplicates(df).collect()), key=str)
    comp, fps = brute_components(rows)
    assert got == sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, comp)), key=str)


def test_dense_ball_is_one_component_with_few_links(spark):
    rng = np.random.default_rng(2)
    base = np.uint64(0x0123456789ABCDEF)
    fps = {int(base)}
    while len(fps) < 400:
        f = int(base)
        for b in rng.choice(64, 3, replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    from codeloom.llm.components import connected_components
    found = S.links(df)
    comp = connected_components(found).select("component").distinct().count()
    assert comp == 1 and found.count() < 400 * 60


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    comp, _ = brute_components(rows)
    want = sorted({i for (i, _), c in zip(rows, comp) if i is not None and i == c})
    got = [r.doc_id for r in S.keep_one(df).collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == 1
