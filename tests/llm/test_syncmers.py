"""Closed syncmers: successors, edited texts and anchors against plain Python."""

import hashlib
import random

import xxhash
from codeloom.llm import syncmers as S
from pyspark.sql import functions as F


def sh(x, seed=42):
    return xxhash.xxh64_intdigest(x, seed)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chain(values):
    """xxhash64 over several longs: each value's hash is seeded by the one before."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), h)
    return signed(h)


def anchors(hashes):
    if hashes is None:
        return []
    if len(hashes) < S.K:
        return [chain(hashes) & 0xFFFFFFFF]
    out = []
    runs = [chain(hashes[i:i + 2]) for i in range(len(hashes) - 1)]
    for i in range(len(hashes) - S.K + 1):
        r = runs[i:i + S.K - S.S + 1]
        if min(r) in (r[0], r[-1]):
            out.append(chain(hashes[i:i + S.K]) & 0xFFFFFFFF)
    return out


def finger(text):
    words = [signed(sh(w.encode())) for w in text.split()]
    chars = None
    if len(text) < S.SHORT:
        h = [signed(sh(c.encode())) for c in text]
        one = lambda a: signed(xxhash.xxh64_intdigest((1).to_bytes(4, "little"), a % 2**64))
        chars = [one(a) for a in h]
    return words, chars


def rows_of(n=60):
    rnd = random.Random(4)
    vocab = [f"{rnd.choice('aébc')}{i}" for i in range(80)]
    rows = [(i * i * 37, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 40, 300])))) for i in range(n)]
    return rows + [(5, None), (6, ""), (7, "abc"), (8, "x" * 1000), (37, rows[1][1]), (37, "zzz"), (10**12, rows[3][1]), (None, "no id at all")]


def test_successors_and_edits(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 4)
    rows = rows_of()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, g int")
    got = sorted((str(r.id), r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in S.edit_fingerprints(df.repartition(5)).collect())
    order = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (r[0], r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 4
        want.append((str(i), len(t), hashlib.sha256((t[:len(t) - m] + nxt[:m]).encode()).hexdigest()))
    t = "no id at all"
    want.append(("None", len(t), hashlib.sha256(t[:9].encode()).hexdigest()))
    assert got == sorted(want)


def test_anchors_against_brute_force(spark):
    texts = [t for _, t in rows_of() if t]
    df = S.with_anchors(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "a")
    for r in df.select("t", "a").collect():
        words, chars = finger(r.t)
        assert [x["hash"] for x in r.a][:len(anchors(words))] == anchors(words)
        if chars is None:
            assert len(r.a) == len(anchors(words))


def test_likeness(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(400))) for i in range(20)] + [(100, "same"), (101, "same")]
    out = {r.id: r for r in S.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(0.45 < out[i].near_edited < 0.75 and out[i].near_next < 0.05 for i in range(19))
    assert out[100].near_next == 1.0 and out[100].fingerprint == out[101].fingerprint
    text = rows[0][1]
    shifted = S.with_anchors(spark.createDataFrame([(text,), ("new start " + text,)], "t string"), "t", "a")
    a, b = [{x["hash"] for x in r.a} for r in shifted.select("a").collect()]
    assert a <= b


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.edit_fingerprints(df).count() == 0
    one = S.edit_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string"))
    r = one.collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    plan = one._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_texts_without_spaces_and_around_the_short_length(spark):
    rnd = random.Random(2)
    han = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    code = lambda n: "".join(rnd.choice("abcdefABCDEF0123456789+/🎉") for _ in range(n))
    rows = [(i, (han if i % 2 else code)(4000)) for i in range(8)]
    out = {r.id: r for r in S.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(0.45 < out[i].near_edited < 0.75 and out[i].near_next < 0.05 for i in range(8))
    words = " ".join(code(5) for _ in range(42))[:250]
    for x in (words, han(250), code(250)):
        pair = spark.createDataFrame([(x + "abcd", x + "abcdefgh")], "s string, t string")
        pair = S.with_anchors(S.with_anchors(pair, "s", "a"), "t", "b")
        assert pair.select(S.likeness(F.col("a"), F.col("b"))).first()[0] > 0.7
