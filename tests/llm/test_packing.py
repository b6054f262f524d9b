"""Harmonic packing: every id in one piece, ids of the tokenizers library, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def check(rows, texts, plain, capacity):
    """rows: packed pieces with ids; texts: list of (id, text)."""
    want = sorted(((i, *plain.encode(t or "", add_special_tokens=False).ids, 2) for i, t in texts), key=str)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        by_seq[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
        by_doc[(r.doc_id, r.doc_tokens)].append((r.start, tuple(int(x) for x in ids)))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for ps in by_seq.values():
        at = 0
        for off, n, total in sorted(ps):
            assert off == at and total == sum(x[1] for x in ps) <= capacity
            at += n
    got = []
    for (i, n), ps in by_doc.items():
        copies = sum(s == 0 for s, _ in ps)
        seen = sorted(set(ps))
        if copies == 1 or len(ps) == copies * len(seen):
            flat = tuple(x for _, p in seen for x in p)
            assert len(flat) == n
            got += [(i, *flat)] * copies
    assert sorted(got, key=str) == want
    return len(by_seq)


def rows_of(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in texts], "doc_id long, text string, part string, cls int")
    return P.pack(df, PATH, keep_ids=True, **kw).collect()


def test_cut():
    for c in (64, 4096):
        for n in range(1, 3 * c):
            ps = P.cut(n, c)
            assert sum(x for x, _ in ps) == n and all(k * x <= c < (k + 1) * (x + 1) for x, k in ps)


def test_texts_and_padding(spark, plain):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [(900, None), (901, ""), (902, " \t\n"), (903, "It's <|endoftext|>A<|startoftext|> THE İΣς é́ x_1² \x1c a\xa0b"),
              (904, "word " * 9000), (None, "no id"), (905, "THE"), (906, "<|ENDOFTEXT|>"), (907, "ЖЁ 漢字 'LL")]
    rows = rows_of(spark, texts, part_pieces=100)
    n = check(rows, texts, plain, 4096)
    tokens = sum(r.length for r in rows)
    assert n * 4096 - tokens < 4096 + 0.01 * tokens


def test_repeated_rows_small_capacity_and_sequences(spark, plain):
    texts = [(i % 5, "alpha beta " * (i % 7)) for i in range(40)] + [(None, "q")] * 3
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = P.pack(df, PATH, capacity=64, keep_ids=True)
    rows = out.collect()
    want = sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
    assert sum(r.length for r in rows) == want
    seqs = {r.sequence_id: bytes(r.ids) for r in P.sequences(out).collect()}
    assert sum(len(x) for x in seqs.values()) == 4 * want and max(len(x) for x in seqs.values()) <= 256
    for r in rows:
        assert seqs[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def same_ids(texts, plain):
    enc = P.Encoder(PATH)
    for at in range(0, len(texts), 5000):
        part = texts[at:at + 5000]
        want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch_fast(part, add_special_tokens=False)]
        wrong = [t for t, a, b in zip(part, enc.encode(part), want) if a != b]
        assert not wrong, wrong[:5]


def test_every_letter_before_a_full_stop_or_comma(plain):
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    same_ids([f"{x}. b{x}, c" for x in letters], plain)
    same_ids(["DENİZİ. son", "İ.", "İ,", "i̇. x", "ŉ. ǰ, ẖ."], plain)


def test_random_odd_texts(plain):
    rng = np.random.default_rng(11)
    odd = list("abzASÉéßſİıŉǰΣς'.,;-_0179²½ \t\n\x0b\x1c\x85 ​́̇ͅạ 日本각가\U0001f389ﬁΩ")
    texts = ["".join(odd[k] for k in rng.integers(0, len(odd), n)) for n in rng.integers(1, 14, 100_000)]
    same_ids(texts, plain)


def test_the_tokenizer_gets_few_strings_at_once(monkeypatch):
    enc, seen = P.Encoder(PATH), []
    was = enc.cache.encode_batch
    monkeypatch.setattr(enc.cache, "encode_batch", lambda texts, **kw: seen.append(len(texts)) or was(texts, **kw))
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(400)]
    got = enc.encode(texts)
    assert sum(seen) * P.TOGETHER >= 20_000 and max(seen) <= P.BATCH
    tok = Tokenizer.from_file(PATH)
    assert all(np.frombuffer(got[i], "<u4").tolist() == tok.encode(texts[i], add_special_tokens=False).ids for i in (0, 7, 399))


def test_few_texts_of_a_batch_are_read_at_once(spark):
    texts = [None if i % 50 == 0 else f"text number {i}" for i in range(700)]
    df = spark.createDataFrame([(None if i % 70 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = P.pieces(df, PATH, keep_ids=True).collect()
    assert len(rows) == 700 and sum(r.doc_id is None for r in rows) == 10
    assert sum(r.doc_tokens == 1 for r in rows) == 14
    plan = P.pieces(df, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
