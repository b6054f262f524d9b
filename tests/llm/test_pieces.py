"""The rebuilt tokenizer against the sentencepiece library: ids, decoding, odd texts."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from codeloom.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", " a", "a  b   c ", "line\nnext\n\n  x", "Hello, world!", "日本語 テキスト", "🎉🎉 é é ñ", "▁ a▁b▁▁c", "\t\ttab",
         "<s> </s> <unk> <0x41>", "x" * 3000, "\x00\x01", "a b c", "supercalifragilistic" * 20, "1234567890 3.14", " \n \n "]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_parity(sp):
    b = P.Backend(PATH)
    assert b.by_string
    want = sp.encode(TEXTS)
    assert [i.tolist() for i in b.encode(TEXTS)] == want
    assert [e.ids for e in b.tokenizer.encode_batch(TEXTS, add_special_tokens=False)] == want
    for ids in want:
        assert b.decode(np.array(ids, np.uint32)) == sp.decode(ids)
        assert b.tokenizer.decode(ids) == sp.decode(ids)


def test_unigram_model_is_rebuilt():
    def field(n, kind, v):
        return bytes([n << 3 | kind]) + (bytes([len(v)]) + v if kind == 2 else v)

    def piece(s, score, kind=1):
        return field(1, 2, field(1, 2, s.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind])))
    raw = b"".join([piece("<unk>", 0, 2), piece("▁", -3), piece("a", -4), piece("b", -4), piece("▁a", -2), piece("ab", -2.5), piece("▁ab", -1)])
    raw += field(2, 2, field(3, 0, bytes([1])))
    m = P.parse(raw)
    assert m.kind == P.UNIGRAM and m.squeeze and m.pieces[4][0] == "▁a" and abs(m.pieces[5][1] + 2.5) < 1e-6
    t = P.build(m)
    assert t.encode("ab  ab a", add_special_tokens=False).tokens == ["▁ab", "▁ab", "▁a"]


def test_table(spark, sp):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, None), (1, " ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = P.encode_table(df, PATH).collect()
    assert len(got) == len(rows) and all(r.parity for r in got)
    want = sorted((str(i), sp.encode(t or ""), (t or "").replace("▁", " ")) for i, t in rows)
    assert sorted((str(r.id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got) == want
    assert P.encode_table(df.limit(0), PATH).count() == 0


def test_documents_round_trip(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = P.encode_table(df, PATH).join(df.select("doc_id", "text"), P.F.col("id") == P.F.col("doc_id"))
    assert got.where("not parity or decoded != text").count() == 0 and got.count() == df.count()
