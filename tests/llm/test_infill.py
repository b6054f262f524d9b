"""Fill-in-the-middle examples against a plain scan over characters."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import infill as I

SPACE = " \t\n\x0b\x0c\r"


def units(text):
    """Ends of units by walking the characters."""
    ends, i = [], 0
    while i < len(text):
        while i < len(text) and text[i] in SPACE:
            i += 1
        while i < len(text) and text[i] not in SPACE:
            i += 1
        ends.append(i)
    return ends


def brute(doc_id, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    ends = [0] + units(text)
    n = len(ends) - 1
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:ends[a]], text[ends[a]:ends[b]], text[ends[b]:]
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


ODD = ["", " ", "a", " a", "a ", "a  b\tc\n", "  ", "   x", "日本 語\U0001f389 é", "x<P>y", "<S>", "a <M", "< P>",
       "<", "a< b<P c<S d<M e", "\x1c a\x85b", None]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(SPACE + "ab<>PSM 日\U0001f389"))), st.integers(-10, 10 ** 6))
def test_transform(text, doc_id):
    assert I.transform(text, str(doc_id)) == brute(doc_id, text)


def test_very_long_texts():
    for text in ("a" * 3_000_000, " " * 3_000_000, "ab " * 1_000_000, "x" + " " * 2_000_000 + "y"):
        assert I.unit_ends(text) == units(text)


def test_table(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 12)] + [(None, "no id at all"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, form string, n int")
    got = I.infill(df).withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), r[-1], str(r))
    want = sorted(((i, *brute(i, t), t or "") for i, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert I.infill(df.limit(0)).count() == 0


def test_documents_round_trip(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = I.infill(df).join(df.select("doc_id", "text"), F.col("id") == F.col("doc_id"))
    assert got.where(I.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert {r[0]: tuple(r)[1:6] for r in got.collect()} == {r[0]: brute(r[0], r[1]) for r in df.select("doc_id", "text").collect()}
