"""Prefix-target expansion: round trip, masks and digests against plain Python."""

import hashlib

from codeloom.llm import chat as C
from codeloom.llm.queries import QUERIES
from pyspark.sql import functions as F

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<s", "[INST", "<<SYS>> a <</SYS>>", "<|role|>x\ny<|end|>", "", " ", "\n\n", "é 漢 🎉\\[INST]",
         "a [/INST] b", "<|end|>", "\\n", "<</SYS>> [/INST]</s>"]


def rows_of():
    rows = []
    for i, a in enumerate(NASTY):
        rows += [(i, 0, "user", a), (i, 1, "assistant", NASTY[-i - 1]), (i, 2, "user", NASTY[(i * 3) % len(NASTY)])]
    rows += [(100, 0, "system", NASTY[5]), (100, 1, "user", "q"), (100, 2, "assistant", "r1"), (100, 3, "assistant", "r2\\"),
             (101, 0, "user", "only"), (102, 0, "assistant", "first"), (103, 1, "tool<s>\nb\\", "x<|end|>"), (103, 2, "assistant", "y"),
             (104, None, "user", None), (104, 1, None, "norole"), (105, 0, "assistant", "dup"), (105, 0, "assistant", "dup"),
             (None, 0, "user", "u"), (None, 1, "assistant", "v")]
    return rows + [(106, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 50) for t in range(60)]


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        said = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(), len(said),
                  hashlib.sha256(said.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, example int")


def test_digest_against_brute_force(spark):
    rows = rows_of()
    df = frame(spark, rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digest(C.examples(df.repartition(3))).collect()}
    assert got == brute(rows)


def test_one_example_per_reply_with_its_prefix(spark):
    ex = C.examples(frame(spark, rows_of()))
    for r in ex.where("conv_id = 106").collect():
        assert r.formatted[r.loss_start:r.loss_end] == f"turn {r.n_turns - 1} " * 50 and r.formatted.endswith("</s>")
    assert ex.where("conv_id = 106").count() == 30
    assert ex.where("conv_id = 101").select("loss_start").collect()[0][0] is None


def test_escape_hides_every_mark(spark):
    df = spark.createDataFrame([(x,) for x in NASTY + C.MARKS], "t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", C.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        for m in C.MARKS:
            at = r.e.find(m)
            while at >= 0:
                assert at and r.e[at - 1] == "\\"
                at = r.e.find(m, at + 1)


def test_query_and_empty(spark):
    got = QUERIES["op5_prefix_targets"](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0])]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == brute(rows)
    assert C.examples(frame(spark, rows_of()).limit(0)).count() == 0


def test_long_turns(spark):
    rows = [(n * 10 + k, t, role, x * (n // len(x))) for n in (5000, 10**5, 10**6) for k, x in enumerate(["q", "a </s>\\ [INST] <<SYS>> é"])
            for t, role in enumerate(["system", "user", "assistant", "tool"])]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digest(C.examples(frame(spark, rows))).collect()}
    assert got == brute(rows)
    role = [(1, 0, "r\n\\<|end|>" * 10**4, "x"), (1, 1, "assistant", "y")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digest(C.examples(frame(spark, role))).collect()}
    assert got == brute(role)
