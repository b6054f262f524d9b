"""Unified diff parsing (FIXTURES 3.3) and special texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.operators import text_tables as TT

DIFF = """--- a/x
+++ b/x
@@ -1,3 +1,4 @@
 ctx
-old
+new
+new2
@@ -10,3 +11,1 @@
-gone
--- sql comment
 tail"""


def blocks(spark, text, compat=False):
    df = spark.createDataFrame([(1, text)], "diff_id int, diff string")
    return sorted(TT.parse_diff_blocks(df, compat=compat).collect(), key=lambda r: r.block_no)


def test_default_mode(spark):
    b = blocks(spark, DIFF)
    assert len(b) == 2
    assert (b[0].removed, b[0].removed_line_numbers, b[0].added, b[0].added_line_numbers) == (
        ["old"], [2], ["new", "new2"], [2, 3])
    assert (b[1].removed, b[1].removed_line_numbers, b[1].added) == (["gone", "-- sql comment"], [10, 11], [])
    assert b[0].header == "@@ -1,3 +1,4 @@"


def test_compat_mode(spark):
    b = blocks(spark, DIFF, compat=True)
    assert (b[1].removed, b[1].removed_line_numbers) == (["gone"], [10])


def test_special_texts(spark):
    b = blocks(spark, "File was added in this commit:\n\na\nb")
    assert (b[0].header, b[0].added, b[0].added_line_numbers) == ("File was added in this commit:", ["a", "b"], [1, 2])
    b = blocks(spark, "Binary file (no text diff available)")
    assert b[0].header == "Binary file (no text diff available)" and b[0].added == [] and b[0].removed == []
    b = blocks(spark, "plain text")
    assert (b[0].header, b[0].added, b[0].added_line_numbers) == ("Changes", ["plain text"], [1])
    assert blocks(spark, "Error: nothing") == []


def walk(text, compat):
    """Line by line with two counters."""
    out, hunk, left, right = [], 0, 0, 0
    for i, line in enumerate(text.split("\n")):
        file_header = line.startswith(("---", "+++"))
        if line.startswith("@@"):
            hunk += 1
            m = re.search(r"@@ -(\d+),?\d* \+(\d+),?\d* @@", line)
            if m:
                left, right = int(m[1]), int(m[2])
            out.append((i, hunk, "header", line, None, None))
        elif file_header and (compat or hunk == 0):
            out.append((i, hunk, "skip", line, None, None))
        elif line.startswith("-"):
            out.append((i, hunk, "removed", line[1:], left, None))
            left += 1
        elif line.startswith("+"):
            out.append((i, hunk, "added", line[1:], None, right))
            right += 1
        else:
            out.append((i, hunk, "context", line, None, None))
            left, right = left + 1, right + 1
    return out


@pytest.mark.parametrize("compat", [False, True])
def test_counters_over_blocks_of_any_size(spark, compat):
    rnd = random.Random(4)
    line = ["@@ -5,2 +9 @@", "@@ -100 +200,7 @@ f()", "@@ broken", "--- a", "+++ b", "-x", "+y", " z", "", "-", "+", "---", "@@"]
    texts = ["\n".join(rnd.choices(line, weights=[w] + [1] * 12, k=rnd.randint(1, 60))) for w in (0, 1, 1, 3) for _ in range(15)]
    texts += ["\n".join(rnd.choices(line[3:12], k=40)) for _ in range(10)] + [DIFF]
    df = spark.createDataFrame(list(enumerate(texts)), "diff_id int, diff string")
    want = sorted((i, *r) for i, t in enumerate(texts) for r in walk(t, compat))
    for size in (1, 2, 7, 4096):
        got = TT.parse_diff_lines(df, compat=compat, block_lines=size).collect()
        assert sorted(tuple(r) for r in got) == want, size


def test_a_long_diff_is_many_tasks(spark, monkeypatch):
    held = []
    keep = TT.stored
    monkeypatch.setattr(TT, "stored", lambda df: held.append(keep(df)) or held[-1])
    text = F.concat(F.lit("@@ -1 +1 @@\n"), F.repeat(F.lit("-a\n+b\n c\n"), 333_333))
    df = spark.range(1).select(F.col("id").alias("diff_id"), text.alias("diff"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = TT.parse_diff_lines(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    r = out.agg(F.count("*"), F.max("left_no"), F.max("right_no")).first()
    assert tuple(r) == (1_000_001, 666_665, 666_665)
    assert out.where("kind = 'removed' and left_no = 2 * (idx - 1) / 3 + 1").count() == 333_333
    files = [r["count"] for r in held[0].groupBy(F.input_file_name()).count().collect()]
    assert len(files) > 4 and max(files) < 300_000
