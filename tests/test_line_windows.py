"""Declarations and their context windows against a walk over the lines, for spans of any size."""

import random
import re

from codeloom.operators import text_tables as TT

FUNCTION = [r"\bfunction\s+(\w+)\b", r"\b(\w+)\s*[:=]\s*function\b", r"\bdef\s+(\w+)\b"]


def brute(files, flags=0):
    out = []
    for path, text in files:
        lines = (text or "").splitlines()
        for i, line in enumerate(lines):
            fn = dict.fromkeys(n for p in FUNCTION for n in re.findall(p, line, flags))
            cl = dict.fromkeys(n for n in re.findall(r"\bclass\s+(\w+)\b", line, flags) if n not in fn)
            for names, kind, after in ((fn, "function", 20), (cl, "class", 50)):
                out += [(path, n, kind, i + 1, line.strip(), "\n".join(lines[max(0, i - 1):i + after])) for n in names]
    return sorted(out)


def test_windows_are_cut_in_the_row(spark):
    rnd = random.Random(8)
    words = ["function a() {", "  class B {", "x = function (y) {", "def f; class f", "é: function() class Ünï", "", "plain", "CLASS Big", "functional", " }"]
    texts = ["\n".join(rnd.choices(words, k=n)) for n in (1, 2, 9, 10, 11, 60, 150)] + ["class Z", "\n\nclass Z\n", "no keyword\nhere", "", "a\r\nclass Q\r\n"]
    files = [(f"f{i}.js", t) for i, t in enumerate(texts)]
    rows = [("r", p, t, False) for p, t in files] + [("r", "x.py", "class A", False), ("r", "b.js", "class A", True), ("r", "n.js", None, False)]
    df = spark.createDataFrame(rows, "repository_id string, path string, content string, binary boolean")
    for span in (1, 7, 10, 1000):
        got = TT.regex_symbols(df, span=span).collect()
        assert sorted(tuple(r)[1:] for r in got) == brute(files), span
    got = TT.regex_symbols(df, case_insensitive=True, span=10).collect()
    assert sorted(tuple(r)[1:] for r in got) == brute(files, re.I)
    names = spark.createDataFrame([("a",), ("B",), ("none",)], "name string")
    got = TT.regex_symbols(df, names, first_per_file=True, span=7)
    first = {}
    for r in brute(files):
        if r[1] in ("a", "B") and r[3] < first.get((r[0], r[1]), (0, 0, 0, 10 ** 9))[3]:
            first[(r[0], r[1])] = r
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(first.values())
    joins = TT.regex_symbols(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in joins and "Exchange" not in joins
