"""Scalar expressions and text extraction (FIXTURES 3.4)."""

from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.functions import text as T
from codeloom.operators import text_tables as TT


def one_col(spark, values, expr, name="v"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return [r[0] for r in df.select(expr(F.col(name))).collect()]


def test_file_ext_matches_splitext(spark):
    vals = [".bashrc", "a.tar.gz", "a.", "..x", ".a.b", "Makefile", "x.PY", "dir.d/file"]
    import os
    assert one_col(spark, vals, X.file_ext) == [os.path.splitext(v.split("/")[-1])[1] for v in vals]


def test_change_type(spark):
    assert one_col(spark, ["A", "D", "R", "R100", "M", "T"], X.change_type) == [
        "added", "deleted", "renamed", "modified", "modified", "modified"]


def test_shortstat(spark):
    texts = [" 3 files changed, 10 insertions(+), 2 deletions(-)", " 1 file changed, 1 deletion(-)", " a | Bin"]
    out = one_col(spark, texts, X.parse_shortstat)
    assert [tuple(r) for r in out] == [(3, 10, 2), (1, 0, 1), (0, 0, 0)]


def test_normalize_hash(spark):
    assert one_col(spark, ["#abc-123z", "zz"], X.normalize_hash) == ["abc123", None]


def test_display_repo_name(spark):
    vals = ["tool_owner/repo", "tool_name.git", "", "plain.git", "a/b.git"]
    out = one_col(spark, vals, lambda c: X.display_repo_name(c, tool_prefix="tool_"))
    assert out == ["repo", "name", "Unknown Repository", "plain", "b.git"]


def test_important_root_anchored(spark):
    paths = ["README.md", "src/a.py", "src/__init__.py", "tests/test_a.py", "logo.png", "src/b.go", "src/c.rb",
             "Makefile", "package.json", "data.csv", "web/package.json", ".github/workflows/ci.yml"]
    out = one_col(spark, paths, X.is_important)
    got = {p for p, ok in zip(paths, out) if ok}
    assert got == {"README.md", "src/a.py", "src/__init__.py", "tests/test_a.py", "src/b.go", "package.json",
                   ".github/workflows/ci.yml"}
    hidden = one_col(spark, paths, X.is_hidden)
    assert [p for p, h in zip(paths, hidden) if h] == [".github/workflows/ci.yml"]


def test_hash_refs(spark):
    txt = "Commit ABCDEF1 and 1234567 defaced"
    assert one_col(spark, [txt], T.hash_ref_first) == ["ABCDEF1"]
    assert one_col(spark, [txt], T.hash_refs_all)[0] == ["ABCDEF1", "1234567", "defaced"]


def test_code_elements_unicode(spark):
    out = one_col(spark, ["show me Größe and function foo class Bar"], T.code_elements)[0]
    assert out == ["foo", "Bar", "Größe"]


def test_code_paths(spark):
    txt = "see ```python:src/a.py\nx\n``` and ```js lib/b.js\n```"
    assert one_col(spark, [txt], T.code_paths)[0] == ["src/a.py", "and", "lib/b.js"]


def test_splitlines(spark):
    texts = ["a\nb\n", "a\r\nb\x0cc", "", "x"]
    out = one_col(spark, texts, T.splitlines)
    assert out == [t.splitlines() for t in texts]


def test_py_strip(spark):
    vals = ["  a b \n", "\t x ", "\n"]
    assert one_col(spark, vals, X.py_strip) == [v.strip() for v in vals]


def test_truncate_and_band(spark):
    assert one_col(spark, ["abcdef", "ab"], lambda c: X.truncate_text(c, 3)) == ["abc...", "ab"]
    df = spark.createDataFrame([(11.0,), (6.0,), (5.0,)], "c double")
    assert [r[0] for r in df.select(X.complexity_band(F.col("c"))).collect()] == ["High", "Medium", "Low"]


def test_readme_short_is_whole_text(spark):
    files = spark.createDataFrame(
        [("r", "README.md", "# Project Title\n\nThis is a test project.\n\nMore details here.")],
        "repository_id string, path string, content string")
    out = TT.readme_summary(files).collect()[0]["summary"]
    assert out == "# Project Title\n\nThis is a test project.\n\nMore details here."


def test_readme_long_sections(spark):
    body = "intro text\n" + "x" * 1600 + "\n# About X\nabout body\n## C# is fine\nmore\n## Usage\nuse it"
    files = spark.createDataFrame([("r", "README.md", body)], "repository_id string, path string, content string")
    out = TT.readme_summary(files).collect()[0]["summary"]
    assert "\n\n## about x\nabout body..." in out
    assert "\n\n## usage\nuse it..." in out
    none = spark.createDataFrame([("r", "main.py", "x")], "repository_id string, path string, content string")
    assert TT.readme_summary(none).collect()[0]["summary"] == "No README found"
