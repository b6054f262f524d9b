"""Python symbol table, complexity and maintainability (FIXTURES 3.1, 3.2, U7)."""

import math

from pyspark.sql import functions as F

from codeloom.operators import aggregates as A
from codeloom.operators import symbols as SY

SRC = '''import os as o
from pkg.mod import thing
from . import sib

LIMIT = 3

class Base:
    pass

class Child(Base, x.Other):
    """doc"""
    def run(self, n, *rest):
        y = n
        return y

@deco
def top(a, b=1):
    if a and b:
        return a
    return [i for i in b if i]

async def skipped():
    pass
'''


def files_df(spark, rows):
    return spark.createDataFrame([(r, p, False, c) for r, p, c in rows],
                                 "repository_id string, path string, binary boolean, content string")


def test_python_symbols_fixture(spark):
    df = SY.python_symbols(files_df(spark, [("r", "m.py", SRC), ("r", "bad.py", "def (:\n")]))
    rows = {(r.kind, r.name, r.line_start): r for r in df.collect()}
    assert ("import", "os", 1) in rows and rows[("import", "os", 1)].alias == "o"
    assert ("import", "pkg.mod.thing", 2) in rows and ("import", "sib", 3) in rows
    assert rows[("variable", "LIMIT", 5)].code_id == "var_LIMIT_5"
    assert rows[("variable", "y", 13)].code_id == "var_y_13"
    assert rows[("class", "Base", 7)].bases == [] and rows[("class", "Base", 7)].line_end == 8
    child = rows[("class", "Child", 10)]
    assert child.bases == ["Base"] and child.docstring == "doc" and child.line_end == 14
    m = rows[("method", "run", 12)]
    assert m.parent == "Child" and m.args == ["self", "n"] and m.complexity == 1
    assert m.code_id == "method_Child_run_12"
    assert ("function", "run", 12) in rows
    top = rows[("function", "top", 17)]
    assert top.line_end == 20 and top.complexity == 5 and top.code_id == "func_top_17"
    assert not any(k[1] == "skipped" for k in rows)
    err = [r for r in df.collect() if r.path == "bad.py"]
    assert len(err) == 1 and err[0].kind == "module" and err[0].error.startswith("SyntaxError")


def test_async_flag(spark):
    df = SY.python_symbols(files_df(spark, [("r", "m.py", SRC)]), include_async=True)
    assert df.where((F.col("name") == "skipped") & (F.col("kind") == "function")).count() == 1


def test_maintainability_formula(spark):
    df = spark.createDataFrame([(50.0, 3.0, 10.0, 2.0)], "v double, g double, l double, c double")
    mi = df.select(SY.maintainability(F.col("v"), F.col("g"), F.col("l"), F.col("c"))).first()[0]
    assert math.isclose(mi, 89.065853, abs_tol=1e-6)


def test_technical_debt_mini_repo(spark):
    a_py = "def f(x):\n    if x:\n        for i in x:\n            pass\n"
    t_py = "def test_a():\n    assert True\n"
    rows = [("r", p, c) for p, c in [
        ("README.md", "# r"), ("src/a.py", a_py), ("src/__init__.py", ""), ("tests/test_a.py", t_py),
        ("logo.png", None), ("src/b.go", "package b"), ("src/c.rb", "x"), ("Makefile", "all:"),
        ("package.json", "{}"), ("data.csv", "a,b")]]
    files = spark.createDataFrame([(r, p, p.endswith(".png"), c) for r, p, c in rows],
                                  "repository_id string, path string, binary boolean, content string")
    sym = SY.python_symbols(files)
    fm = SY.function_metrics(sym).where(F.col("kind") == "function")
    scores = A.function_summary(files, fm).withColumn("maintainability", F.lit(None).cast("double"))
    cx = {r.path: r.complexity for r in scores.collect()}
    assert cx["src/a.py"] == 3 and cx["tests/test_a.py"] == 1
    debt, top = A.technical_debt(files, scores)
    d = debt.first()
    assert (d.code_complexity, d.documentation, d.test_coverage, d.score) == (20.0, 50.0, 50.0, 38.0)
    assert [r.path for r in top.orderBy("rank").collect()] == ["src/a.py", "tests/test_a.py"]
    lang = A.detect_language(files).first().language
    assert lang == "JavaScript/TypeScript"
    lang2 = A.detect_language(files.where(F.col("path") != "package.json")).first().language
    assert lang2 == "Python"


def test_empty_repo_debt():
    assert A.empty_repo_debt()["score"] == 60.0


def test_deep_files_do_not_fail_the_job(spark):
    deep = {"plus.py": "def f():\n    return " + " + ".join(["1"] * 3000),
            "elif.py": "def g(x):\n    if x == 0:\n        pass\n" + "".join(f"    elif x == {i}:\n        pass\n" for i in range(1500)),
            "chain.py": "x = a" + ".b()" * 1500, "ok.py": "def h():\n    pass\n"}
    files = spark.createDataFrame([("r", p, False, c) for p, c in deep.items()], "repository_id string, path string, binary boolean, content string")
    rows = SY.python_symbols(files).select("path", "kind", "name", "complexity", "error").collect()
    assert {r.path for r in rows} == set(deep)
    for path in deep:
        own = [r for r in rows if r.path == path]
        assert any(r.error for r in own) or any(r.kind == "module" for r in own)
    assert any(r.name == "h" for r in rows)


def test_metrics_of_every_analysable_file(spark):
    files = files_df(spark, [("r", "a.py", "def f():\n    return 1\n"), ("r", "bad.py", "def (:\n"), ("r", "b.js", "// c\nx = 1\n"),
                             ("r", "C.java", ""), ("r", "empty.py", ""), ("r", "n.md", "text"), ("r", "gone.c", None)])
    got = {r.path: (r.lines_of_code, r.cyclomatic_complexity, r.comment_ratio)
           for r in SY.file_metrics(files, SY.python_symbols(files)).collect()}
    assert got == {"a.py": (2, 1.0, 0.0), "bad.py": (1, None, 0.0), "b.js": (1, None, 1.0), "C.java": (0, None, 0.0), "empty.py": (0, 0.0, 0.0)}
    raw = {r.path: (r.loc, r.sloc) for r in SY.raw_metrics(files.where(F.col("content").isNotNull())).collect()}
    assert raw["C.java"] == (0, 0) and raw["n.md"] == (1, 1) and len(raw) == 6


def test_search_finds_every_language_and_class_methods(spark):
    files = files_df(spark, [("r", "m.py", SRC), ("r", "a.js", "function top(x) {\n}\nclass Child {\n}\n")])
    names = spark.createDataFrame([("top",), ("Child",), ("run",)], "name string")
    rows = SY.search_symbols(names, SY.python_symbols(files), files=files).collect()
    assert sorted((r.path, r.kind, r.name, r.signature) for r in rows if r.name != "Child") == [
        ("a.js", "function", "top", "function top(x) {"), ("m.py", "function", "run", "def run(self, n)"),
        ("m.py", "function", "top", "def top(a, b)"), ("m.py", "method", "run", "def run(self, n)")]
    child = {r.path: r.methods for r in rows if r.name == "Child"}
    assert child["a.js"] is None and [(m.name, m.line_start, m.signature) for m in child["m.py"]] == [("run", 12, "def run(self, n)")]
