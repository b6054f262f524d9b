"""Python code tables: the only Python-worker stage.

One ``mapInPandas`` pass parses each ``.py`` file with the standard-library
``ast`` and emits flat rows: functions, methods, classes, variables, imports
and one ``module`` row per file (Halstead volume, total complexity, parse
error).  Everything after that - joins, averages, maintainability, search - is
built-in Spark.  The ``.py`` / non-binary filter and the projection to
``(repository_id, path, content)`` are applied *before* the Python boundary,
and rows are spread by (repository, path) hash so a huge repository does not
land in one task.
"""

from __future__ import annotations

import ast
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPO = "repository_id"

SYMBOL_ROW = T.StructType([
    T.StructField("repository_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("bases", T.ArrayType(T.StringType())),
    T.StructField("alias", T.StringType()),
    T.StructField("docstring", T.StringType()),
    T.StructField("code_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("complexity", T.IntegerType()),
    T.StructField("halstead_volume", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("methods", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("signature", T.StringType()),
    ]))),
])


# --- per-file helpers (run inside the Python worker) ------------------------------------

FLUSH_CHARS = 1 << 20
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _branches(node) -> int:
    """What one node adds to the complexity of its function."""
    if isinstance(node, (ast.If, ast.IfExp)):
        return 1
    if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
        return 2 if node.orelse else 1
    if isinstance(node, (ast.Try, ast.TryStar)):
        return len(node.handlers) + bool(node.orelse)
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    if isinstance(node, ast.match_case):
        return 0 if isinstance(node.pattern, ast.MatchAs) and node.pattern.pattern is None and node.pattern.name is None else 1
    return 0


def function_complexity(node) -> int:
    """Cyclomatic complexity of one function body; nested functions and classes are rows of their own.

    A work list instead of recursion, so nesting depth does not matter.
    """
    total, todo = 1, list(node.body)
    while todo:
        n = todo.pop()
        if not isinstance(n, _SCOPES):
            total += _branches(n)
            todo.extend(ast.iter_child_nodes(n))
    return total


def halstead_volume(tree) -> float:
    """Halstead volume N*log2(eta) over operators/operands of operations in the module."""
    ops, opnds = [], []

    def operand(n):
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Constant):
            return repr(n.value)
        if isinstance(n, ast.Attribute):
            return n.attr
        return type(n).__name__

    for n in ast.walk(tree):
        if isinstance(n, ast.BinOp):
            ops.append(type(n.op).__name__)
            opnds += [operand(n.left), operand(n.right)]
        elif isinstance(n, ast.AugAssign):
            ops.append(type(n.op).__name__)
            opnds += [operand(n.target), operand(n.value)]
        elif isinstance(n, ast.UnaryOp):
            ops.append(type(n.op).__name__)
            opnds.append(operand(n.operand))
        elif isinstance(n, ast.BoolOp):
            ops += [type(n.op).__name__] * (len(n.values) - 1)
            opnds += [operand(v) for v in n.values]
        elif isinstance(n, ast.Compare):
            ops += [type(o).__name__ for o in n.ops]
            opnds += [operand(n.left)] + [operand(c) for c in n.comparators]
    eta = len(set(ops)) + len(set(opnds))
    big_n = len(ops) + len(opnds)
    return float(big_n * math.log2(eta)) if eta > 1 else 0.0


def _segment(lines, start, end):
    return "\n".join(lines[start - 1:end])


def parse_python(repo, path, content, include_async=False, top_level_only=False):
    """Rows for one file, as dicts of SYMBOL_ROW; a file that cannot be analysed yields one error row."""
    try:
        return _parse(repo, path, content, include_async, top_level_only)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        empty = dict.fromkeys(f.name for f in SYMBOL_ROW.fields)
        return [empty | {"repository_id": repo, "path": path, "kind": "module", "error": f"{type(e).__name__}: {e}"}]


def _parse(repo, path, content, include_async, top_level_only):
    rows = []

    def row(kind, name, **kw):
        r = {"repository_id": repo, "path": path, "kind": kind, "name": name, "parent": None,
             "line_start": None, "line_end": None, "args": None, "bases": None, "alias": None,
             "docstring": None, "code_id": None, "source": None, "complexity": None,
             "halstead_volume": None, "error": None, "methods": None}
        r.update(kw)
        rows.append(r)

    tree = ast.parse(content)
    lines = content.splitlines()
    func_types = (ast.FunctionDef, ast.AsyncFunctionDef) if include_async else (ast.FunctionDef,)
    nodes = ast.iter_child_nodes(tree) if top_level_only else ast.walk(tree)
    total_cc = 0
    for node in nodes:
        if isinstance(node, func_types):
            s, e = node.lineno, node.end_lineno
            cc = function_complexity(node)
            total_cc += cc
            row("function", node.name, line_start=s, line_end=e, args=[a.arg for a in node.args.args],
                docstring=ast.get_docstring(node), code_id=f"func_{node.name}_{s}", source=_segment(lines, s, e),
                complexity=cc)
        elif isinstance(node, ast.ClassDef):
            s, e = node.lineno, node.end_lineno
            row("class", node.name, line_start=s, line_end=e,
                bases=[b.id for b in node.bases if isinstance(b, ast.Name)],
                docstring=ast.get_docstring(node), code_id=f"class_{node.name}_{s}", source=_segment(lines, s, e),
                methods=[{"name": m.name, "line_start": m.lineno, "line_end": m.end_lineno,
                          "signature": f"def {m.name}({', '.join(a.arg for a in m.args.args)})"}
                         for m in node.body if isinstance(m, func_types)])
            for item in node.body:
                if isinstance(item, func_types):
                    ms, me = item.lineno, item.end_lineno
                    row("method", item.name, parent=node.name, line_start=ms, line_end=me,
                        args=[a.arg for a in item.args.args], docstring=ast.get_docstring(item),
                        code_id=f"method_{node.name}_{item.name}_{ms}", source=_segment(lines, ms, me),
                        complexity=function_complexity(item))
        elif isinstance(node, ast.Assign) and node.lineno == node.end_lineno:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    ln = node.lineno
                    row("variable", t.id, line_start=ln, line_end=ln, code_id=f"var_{t.id}_{ln}",
                        source=lines[ln - 1] if ln - 1 < len(lines) else None)
        elif isinstance(node, ast.Import):
            for a in node.names:
                row("import", a.name, alias=a.asname, line_start=node.lineno, line_end=node.lineno)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                name = f"{node.module}.{a.name}" if node.module else a.name
                row("import", name, parent="." * node.level or None, alias=a.asname, line_start=node.lineno, line_end=node.lineno)
    row("module", None, complexity=total_cc, halstead_volume=halstead_volume(tree))
    return rows


# --- Spark operators -------------------------------------------------------------------------

def python_symbols(files: DataFrame, include_async: bool = False, top_level_only: bool = False) -> DataFrame:
    """U2 (+U5 complexity, U7 Halstead input): the flat symbol table of every Python file."""
    import pandas as pd

    src = (files.where(F.col("path").endswith(".py") & ~F.col("binary") & F.col("content").isNotNull())
           .select(REPO, "path", "content")
           .repartition(REPO, "path"))
    names = [f.name for f in SYMBOL_ROW.fields]

    def run(batches):
        for pdf in batches:
            out, size = [], 0
            for repo, path, content in zip(pdf[REPO], pdf["path"], pdf["content"]):
                out.extend(parse_python(repo, path, content, include_async, top_level_only))
                size += len(content)
                if size > FLUSH_CHARS:      # a batch of large files is not held at once
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    return src.mapInPandas(run, SYMBOL_ROW)


def function_metrics(symbols: DataFrame) -> DataFrame:
    """Complexity per function and method, with its line number."""
    return symbols.where(F.col("kind").isin("function", "method")).select(
        REPO, "path", "kind", "name", "parent", F.col("line_start").alias("line_number"), "complexity")


def raw_metrics(files: DataFrame) -> DataFrame:
    """Source lines (non-blank, non-comment), comment lines and their ratio per file.

    Lines are exploded and counted with ``count_if`` (JVM only).  An empty or missing content counts zero lines.
    """
    from codeloom.functions import exprs as X
    from codeloom.functions import text as TX
    lines = files.select(REPO, "path", F.explode_outer(TX.splitlines(F.col("content"))).alias("line"))
    s = X.py_strip(F.col("line"))
    is_comment = s.startswith("#") | s.startswith("//") | s.startswith("/*") | s.startswith("*")
    per = lines.groupBy(REPO, "path").agg(
        F.count_if((s != "") & ~is_comment).alias("sloc"), F.count_if(is_comment).alias("comments"),
        F.count_if(s == "").alias("blank"), F.count("line").alias("loc"))
    return per.select(REPO, "path", F.col("loc").cast("long"), F.col("sloc").cast("long"),
                      F.col("comments").cast("long"), F.col("blank").cast("long"),
                      F.when(F.col("sloc") > 0, F.col("comments") / F.col("sloc")).otherwise(F.lit(0.0))
                      .alias("comment_ratio"))


def maintainability(volume, complexity, sloc, comments):
    """U7 as a column expression: max(0, 100*(171 - 5.2 lnV - .23 G - 16.2 lnL + 50 sin(sqrt(2.4 C)))/171).

    C is the comment share of sloc in percent, taken as degrees and converted to radians.
    L = 0 or V = 0 give 100.
    """
    c_pct = F.when(sloc > 0, comments * 100.0 / sloc).otherwise(F.lit(0.0))
    raw = (171 - 5.2 * F.log(volume) - 0.23 * complexity - 16.2 * F.log(sloc)
           + 50 * F.sin(F.sqrt(2.4 * F.radians(c_pct))))
    mi = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171))
    return F.when((volume <= 0) | (sloc <= 0), F.lit(100.0)).otherwise(mi)


def file_metrics(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A5: lines_of_code, average cyclomatic complexity, maintainability and comment ratio per analysable file.

    Files without a Python module row (other languages) and unparsable files get a null complexity and
    maintainability.  Empty files are rows too; binary and unreadable ones are not.
    """
    from codeloom.functions import exprs as X
    # each def once: methods are also listed as functions by the walk
    fm = (function_metrics(symbols).where(F.col("kind") == "function")
          .groupBy(REPO, "path").agg(F.avg("complexity").alias("cyclomatic_complexity")))
    mod = symbols.where(F.col("kind") == "module").select(REPO, "path", F.col("complexity").alias("total_complexity"),
                                                          "halstead_volume", "error")
    analysable = X._any_suffix(F.col("path"), X.ANALYZABLE_EXTENSIONS) & ~F.col("binary") & F.col("content").isNotNull()
    j = raw_metrics(files.where(analysable)).join(mod, [REPO, "path"], "left").join(fm, [REPO, "path"], "left")
    parsed = F.col("total_complexity").isNotNull() & F.col("error").isNull()
    return j.select(
        REPO, "path", F.col("sloc").alias("lines_of_code"),
        F.when(parsed, F.coalesce("cyclomatic_complexity", F.lit(0.0))).alias("cyclomatic_complexity"),
        F.when(parsed, maintainability(F.col("halstead_volume"), F.col("total_complexity"), F.col("sloc"),
                                       F.col("comments"))).alias("maintainability_index"),
        "comment_ratio", "error")


def search_symbols(names: DataFrame, symbols: DataFrame, kind: str = "any", files: DataFrame | None = None) -> DataFrame:
    """U4: requested names x (Python symbols U2 union regex symbols U3 of the other ``files``).

    Class rows of Python files carry their methods.  The signature of a regex symbol is its line.
    """
    from codeloom.operators import text_tables as TT
    s = symbols.where(F.col("kind").isin("function", "class", "method"))
    sig = F.when(F.col("kind").isin("function", "method"),
                 F.concat(F.lit("def "), F.col("name"), F.lit("("), F.array_join(F.coalesce("args", F.array()), ", "),
                          F.lit(")")))
    s = s.withColumn("signature", F.coalesce(sig, F.col("signature")) if "signature" in s.columns else sig)
    if files is not None:
        s = s.unionByName(TT.regex_symbols(files, names), allowMissingColumns=True)
    if kind != "any":
        s = s.where(F.col("kind") == kind)
    return names.join(s, "name")
