"""Proxy views: the driver's test tables seen as the repository model.

The test tables are not repositories, so each model table is a deterministic
projection of one of them (SURVEY 7.3).  The same formulas are written as SQL
in :mod:`codeloom.plans.oracle` so DuckDB can recompute every result.

* ``raw_tree``   <- documents   (one file per document, S1 turns it into ``files``)
* ``commits``    <- orders      (one commit per order)
* ``file_changes`` <- lineitem  (one change per line item)
* ``messages``   <- conversations
* ``questions``  <- benchmark   (a batch of questions is a table)
* ``vectors``    <- embeddings
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import exprs as X

# Fixed naming rules of the proxy (ours; mirrored in the oracle SQL).
PROXY_EXTS = [".py", ".md", ".js", ".txt", ".java", ".png", ".ts", ".go", "", ".c"]
PROXY_DIRS = ["", "src/", "src/core/", "tests/", "docs/", ".config/"]
PROXY_ROOT_NAMES = ["package.json", "README.md", "requirements.txt"]  # doc_id < 20, by doc_id % 4
N_REPOS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(idx: Column, values: list) -> Column:
    out = F.when(idx == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(idx == i, F.lit(v))
    return out


def doc_dir(doc_id: Column) -> Column:
    return _pick(doc_id % len(PROXY_DIRS), PROXY_DIRS)


def doc_ext(doc_id: Column) -> Column:
    return _pick(doc_id % len(PROXY_EXTS), PROXY_EXTS)


def doc_special(doc_id: Column) -> Column:
    """Root marker / README name for the first document of a repository, else null."""
    return F.when(doc_id < N_REPOS, _pick(doc_id % 4, PROXY_ROOT_NAMES + [None]))


def doc_path(doc_id: Column) -> Column:
    special = doc_special(doc_id)
    return F.coalesce(special, F.concat(doc_dir(doc_id), F.lit("m"), doc_id.cast("string"), doc_ext(doc_id)))


def module_name(doc_id: Column) -> Column:
    """Python module name of the proxy file of ``doc_id`` (hidden dir loses its dot)."""
    d = F.regexp_replace(F.regexp_replace(doc_dir(doc_id), r"\.", ""), "/", ".")
    return F.concat(d, F.lit("m"), doc_id.cast("string"))


def python_source(doc_id: Column, text: Column, n_chars: Column) -> Column:
    """Known-answer Python module: the document as a comment block, then code.

    Complexity of ``f_<id>`` is 1 + (id % 4); the class inherits from the
    module 20 documents earlier (same repository) so edges resolve.
    """
    i = doc_id.cast("string")
    k = (doc_id % 4).cast("int")
    prev = (doc_id - N_REPOS)
    comment = F.concat(F.lit("# "), F.regexp_replace(text, "\n", "\n# "), F.lit("\n"))
    imp = F.when(doc_id >= N_REPOS, F.concat(F.lit("import "), module_name(prev))).otherwise(F.lit("import sys"))
    doc = F.when(doc_id % 3 == 0, F.concat(F.lit('    """Doc '), i, F.lit('."""\n'))).otherwise(F.lit(""))
    base = F.when(doc_id >= N_REPOS, F.concat(F.lit("C_"), prev.cast("string"))).otherwise(F.lit("object"))
    return F.concat(
        comment,
        F.lit("import os\n"), imp, F.lit("\n\n"),
        F.lit("LIMIT_"), i, F.lit(" = "), n_chars.cast("string"), F.lit("\n\n"),
        F.lit("def f_"), i, F.lit("(a, b):\n"), doc,
        F.lit("    total = a\n"),
        F.repeat(F.lit("    if a > 0:\n        total += b\n"), k),
        F.lit("    return total\n\n"),
        F.lit("class C_"), i, F.lit("("), base, F.lit("):\n"),
        F.lit("    def run(self, n):\n        return n\n"),
    )


def js_source(doc_id: Column, text: Column) -> Column:
    """Known-answer JavaScript tail: one declaration of each shape the regex scanner knows."""
    i = doc_id.cast("string")
    return F.concat(text, F.lit("\n\nfunction g_"), i, F.lit("(x) {\n  return x;\n}\nconst h_"), i,
                    F.lit(" = function (y) {\n  return y;\n};\nclass K_"), i, F.lit(" {\n}\n"))


def raw_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of every file as a clone would hold it: (repository_id, path, doc_id, text, size)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    path = doc_path(F.col("doc_id"))
    return d.select(
        F.col("source").alias("repository_id"),
        path.alias("path"),
        F.col("doc_id"),
        F.when(path.endswith(".py"), python_source(F.col("doc_id"), F.col("text"), F.col("n_chars")))
         .when(path.endswith(".js"), js_source(F.col("doc_id"), F.col("text")))
         .otherwise(F.col("text")).alias("text"),
        F.col("n_chars").alias("size"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 applied to the proxy listing."""
    from codeloom.sources.corpus import scan_files
    return scan_files(raw_tree(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str):
    """Two states of the proxy tree for X1/X3: some files dropped, edited or moved in the new one."""
    f = files(spark, sf_dir).select("repository_id", "path", "doc_id", "content")
    old = f.where(F.col("doc_id") % 11 != 3)
    moved = F.col("doc_id") % 17 == 0
    edited = F.col("doc_id") % 13 == 0
    new = f.where(F.col("doc_id") % 11 != 5).select(
        "repository_id",
        F.when(moved, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        "doc_id",
        F.when(edited & ~moved, F.concat(F.col("content"), F.lit("\nedited line\n"))).otherwise(F.col("content"))
         .alias("content"))
    return old, new


def unified_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unified diff per document: line kinds chosen by the line's first letter.

    [A-C,E-M] removed, [N-Z] added, D a removed line that starts with '--',
    anything else context; one hunk header whose start lines depend on doc_id.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.regexp_replace(F.col("text"), "(?m)^", " ")
    body = F.regexp_replace(body, "(?m)^ ([A-CE-M])", "-$1")
    body = F.regexp_replace(body, "(?m)^ ([N-Z])", "+$1")
    body = F.regexp_replace(body, "(?m)^ (D)", "---$1")
    p = doc_path(F.col("doc_id"))
    diff = F.concat(F.lit("--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n@@ -"),
                    (F.col("doc_id") % 50 + 1).cast("string"), F.lit(",3 +"),
                    (F.col("doc_id") % 40 + 1).cast("string"), F.lit(",3 @@\n"), body)
    return d.select(F.col("doc_id").alias("diff_id"), diff.alias("diff"))


def commits(spark: SparkSession, sf_dir: str, with_seq: bool = True) -> DataFrame:
    """One commit per order; ``seq`` (0 = newest per repository) only when asked for, since its
    distributed computation cannot be pruned away by the optimizer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                                              "o_orderstatus")
    key = F.col("o_orderkey").cast("string")
    c = o.select(
        F.concat(F.lit("src"), (F.col("o_custkey") % N_REPOS).cast("string")).alias("repository_id"),
        F.md5(key).alias("hash"),
        F.concat(F.lit("dev"), F.col("o_custkey").cast("string")).alias("author_name"),
        F.concat(F.lit("dev"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("author_email"),
        F.col("o_orderdate").alias("author_ts"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" update for order "), key,
                 F.lit("\nstatus "), F.col("o_orderstatus"), F.lit("\n")).alias("message"),
    )
    if not with_seq:
        return c
    # history position without one task per repository (see codeloom.operators.ordered)
    from codeloom.operators.ordered import month_bucket, ordered_position
    return ordered_position(c, ["repository_id"], [F.col("author_ts").desc(), F.col("hash").desc()],
                            month_bucket(F.col("author_ts")), descending=True, name="seq")


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per line item; repository from the order it belongs to."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                                 "l_returnflag")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    j = li.join(o, "l_orderkey")
    return j.select(
        F.concat(F.lit("src"), (F.col("o_custkey") % N_REPOS).cast("string")).alias("repository_id"),
        F.md5(F.col("l_orderkey").cast("string")).alias("hash"),
        F.lit(0).alias("parent_no"),
        doc_path(F.col("l_partkey")).alias("path"),
        X.change_type(F.col("l_returnflag")).alias("change_type"),
        F.col("l_quantity").cast("long").alias("insertions"),
        F.col("l_linenumber").cast("long").alias("deletions"),
    )


def with_patch(changes: DataFrame) -> DataFrame:
    """``changes`` with a ``patch``: as many added lines as the change has insertions."""
    head = F.concat(F.lit("@@ -1,"), F.col("deletions").cast("string"), F.lit(" +1,"), F.col("insertions").cast("string"), F.lit(" @@\n"))
    return changes.withColumn("patch", F.concat(head, F.repeat(F.concat(F.lit("+"), F.col("path"), F.lit("\n")), F.col("insertions").cast("int"))))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn"), F.col("role"), F.col("text").alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")
