"""Text tables built with JVM expressions only.

Long texts are exploded to rows and aggregated; higher-order lambdas are kept
for short arrays (per-line pieces, name lists).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.functions import text as T
from codeloom.session import stored

REPO = "repository_id"


# --- U1 ----------------------------------------------------------------------------------

def explode_lines(files: DataFrame, content_col: str = "content", keys: list[str] | None = None) -> DataFrame:
    """One row per line, ``line_no`` 1-based, ``str.splitlines()`` boundaries."""
    keys = keys or [REPO, "path"]
    return files.select(*keys, F.posexplode(T.splitlines(F.col(content_col))).alias("pos", "line")) \
        .select(*keys, (F.col("pos") + 1).cast("int").alias("line_no"), "line")


# --- U3 / W4 --------------------------------------------------------------------------------

# Fixed values (the reference's declaration shapes and context sizes).
# Generic declaration shapes; the name is matched afterwards by an equi-join.
DECL_FUNCTION = [r"\bfunction\s+(\w+)\b", r"\b(\w+)\s*[:=]\s*function\b", r"\bdef\s+(\w+)\b"]
DECL_CLASS = [r"\bclass\s+(\w+)\b"]
CONTEXT_AFTER = {"function": 20, "class": 50}


SPAN_LINES = 1000


def line_spans(files: DataFrame, content: Column, before: int, after: int, span: int = SPAN_LINES) -> DataFrame:
    """(repository_id, path, first, skip, lines): each file's lines in spans of ``span`` lines.

    ``lines`` starts up to ``before`` lines above line ``first`` (``skip`` of them) and goes on ``after`` lines
    beyond the span, so a window around any of the span's own lines is cut inside the row.
    """
    # exploding a one-element array keeps the split from being written into every use of it
    whole = files.select(REPO, "path", F.explode(F.array(content)).alias("lines")).where(F.size("lines") > 0)
    firsts = F.sequence(F.lit(1), F.size("lines"), F.lit(span))

    def cut(first: Column) -> Column:
        begin = F.greatest(first - before, F.lit(1))
        return F.struct(first.alias("first"), (first - begin).alias("skip"),
                        F.slice("lines", begin, F.lit(span + after) + first - begin).alias("lines"))
    return whole.select(REPO, "path", F.explode(F.transform(firsts, cut)).alias("s")).select(REPO, "path", "s.*")


def regex_symbols(files: DataFrame, names: DataFrame | None = None, first_per_file: bool = False,
                  case_insensitive: bool = False, span: int | None = None) -> DataFrame:
    """U3 + W4: declarations in non-Python files with their context lines.

    Candidate names are pulled from each line once with ``regexp_extract_all``
    (no regex per requested name), then equi-joined with ``names(name)`` when
    given.  A line that declares a function is not also tried as a class
    (reference order).  Context is lines ``[i-1, i+20)`` for functions and
    ``[i-1, i+50)`` for classes (0-based i), cut from the span of lines a
    declaration lies in: lines are never joined, and files without a keyword are not split.
    """
    span = span or SPAN_LINES
    flags = "(?iU)" if case_insensitive else "(?U)"       # names in any script
    word = ("(?iu)" if case_insensitive else "") + "function|def|class"
    src = files.where(~F.col("path").endswith(".py") & ~F.col("binary") & F.col("content").isNotNull())
    none = F.array().cast("array<string>")
    lines = line_spans(src, F.when(F.col("content").rlike(word), T.splitlines(F.col("content"))).otherwise(none),
                       1, max(CONTEXT_AFTER.values()), span)
    hit = "array<struct<at:int,name:string,kind:string>>"

    def declared(line: Column, i: Column) -> Column:
        fn = F.array_distinct(F.concat(*[F.regexp_extract_all(line, F.lit(flags + p), 1) for p in DECL_FUNCTION]))
        # function beats class on the same line for the same name
        cl = F.array_except(F.array_distinct(F.regexp_extract_all(line, F.lit(flags + DECL_CLASS[0]), 1)), fn)

        def of_kind(names: Column, kind: str) -> Column:
            return F.transform(names, lambda n: F.struct(i.alias("at"), n.alias("name"), F.lit(kind).alias("kind")))
        found = F.concat(of_kind(fn, "function"), of_kind(cl, "class"))
        return F.when(line.rlike(word), found).otherwise(F.array().cast(hit))

    def with_source(h: Column) -> Column:
        here = F.col("skip") + h["at"] + 1                                  # 1-based in the row
        begin = F.greatest(here - 1, F.lit(1))
        after = F.when(h["kind"] == "class", CONTEXT_AFTER["class"]).otherwise(CONTEXT_AFTER["function"])
        return F.struct(h["name"].alias("name"), h["kind"].alias("kind"), (F.col("first") + h["at"]).alias("line_start"),
                        F.element_at("lines", here).alias("line"),
                        F.array_join(F.slice("lines", begin, here + after - begin), "\n").alias("source"))
    own = F.slice("lines", F.col("skip") + 1, F.lit(span))
    hits = (lines.select(REPO, "path", F.explode(F.transform(F.flatten(F.transform(own, declared)), with_source)).alias("h"))
            .select(REPO, "path", "h.*"))
    if names is not None:
        hits = hits.join(names.select("name").distinct(), "name")
    if first_per_file:
        wf = Window.partitionBy(REPO, "path", "name").orderBy("line_start")
        hits = hits.withColumn("_r", F.row_number().over(wf)).where(F.col("_r") == 1)
    return hits.select(REPO, "path", "name", "kind", "line_start", X.py_strip(F.col("line")).alias("signature"), "source")


# --- U8 ------------------------------------------------------------------------------------------

# Fixed values (README candidates in priority order, section keywords).
README_NAMES = ["README.md", "README.rst", "Readme.md", "readme.md"]
README_KEYWORDS = ["about", "introduction", "overview", "description", "features", "usage"]


def readme_summary(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """U8: per repository, a summary of the first README found at the root.

    <1500 characters: the stripped text; else the text before the first heading
    plus, for each section whose lowered title mentions a keyword, the title and
    the first 500 characters of its body.  No README -> "No README found".
    """
    prio = None
    for i, n in enumerate(README_NAMES):
        prio = F.when(F.col("path") == n, i) if prio is None else prio.when(F.col("path") == n, i)
    cand = files.where(F.col("path").isin(README_NAMES)).select(REPO, prio.alias("_p"), "content")
    best = cand.groupBy(REPO).agg(F.min_by("content", "_p").alias("readme"))
    c = F.coalesce(F.col("readme"), F.lit(""))
    sections = F.split(c, r"#{1,6}\s+")
    head = X.py_strip(F.element_at(sections, 1))

    def section(s: Column) -> Column:
        st = X.py_strip(s)
        lines = F.split(st, "\n")
        title = F.lower(F.element_at(lines, 1))
        body = X.py_strip(F.array_join(F.slice(lines, 2, 1 << 30), "\n"))
        hit = F.lit(False)
        for k in README_KEYWORDS:
            hit = hit | title.contains(k)
        return F.when(hit, F.concat(F.lit("\n\n## "), title, F.lit("\n"), F.substring(body, 1, 500), F.lit("...")))

    rest = F.array_join(F.transform(F.slice(sections, 2, 1 << 30), section), "")
    long_summary = F.concat(head, rest)
    summary = (F.when(F.col("readme").isNull(), F.lit("No README found"))
               .when(X.py_strip(c) == "", F.lit("No README content available."))
               .when(F.length(c) < 1500, X.py_strip(c))
               .otherwise(long_summary))
    base = repos.select(REPO).distinct() if repos is not None else files.select(REPO).distinct()
    return base.join(best, REPO, "left").select(REPO, summary.alias("summary"))


# --- U9 / U10 / W3 -----------------------------------------------------------------------------------

# Fixed values (the diff viewer's special texts and hunk header).
SPECIAL_CONTENT_PREFIXES = ["File was added in this commit:", "File was deleted in this commit. Previous content:",
                            "Initial commit, file added:"]
SPECIAL_MESSAGES = ["Binary file (no text diff available)", "File was added in this commit (binary content)",
                    "File was deleted in this commit (binary content)", "Binary file or encoding error",
                    "No changes detected in this file for this commit", "File metadata changed (permissions or mode)"]
SPECIAL_MESSAGE_PREFIXES = ["File was renamed in this commit", "Could not retrieve diff:", "Error retrieving diff:"]
NO_FALLBACK_PREFIXES = ["Binary", "File was", "Could not", "Error"]
HUNK_HEADER = r"@@ -(\d+),?\d* \+(\d+),?\d* @@"


def _starts_any(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def diff_kind(text: Column) -> Column:
    """'content' (whole-file text), 'message' (header only) or 'unified'."""
    return (F.when(_starts_any(text, SPECIAL_CONTENT_PREFIXES) & text.contains("\n\n"), F.lit("content"))
            .when(text.isin(SPECIAL_MESSAGES) | _starts_any(text, SPECIAL_MESSAGE_PREFIXES), F.lit("message"))
            .otherwise(F.lit("unified")))


BLOCK_LINES = 4096


def parse_diff_lines(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff",
                     compat: bool = False, block_lines: int | None = None) -> DataFrame:
    """U9 + W3: every line of a unified diff with its hunk, kind and left/right line numbers.

    ``kind``: header, removed, added, context, skip.  A header matching
    ``@@ -a,b +c,d @@`` resets the counters to (a, c); removed lines advance the
    left counter, added the right, context both.  ``---``/``+++`` lines are file
    headers before the first hunk; ``compat=True`` skips them everywhere, as the
    reference viewer does.

    The counters are a segmented prefix scan: a diff is cut into blocks of ``block_lines`` lines,
    numbered locally, each block's totals are summed over the blocks before it (one row a block),
    and the sums are added to the local numbers.  So a diff of any length is many tasks.
    """
    local = stored(_local_counters(diffs, id_col, text_col, compat, block_lines or BLOCK_LINES))
    lines = local.join(_block_starts(local), ["diff_id", "block"])
    in_hunk = F.col("hunk0") > 0
    kind = (F.when(~F.col("unsure"), F.col("kind")).when(~in_hunk, "skip")
            .when(F.col("line").startswith("-"), "removed").otherwise("added"))

    def number(side: str) -> Column:
        unsure = F.when(in_hunk, F.col(f"{side}_unsure")).otherwise(0)
        return F.when(F.col("resets") > 0, F.col(f"{side}_reset") + F.col(side)).otherwise(F.col(f"{side}0") + F.col(side) + unsure)
    lines = lines.select("diff_id", "idx", (F.col("hunk0") + F.col("headers")).alias("hunk"), kind.alias("kind"), "line",
                         number("left").alias("left_no"), number("right").alias("right_no"))
    return lines.select(
        "diff_id", F.col("idx").cast("int"), F.col("hunk").cast("int"), "kind",
        F.when(F.col("kind").isin("removed", "added"), F.substring("line", 2, 1 << 30)).otherwise(F.col("line")).alias("text"),
        F.when(F.col("kind") == "removed", F.col("left_no")).cast("long").alias("left_no"),
        F.when(F.col("kind") == "added", F.col("right_no")).cast("long").alias("right_no"))


def _local_counters(diffs: DataFrame, id_col: str, text_col: str, compat: bool, block_lines: int) -> DataFrame:
    """Lines with counters that start at their block: headers and resets so far, the last reset, lines passed since.

    A ``---`` or ``+++`` line before the block's first header is ``unsure``: whether it is a file header or a
    changed line depends on the blocks before, so such lines are counted apart.
    """
    # kind and split in one projection (no Filter): a derived diff text is built once per row
    # instead of being inlined into every branch of a pushed-down predicate.
    arr = diffs.select(F.col(id_col).alias("diff_id"),
                       F.when(diff_kind(F.col(text_col)) == "unified", F.split(F.col(text_col), "\n")).alias("_arr"))
    lines = (arr.select("diff_id", F.posexplode("_arr").alias("idx", "line"))
             .withColumn("block", F.floor(F.col("idx") / block_lines).cast("int"))
             .repartition("diff_id", "block"))                 # also where the diffs are one partition
    so_far = Window.partitionBy("diff_id", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_header = F.col("line").startswith("@@")
    l0, r0 = (F.regexp_extract("line", HUNK_HEADER, n) for n in (1, 2))
    resets = is_header & (l0 != "")
    lines = (lines.withColumn("headers", F.sum(is_header.cast("int")).over(so_far))
             .withColumn("resets", F.sum(resets.cast("int")).over(so_far))
             .withColumn("left_reset", F.last(F.when(resets, l0.cast("long")), ignorenulls=True).over(so_far))
             .withColumn("right_reset", F.last(F.when(resets, r0.cast("long")), ignorenulls=True).over(so_far)))
    file_header = F.col("line").startswith("---") | F.col("line").startswith("+++")
    unsure = F.lit(False) if compat else file_header & (F.col("headers") == 0)
    kind = (F.when(is_header, "header").when(file_header if compat else F.lit(False), "skip")
            .when(F.col("line").startswith("-"), "removed").when(F.col("line").startswith("+"), "added").otherwise("context"))
    lines = lines.withColumn("kind", kind).withColumn("unsure", unsure)
    before = Window.partitionBy("diff_id", "block", "resets").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    passes = {"left": F.col("kind").isin("removed", "context"), "right": F.col("kind").isin("added", "context")}
    for side, moves in passes.items():
        for name, when in ((side, moves & ~F.col("unsure")), (f"{side}_unsure", moves & F.col("unsure"))):
            lines = (lines.withColumn(f"{name}_own", when.cast("long"))
                     .withColumn(name, F.coalesce(F.sum(f"{name}_own").over(before), F.lit(0))))
    return lines


def _block_starts(local: DataFrame) -> DataFrame:
    """(diff_id, block, hunk0, left0, right0): what the counters stand at where each block begins; one row a block."""
    def at_end(c: Column) -> Column:
        return F.max_by(c, "idx")
    sides = ("left", "right")
    ends = local.groupBy("diff_id", "block").agg(
        F.max("headers").alias("headers"), F.max("resets").alias("resets"),
        *[at_end(F.col(f"{s}_reset")).alias(f"{s}_reset") for s in sides],
        *[at_end(F.col(n) + F.col(f"{n}_own")).alias(n) for s in sides for n in (s, f"{s}_unsure")])
    order = Window.partitionBy("diff_id").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (ends.withColumn("hunk0", F.coalesce(F.sum("headers").over(past), F.lit(0)))
            .withColumn("part", F.sum((F.col("resets") > 0).cast("int")).over(upto)))
    within = Window.partitionBy("diff_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for s in sides:
        moved = F.col(s) + F.when((F.col("resets") == 0) & (F.col("hunk0") > 0), F.col(f"{s}_unsure")).otherwise(0)
        end = F.coalesce(F.last(f"{s}_reset", ignorenulls=True).over(upto), F.lit(0)) + F.sum(moved).over(within)
        ends = ends.withColumn(f"{s}_end", end)
    return ends.select("diff_id", "block", "hunk0", *[F.coalesce(F.lag(f"{s}_end").over(order), F.lit(0)).alias(f"{s}0") for s in sides])


def parse_diff_blocks(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff",
                      compat: bool = False) -> DataFrame:
    """U9 + U10: side-by-side blocks (header, removed[], added[], line numbers[]) per diff.

    A block per hunk that has changes; special whole-file texts give one block of
    all-added or all-removed lines; status messages give a header-only block; a
    text with no change lines falls back to one "Changes" block.
    """
    src = diffs.select(F.col(id_col).alias("diff_id"), F.col(text_col).alias("diff"))
    lines = parse_diff_lines(src, "diff_id", "diff", compat)
    # a flag per diff splits hunks with changes from diffs that get the fallback block
    is_change = F.col("kind").isin("removed", "added")
    flags = lines.groupBy("diff_id").agg((F.max(is_change.cast("int")) == 1).alias("_has_change"))
    lines = lines.join(flags, "diff_id")
    entries = F.array_sort(F.collect_list(F.struct("idx", "kind", "text", "left_no", "right_no")))
    blocks = (lines.where(F.col("_has_change") & F.col("kind").isin("header", "removed", "added"))
              .groupBy("diff_id", "hunk")
              .agg(F.max(F.when(F.col("kind") == "header", F.col("text"))).alias("header"),
                   F.filter(entries, lambda e: e["kind"] != "header").alias("_e"))
              .where(F.size("_e") > 0))
    rem = F.filter("_e", lambda e: e["kind"] == "removed")
    add = F.filter("_e", lambda e: e["kind"] == "added")
    blocks = blocks.select(
        "diff_id", F.col("hunk").alias("block_no"), "header",
        F.transform(rem, lambda e: e["text"]).alias("removed"), F.transform(add, lambda e: e["text"]).alias("added"),
        F.transform(rem, lambda e: e["left_no"]).alias("removed_line_numbers"),
        F.transform(add, lambda e: e["right_no"]).alias("added_line_numbers"))

    empty_s = F.array().cast("array<string>")
    empty_n = F.array().cast("array<bigint>")
    first_line = F.when(F.col("idx") == 0, F.col("text"))
    fb = (lines.where(~F.col("_has_change")).groupBy("diff_id")
          .agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("_l"),
               F.max(_starts_any(first_line, NO_FALLBACK_PREFIXES)).alias("_excluded"),
               F.max(F.length(F.trim(F.col("text"))) > 0).alias("_nonblank"))
          .where(~F.col("_excluded") & F.col("_nonblank")))
    fallback = fb.select("diff_id", F.lit(0).alias("block_no"), F.lit("Changes").alias("header"),
                         empty_s.alias("removed"), F.transform("_l", lambda e: e["text"]).alias("added"),
                         empty_n.alias("removed_line_numbers"),
                         F.sequence(F.lit(1).cast("long"), F.size("_l").cast("long")).alias("added_line_numbers"))

    # U10 special texts.
    kind = diff_kind(F.col("diff"))
    pieces = F.split(F.col("diff"), "\n\n")
    body = F.array_join(F.slice(pieces, 2, 1 << 30), "\n\n")
    body_lines = F.split(body, "\n")
    nums = F.sequence(F.lit(1).cast("long"), F.size(body_lines).cast("long"))
    is_add = F.col("diff").startswith("File was added") | F.col("diff").startswith("Initial commit")
    # a one-element array for special texts, exploded (no Filter: a derived diff text would be
    # inlined into every branch of a pushed-down predicate)
    one = F.when(kind != "unified", F.array(F.struct(kind.alias("_k"), F.col("diff").alias("diff"))))
    sp = src.select("diff_id", F.explode(one).alias("_s")).select("diff_id", "_s._k", "_s.diff")
    special = sp.select(
        "diff_id", F.lit(0).alias("block_no"),
        F.when(F.col("_k") == "content", F.element_at(pieces, 1)).otherwise(F.col("diff")).alias("header"),
        F.when((F.col("_k") == "content") & ~is_add, body_lines).otherwise(empty_s).alias("removed"),
        F.when((F.col("_k") == "content") & is_add, body_lines).otherwise(empty_s).alias("added"),
        F.when((F.col("_k") == "content") & ~is_add, nums).otherwise(empty_n).alias("removed_line_numbers"),
        F.when((F.col("_k") == "content") & is_add, nums).otherwise(empty_n).alias("added_line_numbers"))
    return blocks.unionByName(special).unionByName(fallback)


# --- U11 / U12 / U13 / P15 / X5 -------------------------------------------------------------------

def extract_hash_refs(df: DataFrame, text_col: str, keys: list[str], mode: str = "first") -> DataFrame:
    """Hash mentions.  ``first``: the backend's first match (no word boundary);
    ``all``: every bounded match, skipped for messages that look like diffs (F7); deduplicated (X5)."""
    if mode == "first":
        return df.select(*keys, T.hash_ref_first(F.col(text_col)).alias("ref")).where(F.col("ref").isNotNull())
    refs = F.array_distinct(T.hash_refs_all(F.col(text_col)))
    return (df.where(~X.is_diff_content(F.col(text_col)))
            .select(*keys, F.posexplode(refs).alias("ref_no", "ref")))


def extract_code_elements(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """Asked-about code names in pattern order, duplicates kept, with their position."""
    return df.select(*keys, F.posexplode(T.code_elements(F.col(text_col))).alias("element_no", "name"))


def extract_code_paths(df: DataFrame, text_col: str, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """Paths written after code fences; a semi join with ``files`` drops false hits.

    Where ``keys`` name the repository, a path must be a file of that repository, not of any.
    """
    out = df.select(*keys, F.explode(F.array_distinct(T.code_paths(F.col(text_col)))).alias("path"))
    if files is not None:
        on = ["repository_id", "path"] if "repository_id" in keys else ["path"]
        out = out.join(files.select(*on).distinct(), on, "left_semi").select(*keys, "path")
    return out
