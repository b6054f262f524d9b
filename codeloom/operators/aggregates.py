"""Aggregations over the repository model.

All are hash aggregates with map-side partial aggregation, so a repository
holding a third of all rows costs one partial row per task before the shuffle.
No operator collects an unbounded group: per-repository lists are built only
from bounded inputs (top-k, a fixed marker list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.functions import text as T

REPO = "repository_id"


def line_count(content: Column) -> Column:
    """Number of ``str.splitlines()`` lines, without materialising them."""
    breaks = F.regexp_count(content, F.lit(T.SPLITLINES))
    tail = F.when((F.length(content) > 0) & ~content.rlike(f"(?:{T.SPLITLINES})$"), 1).otherwise(0)
    return F.when(content.isNull(), F.lit(0)).otherwise(breaks + tail).cast("long")


# --- A1 / A2 ------------------------------------------------------------------------

def extension_histogram(files: DataFrame) -> DataFrame:
    """A2: files per lower-cased non-empty extension."""
    ext = F.lower(X.file_ext(F.col("path")))
    return (files.select(REPO, ext.alias("ext")).where(F.col("ext") != "")
            .groupBy(REPO, "ext").agg(F.count("*").alias("n_files")))


def detect_language(files: DataFrame) -> DataFrame:
    """A1: marker file at the root first, else the most frequent extension's language.

    Markers are ranked per row and reduced with ``min`` (no per-repository list);
    the extension winner breaks count ties by extension ascending.
    """
    rank = None
    for i, (names, _lang) in enumerate(X.LANGUAGE_MARKERS):
        cond = F.col("path").isin(list(names))
        rank = F.when(cond, i) if rank is None else rank.when(cond, i)
    markers = files.groupBy(REPO).agg(F.min(rank).alias("marker"))
    lang_of_marker = None
    for i, (_names, lang) in enumerate(X.LANGUAGE_MARKERS):
        lang_of_marker = (F.when(F.col("marker") == i, lang) if lang_of_marker is None
                          else lang_of_marker.when(F.col("marker") == i, lang))
    hist = extension_histogram(files)
    top = hist.groupBy(REPO).agg(F.min_by("ext", F.struct((-F.col("n_files")).alias("n"), F.col("ext"))).alias("top_ext"))
    j = markers.join(top, REPO, "left")
    return j.select(REPO, F.coalesce(lang_of_marker, X.language_of_ext(F.coalesce("top_ext", F.lit("")))).alias("language"),
                    F.col("top_ext"))


# --- A3 -------------------------------------------------------------------------------

def directory_rollup(files: DataFrame) -> DataFrame:
    """A3: every ancestor directory ('' = root) with file count, bytes and lines below it."""
    parts = F.split(F.col("path"), "/")
    anc = F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                      lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    # count lines once per file, then fan out to the ancestors (content is not carried along)
    per_file = files.select(REPO, "path", "size", line_count(F.col("content")).alias("lines"))
    rows = per_file.select(REPO, F.explode(anc).alias("directory"), "size", "lines")
    return rows.groupBy(REPO, "directory").agg(
        F.count("*").alias("n_files"), F.sum("size").cast("long").alias("bytes"),
        F.sum("lines").cast("long").alias("lines"))


# --- A4 / A11 / A12 ----------------------------------------------------------------------

def commit_stats(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """A4: files_changed / insertions / deletions per commit, zeros for commits without changes.

    The change table is reduced to one row per commit before it meets the commits.
    """
    per = changes.groupBy(REPO, "hash").agg(
        F.count("*").alias("files_changed"), F.sum("insertions").cast("long").alias("insertions"),
        F.sum("deletions").cast("long").alias("deletions"))
    j = commits.join(per, [REPO, "hash"], "left")
    return j.select(*commits.columns, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                        for c in ("files_changed", "insertions", "deletions")])


def author_activity(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits, first/last date and distinct files touched per author and repository."""
    c = commits.groupBy(REPO, "author_email").agg(
        F.count("*").alias("n_commits"), F.min("author_ts").alias("first_ts"), F.max("author_ts").alias("last_ts"))
    touched = (changes.join(commits.select(REPO, "hash", "author_email"), [REPO, "hash"])
               .select(REPO, "author_email", "path").distinct()
               .groupBy(REPO, "author_email").agg(F.count("*").alias("files_touched")))
    return c.join(touched, [REPO, "author_email"], "left").select(
        REPO, "author_email", "n_commits", "first_ts", "last_ts",
        F.coalesce("files_touched", F.lit(0)).cast("long").alias("files_touched"))


def file_churn(changes: DataFrame) -> DataFrame:
    """Changes, insertions, deletions and distinct commits per path."""
    per_commit = changes.groupBy(REPO, "path", "hash").agg(
        F.count("*").alias("n"), F.sum("insertions").alias("ins"), F.sum("deletions").alias("dels"))
    return per_commit.groupBy(REPO, "path").agg(
        F.sum("n").cast("long").alias("n_changes"), F.sum("ins").cast("long").alias("insertions"),
        F.sum("dels").cast("long").alias("deletions"), F.count("*").cast("long").alias("n_commits"))


# --- A5 / A6 / A7 / A8 / A13 ------------------------------------------------------------------

def function_summary(files: DataFrame, function_metrics: DataFrame) -> DataFrame:
    """Mean complexity over a file's functions; 0 when it has none (or is not Python)."""
    per = function_metrics.groupBy(REPO, "path").agg(F.avg("complexity").alias("avg_complexity"),
                                                     F.count("*").alias("n_functions"))
    return files.select(REPO, "path").join(per, [REPO, "path"], "left").select(
        REPO, "path", F.coalesce("avg_complexity", F.lit(0.0)).alias("complexity"),
        F.coalesce("n_functions", F.lit(0)).cast("long").alias("n_functions"))


def sample_files(files: DataFrame, cap: int | None = 20, seed: str = "0") -> DataFrame:
    """Deterministic per-repository sample (md5 order of path+seed); ``cap=None`` keeps all."""
    if cap is None:
        return files
    w = Window.partitionBy(REPO).orderBy(F.md5(F.concat(F.col("path"), F.lit(seed))), F.col("path"))
    return files.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def technical_debt(files: DataFrame, file_scores: DataFrame, sample_cap: int | None = None,
                   top_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """A7 + A8: debt score per repository and its most complex files.

    ``file_scores(repository_id, path, complexity, maintainability)`` is the
    per-file complexity (0 for files the analyser cannot read).  Ratios use all
    files, binary ones included; an empty repository scores 0/100/100 -> 60.
    """
    base = files.select(REPO, "path", "content")
    counts = base.groupBy(REPO).agg(
        F.count("*").alias("n_files"),
        F.count_if(X.is_documentation(F.col("path"))).alias("n_doc"),
        F.count_if(X.is_test(F.col("path"))).alias("n_test"))
    analysed = sample_files(base.where(X.is_analyzable(F.col("path"), F.col("content"))), sample_cap)
    scored = analysed.select(REPO, "path").join(file_scores, [REPO, "path"], "left").select(
        REPO, "path", F.coalesce("complexity", F.lit(0.0)).alias("complexity"),
        "maintainability")      # unknown stays null, 0 would be the worst score
    cx = scored.groupBy(REPO).agg(F.avg("complexity").alias("avg_complexity"),
                                  F.count("*").alias("n_analysed"))
    j = counts.join(cx, REPO, "left")
    avg_c = F.coalesce("avg_complexity", F.lit(0.0))
    doc_ratio = F.col("n_doc") / F.col("n_files")
    test_ratio = F.col("n_test") / F.col("n_files")
    cc = F.least(F.lit(100.0), avg_c * 10)
    doc = F.greatest(F.lit(0.0), 100 - doc_ratio * 500)
    tst = F.greatest(F.lit(0.0), 100 - test_ratio * 500)
    debt = j.select(
        REPO, F.col("n_files").cast("long"), F.coalesce("n_analysed", F.lit(0)).cast("long").alias("n_analysed"),
        avg_c.alias("avg_complexity"), cc.alias("code_complexity"), doc.alias("documentation"),
        tst.alias("test_coverage"), F.lit(0.0).alias("code_duplication"), F.lit(0.0).alias("outdated_dependencies"),
        (cc * 0.4 + doc * 0.3 + tst * 0.3).alias("score"))
    w = Window.partitionBy(REPO).orderBy(F.col("complexity").desc(), F.col("path"))
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return debt, top


def empty_repo_debt() -> dict:
    """Score of a repository with no files: complexity 0, documentation 100, tests 100."""
    return {"code_complexity": 0.0, "documentation": 100.0, "test_coverage": 100.0, "score": 60.0}


def repository_metrics(files: DataFrame, commits: DataFrame, file_scores: DataFrame | None = None,
                       debt: DataFrame | None = None) -> DataFrame:
    """One row per repository; every input reduced to one row per repository first.

    ``debt`` is the first table of :func:`technical_debt`; it gives ``avg_complexity`` too unless ``file_scores`` does.
    """
    f = files.groupBy(REPO).agg(F.count("*").cast("long").alias("total_files"),
                                F.sum(line_count(F.col("content"))).cast("long").alias("total_lines"))
    c = commits.groupBy(REPO).agg(
        F.count("*").alias("n_commits"),
        F.countDistinct("author_email").cast("long").alias("contributor_count"),
        (F.datediff(F.max("author_ts"), F.min("author_ts")) + 1).alias("span_days"))
    c = c.select(REPO, "contributor_count",
                 (F.col("n_commits") / F.greatest(F.lit(1), F.col("span_days"))).alias("commit_frequency"))
    out = f.join(c, REPO, "full_outer")
    if file_scores is not None:
        out = out.join(file_scores.groupBy(REPO).agg(F.avg("complexity").alias("avg_complexity")), REPO, "left")
    if debt is not None:
        own = [] if file_scores is not None else ["avg_complexity"]
        out = out.join(debt.select(REPO, *own, F.col("score").alias("technical_debt_score")), REPO, "left")
    return out


HLL_LG_K = 12             # registers as a power of two: the standard error is about 1.04 / 2 ** (lg_k / 2), 1.6 %


def activity_sketches(commits: DataFrame, lg_k: int = HLL_LG_K) -> DataFrame:
    """(repository_id, day, n_commits, authors): daily counts with a mergeable sketch of the authors.

    Days of any period add up without the commits: see :func:`activity_between`.  New commits of a day are a
    sketch of their own that is merged the same way.  Commits without an author or a time are not in a sketch.
    """
    return (commits.where("author_ts is not null").groupBy(REPO, F.to_date("author_ts").alias("day"))
            .agg(F.count("*").alias("n_commits"), F.hll_sketch_agg("author_email", lg_k).alias("authors")))


def activity_between(sketches: DataFrame, period: str | None = None) -> DataFrame:
    """(repository_id, [period,] n_commits, contributors): daily sketches merged per repository and ``period``
    (``week``, ``month``, ...; the whole time if null).  ``contributors`` is an estimate within the sketch's error."""
    by = [F.date_trunc(period, "day").cast("date").alias("period")] if period else []
    return sketches.groupBy(REPO, *by).agg(F.sum("n_commits").alias("n_commits"),
                                           F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("contributors"))


# --- A9 / A10 / F8 ------------------------------------------------------------------------------

def last_message(messages: DataFrame) -> DataFrame:
    """Per session: the last turn's role and content (F8 input)."""
    return messages.groupBy("session_id").agg(
        F.max_by("role", "turn").alias("last_role"), F.max_by("content", "turn").alias("last_content"),
        F.max("turn").alias("last_turn"), F.count("*").alias("n_messages"))


def user_sessions(messages: DataFrame) -> DataFrame:
    """F8: sessions that are non-empty and whose last message is from the user."""
    return last_message(messages).where(F.col("last_role") == "user")


def conversation_history(messages: DataFrame) -> DataFrame:
    """Every message but the last, as rows (session_id, turn, role, content).

    Kept flat: a session can be long, so the history is never gathered into one array here;
    context assembly nests only the bounded slice it needs.
    """
    last = messages.groupBy("session_id").agg(F.max("turn").alias("_last"))
    return (messages.join(last, "session_id").where(F.col("turn") < F.col("_last"))
            .select("session_id", "turn", "role", "content"))


def user_text_concat(messages: DataFrame) -> DataFrame:
    """A10: all user messages joined by newline (with a trailing newline) and the last one as the query."""
    u = messages.where(F.col("role") == "user")
    return u.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))),
                                 lambda s: F.concat(s["content"], F.lit("\n"))), "").alias("user_text"),
        F.max_by("content", "turn").alias("query"))
