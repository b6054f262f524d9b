"""Joins of the repository model and the window operators they use.

The reference's nested loops and dict lookups become equi-joins.  The two
rewrites Catalyst does not do by itself are written here:

* prefix match (J2) gets an equality key on the first 7 characters, so it is a
  hash/sort-merge join and never a Cartesian product;
* the as-of lookup (J4, in ``asof``) is a sorted merge of requests and versions
  over sampled ranges, so no request is paired with every version of a hot path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.operators.asof import content_at  # noqa: F401
from codeloom.session import stored

REPO = "repository_id"


# --- J1 -----------------------------------------------------------------------------

def commits_with_changes(commits: DataFrame, changes: DataFrame, max_files: int | None = None,
                         diff_cut: int | None = None) -> DataFrame:
    """J1 (+W2 when ``max_files`` is set): each commit with its ordered change list.

    Changes are grouped per commit before the join, so the join is one row per
    commit on both sides.  ``max_files`` keeps the first n paths and reports the
    cut in ``note``.  With ``diff_cut`` an entry also holds ``diff``, the first characters of the change's ``patch``
    (null where there is none), cut before it is shuffled.
    """
    fields = ["path", "change_type", "insertions", "deletions"]
    if diff_cut is not None and "patch" in changes.columns:
        changes = changes.withColumn("diff", F.substring("patch", 1, diff_cut)).drop("patch")
        fields.append("diff")
    entry = F.struct(*fields)
    if max_files is None:
        per = changes.groupBy(REPO, "hash").agg(F.array_sort(F.collect_list(entry)).alias("file_changes"),
                                                F.count("*").alias("n_changes"))
    else:
        # cut before collecting (WindowGroupLimit), so a huge commit never gathers all its rows
        w = Window.partitionBy(REPO, "hash").orderBy("path", "change_type", "insertions", "deletions")
        kept = changes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_files)
        lists = kept.groupBy(REPO, "hash").agg(F.array_sort(F.collect_list(entry)).alias("file_changes"))
        totals = changes.groupBy(REPO, "hash").agg(F.count("*").alias("_total"))
        per = lists.join(totals, [REPO, "hash"]).select(
            REPO, "hash", "file_changes", F.least("_total", F.lit(max_files)).alias("n_changes"),
            F.when(F.col("_total") > max_files, F.lit(f"Display limited to {max_files} files")).alias("note"))
    out = commits.join(per, [REPO, "hash"], "left")
    return out.withColumn("file_changes", F.coalesce("file_changes", F.array().cast(per.schema["file_changes"].dataType))) \
              .withColumn("n_changes", F.coalesce("n_changes", F.lit(0)).cast("long"))


def cap_changes(changes: DataFrame, max_files: int = 200) -> DataFrame:
    """First ``max_files`` changes per commit (path order) plus the shown / total counts."""
    order = [c for c in ("path", "change_type", "insertions", "deletions") if c in changes.columns]
    w = Window.partitionBy(REPO, "hash").orderBy(*order)
    wc = Window.partitionBy(REPO, "hash")
    return (changes.withColumn("file_no", F.row_number().over(w))
            .withColumn("total_files", F.count("*").over(wc))
            .where(F.col("file_no") <= max_files)
            .withColumn("files_changed", F.least("total_files", F.lit(max_files)))
            .withColumn("note", F.when(F.col("total_files") > max_files, F.lit(f"Display limited to {max_files} files"))))


# --- J2 -----------------------------------------------------------------------------

PREFIX = 7


def resolve_hashes(refs: DataFrame, commits: DataFrame, ref_col: str = "ref", min_len: int = 1) -> DataFrame:
    """Each reference -> the newest commit (lowest ``seq``) whose hash starts with it.

    ``refs(ref_id, [repository_id], ref)``; refs are normalised (P15) and
    lower-cased; refs of ``min_len`` characters or more resolve.  Refs are read and normalised once,
    into a stored table that every later step reads.  Distinct refs are matched once
    (a hot ref costs one row) and the answer is joined back to every request.  A ref of ``PREFIX``
    characters or more meets the commits with its first characters; a shorter one is itself the
    prefix of all its commits, so those are aggregated first, for the lengths that are asked only.
    Returns ``hash``, ``seq`` and the number of matching commits (``match_count`` > 1 = ambiguous).
    """
    on = [REPO] if REPO in refs.columns else []
    r = stored(refs.withColumn("_norm", F.lower(X.normalize_hash(F.col(ref_col), min_len=min_len))))
    uniq = r.select(*on, "_norm").where(F.length("_norm") > 0).distinct()
    c = commits.select(*on, "hash", "seq")
    answer = [F.min(F.struct("seq", "hash")).getField("hash").alias("hash"), F.min("seq").alias("seq"), F.count("*").alias("match_count")]
    long_refs = uniq.where(F.length("_norm") >= PREFIX).withColumn("_k", F.substring("_norm", 1, PREFIX))
    best = (long_refs.join(c.withColumn("_k", F.substring(F.lower("hash"), 1, PREFIX)), [*on, "_k"])
            .where(F.lower("hash").startswith(F.col("_norm"))).groupBy(*on, "_norm").agg(*answer))
    short = uniq.where(F.length("_norm") < PREFIX)
    lengths = r.select(F.length("_norm").alias("n")).where(f"n > 0 and n < {PREFIX}").distinct()
    asked = sorted(x[0] for x in lengths.collect())          # PREFIX - 1 numbers at most
    if asked:
        cut = F.explode(F.transform(F.array(*[F.lit(n) for n in asked]), lambda n: F.lower("hash").substr(F.lit(1), n)))
        groups = c.select(*on, "hash", "seq", cut.alias("_norm")).groupBy(*on, "_norm").agg(*answer)
        best = best.unionByName(groups.join(short, [*on, "_norm"], "left_semi"))
    out = r.join(best, [*on, "_norm"], "left")
    return out.select(*[c for c in refs.columns], F.col("_norm").alias("normalized"), "hash", "seq",
                      F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"))


# --- J3 / J7 ---------------------------------------------------------------------------

def lookup_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Exact (repository, path) lookup with a status column for misses and binary files."""
    f = files.select(REPO, "path", "binary", "content")
    j = requests.join(f, [REPO, "path"], "left")
    status = (F.when(F.col("binary").isNull(), F.lit("not_found"))
              .when(F.col("binary"), F.lit("binary")).otherwise(F.lit("ok")))
    return j.select(*requests.columns, status.alias("status"),
                    F.when(F.col("binary") == False, F.col("content")).alias("content"))  # noqa: E712


# --- J4 / W5: codeloom/operators/asof.py -------------------------------------------------

# --- J5 ------------------------------------------------------------------------------------

def unknown_hashes(mentions: DataFrame, commits: DataFrame, ref_col: str = "ref") -> DataFrame:
    """Mentioned hashes that are neither a known full hash nor a known short hash.

    Two equi anti joins (full, then short) instead of one OR join.
    """
    on = [REPO] if REPO in mentions.columns else []
    m = mentions.withColumn("_r", F.lower(F.col(ref_col)))
    full = commits.select(*on, F.lower("hash").alias("_r")).distinct()
    short = commits.select(*on, F.lower(X.short_hash(F.col("hash"))).alias("_r")).distinct()
    return m.join(full, [*on, "_r"], "left_anti").join(short, [*on, "_r"], "left_anti").drop("_r")


# --- J8 --------------------------------------------------------------------------------------

def upsert_commits(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Detailed rows overwrite basic ones column by column; unseen rows are appended."""
    key = key or [REPO, "hash"]
    cols = [c for c in old.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in cols if c in new.columns])
    j = o.join(n, key, "full_outer")
    return j.select(*key, *[(F.coalesce(F.col(f"_n_{c}"), F.col(f"_o_{c}")) if c in new.columns
                             else F.col(f"_o_{c}")).alias(c) for c in cols])


# --- J9 / J10 / J11 / J12 ----------------------------------------------------------------------

def symbol_search(names: DataFrame, symbols: DataFrame, kind: str = "any") -> DataFrame:
    """Query names x symbol index on ``name``; ``kind`` one of function/class/method/any."""
    s = symbols if kind == "any" else symbols.where(F.col("kind") == kind)
    s = s.where(F.col("kind").isin("function", "class", "method"))
    return names.join(s, "name")


def inheritance_edges(symbols: DataFrame) -> DataFrame:
    """Class -> base class resolved by simple name inside the repository."""
    classes = symbols.where(F.col("kind") == "class")
    edges = classes.select(REPO, F.col("path"), F.col("name").alias("class_name"),
                           F.explode("bases").alias("base_name"))
    targets = classes.select(REPO, F.col("name").alias("base_name"), F.col("path").alias("base_path"))
    return edges.join(targets, [REPO, "base_name"], "left")


def module_key(path) -> "F.Column":
    """Python module name a file provides: a/b.py -> a.b, a/b/__init__.py -> a.b."""
    p = F.regexp_replace(path, r"/__init__\.py$", "")
    p = F.regexp_replace(p, r"\.py$", "")
    return F.regexp_replace(p, "/", ".")


def import_edges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Import rows -> the repository file that provides the module (null when external).

    ``from a.b import c`` is the name a.b.c: the module a.b.c if the repository has it, else a.b.  The dots of
    a relative import, in ``parent``, count packages upwards from the importing file.
    """
    imports = symbols.where(F.col("kind") == "import").select(REPO, F.col("path"), F.col("name").alias("module"),
                                                              F.coalesce("parent", F.lit("")).alias("_dots"))
    dots = F.length("_dots")
    parts = F.split(F.regexp_replace("path", r"(^|/)[^/]*$", ""), "/")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), ".")
    full = F.when((dots == 0) | (up == ""), F.col("module")).otherwise(F.concat(up, F.lit("."), "module"))
    imports = imports.withColumn("_full", full).withColumn("_id", F.xxhash64(REPO, "path", "module", "_dots")).drop("_dots")
    tries = imports.select(REPO, "_id", F.explode(F.array(
        F.struct(F.lit(0).alias("order"), F.col("_full").alias("key")),
        F.struct(F.lit(1).alias("order"), F.regexp_replace("_full", r"\.[^.]*$", "").alias("key")))).alias("t"))
    provides = (files.where(F.col("path").endswith(".py"))
                .select(REPO, F.col("path").alias("target_path"), module_key(F.col("path")).alias("key")))
    found = (tries.select(REPO, "_id", "t.order", "t.key").distinct().join(provides, [REPO, "key"])
             .groupBy(REPO, "_id").agg(F.min(F.struct("order", "target_path"))["target_path"].alias("target_path")))
    return imports.join(found, [REPO, "_id"], "left").drop("_id", "_full")


def hot_spots(churn: DataFrame, file_scores: DataFrame) -> DataFrame:
    """Files with both churn and complexity, impact = churn x complexity."""
    j = churn.join(file_scores.select(REPO, "path", "complexity"), [REPO, "path"])
    return j.withColumn("impact", (F.col("insertions") + F.col("deletions")) * F.col("complexity"))


# --- W1 / W6 ------------------------------------------------------------------------------------

def recent_commits(commits: DataFrame, max_commits: int = 50) -> DataFrame:
    """The newest ``max_commits`` commits per repository (seq 0 = HEAD)."""
    w = Window.partitionBy(REPO).orderBy("seq")
    return commits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_commits).drop("_rn")


def commit_cadence(commits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Gap in seconds to the previous commit of the same repository (and author, if asked).

    Computed with month buckets (:mod:`codeloom.operators.ordered`), not one window per repository.
    """
    from codeloom.operators.ordered import month_bucket, previous_value
    by = by or [REPO]
    out = previous_value(commits, by, [F.col("author_ts"), F.col("hash")], month_bucket(F.col("author_ts")),
                         "author_ts", "prev_ts")
    # timestamp_diff works on wall-clock (NTZ) values: no session time zone involved
    return out.withColumn("gap_seconds", F.timestamp_diff("SECOND", F.col("prev_ts"), F.col("author_ts")))
