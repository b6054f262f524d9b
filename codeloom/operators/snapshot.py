"""Snapshot comparison: two file tables in, per-path status out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T

REPO = "repository_id"


NO_CONTENT = "none:"


def _digest(files: DataFrame):
    """What two versions of a file are compared by."""
    own = F.col("digest") if "digest" in files.columns else F.lit(None).cast("string")
    size = F.col("size").cast("string") if "size" in files.columns else F.lit("")
    return F.coalesce(own, F.sha2("content", 256), F.concat(F.lit(NO_CONTENT), F.coalesce(size, F.lit(""))))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added / deleted / modified / renamed / unchanged per path.

    A full outer join on (repository, path) compares SHA-256 digests.  Renames
    pair deleted and added paths that carry the same digest, one to one in path
    order (path rank within (repository, digest) on each side, then an equi join
    on the pair number).  A file without content (binary) is compared by the
    column ``digest`` if there is one, else by ``size``, and is never paired by
    size alone.  With a column ``binary`` on both sides the result has it too.
    """
    flag = "binary" in old.columns and "binary" in new.columns
    o = old.select(REPO, "path", _digest(old).alias("d_old"), *([F.col("binary").alias("b_old")] if flag else []))
    n = new.select(REPO, "path", _digest(new).alias("d_new"), *([F.col("binary").alias("b_new")] if flag else []))
    # five branches read the joined digests: write them once (narrow: path + two digests)
    from codeloom.session import cut_lineage
    j = cut_lineage(o.join(n, [REPO, "path"], "full_outer"))
    both = j.where(F.col("d_old").isNotNull() & F.col("d_new").isNotNull()).select(
        REPO, "path", F.lit(None).cast("string").alias("old_path"),
        F.when(F.col("d_old") == F.col("d_new"), "unchanged").otherwise("modified").alias("status"))
    gone = j.where(F.col("d_new").isNull()).select(REPO, "path", F.col("d_old").alias("digest"))
    came = j.where(F.col("d_old").isNull()).select(REPO, "path", F.col("d_new").alias("digest"))
    # pair number = path rank inside (repository, digest); bucketed by a path prefix
    # (monotone in path order) so a digest shared by very many files is not one task
    from codeloom.operators.ordered import ordered_position
    prefix = F.substring("path", 1, 3)
    g = ordered_position(gone, [REPO, "digest"], [F.col("path")], prefix, name="pair")
    c = ordered_position(came, [REPO, "digest"], [F.col("path")], prefix, name="pair")
    pairs = g.where(~F.col("digest").startswith(NO_CONTENT)).select(REPO, "digest", "pair", F.col("path").alias("old_path")).join(
        c.select(REPO, "digest", "pair", F.col("path").alias("new_path")), [REPO, "digest", "pair"])
    renamed = pairs.select(REPO, F.col("new_path").alias("path"), "old_path", F.lit("renamed").alias("status"))
    added = c.join(pairs.select(REPO, F.col("new_path").alias("path")), [REPO, "path"], "left_anti").select(
        REPO, "path", F.lit(None).cast("string").alias("old_path"), F.lit("added").alias("status"))
    deleted = g.join(pairs.select(REPO, F.col("old_path").alias("path")), [REPO, "path"], "left_anti").select(
        REPO, "path", F.lit(None).cast("string").alias("old_path"), F.lit("deleted").alias("status"))
    out = both.unionByName(renamed).unionByName(added).unionByName(deleted)
    if not flag:
        return out
    return out.join(j.select(REPO, "path", F.coalesce("b_new", "b_old").alias("binary")), [REPO, "path"])


def line_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insertions / deletions per path as the multiset difference of lines.

    Lines are exploded and a signed count per (path, line) is aggregated; this
    equals ``exceptAll`` both ways.  Moved lines count as unchanged (unlike an LCS diff).
    """
    def lines(df, sign):
        return df.select(REPO, "path", F.explode(T.splitlines(F.coalesce("content", F.lit("")))).alias("line"),
                         F.lit(sign).alias("s"))

    u = lines(old, -1).unionByName(lines(new, 1))
    per = u.groupBy(REPO, "path", "line").agg(F.sum("s").alias("d"))
    return per.groupBy(REPO, "path").agg(
        F.sum(F.greatest("d", F.lit(0))).cast("long").alias("insertions"),
        F.sum(F.greatest(-F.col("d"), F.lit(0))).cast("long").alias("deletions"))


def merge_parent_changes(changes: DataFrame, merge_mode: str = "first_parent") -> DataFrame:
    """``first_parent`` keeps the diff to parent 0; ``all_parents`` keeps every parent's rows."""
    if merge_mode == "first_parent":
        return changes.where(F.col("parent_no") == 0)
    return changes


def classify_change(diff: DataFrame) -> DataFrame:
    """The reference's per-file message for a snapshot_diff row (plus binary / mode flags if present)."""
    cols = diff.columns
    binary = F.col("binary") if "binary" in cols else F.lit(False)
    mode_only = F.col("mode_changed") if "mode_changed" in cols else F.lit(False)
    msg = (F.when((F.col("status") == "added") & binary, "File was added in this commit (binary content)")
           .when((F.col("status") == "deleted") & binary, "File was deleted in this commit (binary content)")
           .when(F.col("status") == "added", "File was added in this commit:")
           .when(F.col("status") == "deleted", "File was deleted in this commit. Previous content:")
           .when(F.col("status") == "renamed", F.concat(F.lit("File was renamed in this commit from "), F.col("old_path")))
           .when(binary, "Binary file (no text diff available)")
           .when((F.col("status") == "unchanged") & mode_only, "File metadata changed (permissions or mode)")
           .when(F.col("status") == "unchanged", "No changes detected in this file for this commit")
           .otherwise(F.lit(None)))
    return diff.withColumn("message", msg)
