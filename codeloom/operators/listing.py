"""Listings and previews: ordering operators over bounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPO = "repository_id"


def functions_by_complexity(function_metrics: DataFrame) -> DataFrame:
    """K3: functions of each file ordered by complexity, highest first (missing complexity as 0)."""
    c = F.coalesce(F.col("complexity").cast("double"), F.lit(0.0))
    w = Window.partitionBy(REPO, "path").orderBy(c.desc(), F.col("line_number"), F.col("name"), F.col("kind"))
    return function_metrics.withColumn("position", F.row_number().over(w))


def file_tree(files: DataFrame) -> DataFrame:
    """Flat tree ``(repository_id, node_path, parent_path, name, depth, is_dir)``: every file and
    every ancestor directory once (the nested-dict tree has unbounded depth, so it stays flat)."""
    parts = F.split(F.col("path"), "/")
    n = F.size(parts)
    # sequence(1, 0) counts down in Spark, so root files get an explicit empty list
    levels = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    dirs = files.select(REPO, F.explode(F.transform(levels, lambda i: F.array_join(F.slice(parts, 1, i), "/")))
                        .alias("node_path"))
    dirs = dirs.where(F.col("node_path").isNotNull()).distinct().withColumn("is_dir", F.lit(True))
    leaves = files.select(REPO, F.col("path").alias("node_path"), F.lit(False).alias("is_dir"))
    nodes = dirs.unionByName(leaves)
    return nodes.select(REPO, "node_path",
                        F.regexp_extract("node_path", r"^(.*)/[^/]*$", 1).alias("parent_path"),
                        F.element_at(F.split("node_path", "/"), -1).alias("name"),
                        (F.size(F.split("node_path", "/")) - 1).alias("depth"), "is_dir")


def tree_listing(tree: DataFrame) -> DataFrame:
    """K4: sibling order - folders first, then name case-insensitively (locale order approximated)."""
    from codeloom.operators.ordered import ordered_position
    # bucket (folders first, then a lower-cased name prefix) is monotone in the listing order,
    # so a directory with a huge number of entries is ranked by many tasks
    bucket = F.concat(F.when(F.col("is_dir"), F.lit("0")).otherwise(F.lit("1")), F.substring(F.lower("name"), 1, 2))
    pos = ordered_position(tree, [REPO, "parent_path"], [F.col("is_dir").desc(), F.lower("name"), F.col("name")],
                           bucket, name="position")
    return pos.withColumn("position", F.col("position") + 1)


def change_preview(changes: DataFrame, n: int = 10, keys: list[str] | None = None) -> DataFrame:
    """K5: the first ``n`` changes of each commit (path order) and how many more there are."""
    keys = keys or [REPO, "hash"]
    w = Window.partitionBy(*keys).orderBy("path", "change_type")
    wc = Window.partitionBy(*keys)
    r = changes.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(wc))
    top = r.where(F.col("_rn") <= n)
    return top.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "path"))), lambda s: s["path"]), ", ")
        .alias("preview"),
        F.greatest(F.max("_n") - n, F.lit(0)).cast("long").alias("n_more"))
