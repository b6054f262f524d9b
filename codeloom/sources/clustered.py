"""The corpus as bucketed tables, so that joins and groupings by commit or by path read it without a shuffle.

Commits and changes lie in buckets of (repository, hash), files and a second copy of the changes in buckets of
(repository, path).  One write gives a bucket one file, sorted by its key.  A repository with a third of all rows
spreads over all buckets.  The small table ``layout`` beside the tables names their keys, columns and numbers of
buckets, so that any session can open them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = "repository_id"
# stored table: the table it is a copy of, and the second bucket key beside the repository
LAYOUT = {
    "commits": ("commits", "hash"),
    "changes": ("changes", "hash"),
    "changes_by_path": ("changes", "path"),
    "files": ("files", "path"),
}


LAYOUT_SCHEMA = "name string, key string, buckets int, columns string"


def _layout(spark: SparkSession, root: str) -> list:
    return spark.read.schema(LAYOUT_SCHEMA).parquet(f"{root}/layout").orderBy("name").collect()


def write_clustered(tables: dict[str, DataFrame], path: str, name: str = "corpus", buckets: int = 200,
                    mode: str = "overwrite") -> dict[str, DataFrame]:
    """Store ``commits``, ``changes`` and ``files`` (those given) under ``path``, as tables ``<name>_<table>`` of the catalog.

    ``append`` adds the rows as new files of the buckets; files that are there are neither read nor written, and the
    number of buckets stays.  Commits that are stored already must be left out first (J5 ``unknown_hashes``).
    Returns the stored tables, as :func:`open_clustered`.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode {mode!r} is neither overwrite nor append")
    unknown = set(tables) - {source for source, _ in LAYOUT.values()}
    if unknown or not tables:
        raise ValueError(f"tables to cluster: {sorted(tables)}")
    root = path.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    kept = {}
    if mode == "append":
        kept = {row.name: row.buckets for row in _layout(spark, root)}
        open_clustered(spark, root, name)
    wanted = {t: (source, key) for t, (source, key) in LAYOUT.items() if source in tables}
    missing = sorted(set(wanted) - set(kept)) if mode == "append" else []
    if missing:
        raise ValueError(f"not stored under {root}: {missing}")
    for t, (source, key) in wanted.items():
        n = kept.get(t, buckets)
        if mode == "overwrite":
            spark.sql(f"DROP TABLE IF EXISTS `{name}_{t}`")
        # dealt as the buckets are, so a task writes one file
        (tables[source].repartition(n, REPO, key).write.mode(mode).format("parquet").bucketBy(n, REPO, key)
         .sortBy(REPO, key).option("path", f"{root}/{t}").saveAsTable(f"`{name}_{t}`"))
    if mode == "overwrite":
        rows = [(t, key, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables[source].schema))
                for t, (source, key) in wanted.items()]
        spark.createDataFrame(rows, LAYOUT_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{root}/layout")
    return open_clustered(spark, root, name)


def open_clustered(spark: SparkSession, path: str, name: str = "corpus") -> dict[str, DataFrame]:
    """The tables stored under ``path``, entered in the catalog as ``<name>_<table>`` with their buckets."""
    root = path.rstrip("/")
    out = {}
    for row in _layout(spark, root):
        table, at = f"`{name}_{row.name}`", f"{root}/{row.name}"
        keys = f"`{REPO}`, `{row.key}`"
        spark.sql(f"DROP TABLE IF EXISTS {table}")            # the entry only: the files are not the catalog's
        spark.sql(f"CREATE TABLE {table} ({row.columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                  f"INTO {row.buckets} BUCKETS LOCATION '{at}'")
        out[row.name] = spark.table(table)
    return out


def commit_changes_of(tables: dict[str, DataFrame], hashes: DataFrame) -> DataFrame:
    """The stored changes of the asked commits (repository_id, hash): only the asked side is shuffled, to the buckets."""
    return tables["changes"].join(hashes.select(REPO, F.col("hash")).distinct(), [REPO, "hash"], "left_semi")
