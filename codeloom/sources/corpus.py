"""Sources and sinks of the repository model (S1..S6).

Every reader returns the fixed schema of :mod:`codeloom.schemas`; writers persist
the star schema partitioned by ``repository_id`` so later jobs prune by repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import schemas as S
from codeloom.functions import exprs as X


def scan_files(raw: DataFrame, path_col: str = "path", text_col: str = "text",
               bytes_col: str | None = None, include_hidden: bool = False) -> DataFrame:
    """Clone listing -> ``files(repository_id, path, size, binary, content)``.

    ``raw`` holds one row per file with either decoded text or raw bytes.  Hidden
    files (any path component starting with '.') are dropped unless asked for;
    a binary extension or undecodable bytes make the row binary with null content.
    """
    path = F.col(path_col)
    out = raw
    if not include_hidden:
        out = out.where(~X.is_hidden(path))
    if bytes_col is not None:
        b = F.col(bytes_col)
        decoded = F.try_validate_utf8(b.cast("string")) if hasattr(F, "try_validate_utf8") else b.cast("string")
        valid = F.coalesce(F.is_valid_utf8(b.cast("string")), F.lit(False))     # a file that could not be read has no text
        text = F.when(valid, decoded)
        size = F.length(b)
    else:
        text = F.col(text_col)
        valid = F.lit(True)
        size = F.col("size") if "size" in raw.columns else F.length(text)
    binary = X.is_binary_path(path) | ~valid
    keep = [c for c in raw.columns if c not in {path_col, text_col, "size", "repository_id"} and c != bytes_col]
    return out.select(
        F.col("repository_id"), path.alias("path"), *keep,
        size.cast("long").alias("size"),
        binary.alias("binary"),
        F.when(binary, F.lit(None).cast("string")).otherwise(text).alias("content"),
    )


def read_raw_tree(spark: SparkSession, root: str, repository_id: str) -> DataFrame:
    """S1 secondary source: bytes of every file under ``root`` via the binaryFile reader.

    Spark's file index skips names starting with '_' (``__init__.py``); a listing made
    by the caller and read with :func:`read_listed_files` covers those.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))
    prefix = root.rstrip("/") + "/"
    rel = F.substring(F.regexp_replace(F.col("path"), "^file:", ""), len(prefix) + 1, 1 << 30)
    return df.select(F.lit(repository_id).alias("repository_id"), rel.alias("path"), F.col("content").alias("bytes"))


def read_listed_files(spark: SparkSession, listing: DataFrame, root_col: str = "root") -> DataFrame:
    """S1 for a caller-made listing ``(repository_id, root, path)``; bytes read on executors.

    The listing is a table, so reading parallelises across tasks; it needs a file
    system every executor can see.
    """
    import pandas as pd

    def read(batches):
        for pdf in batches:
            data = []
            for root, rel in zip(pdf[root_col], pdf["path"]):
                try:
                    with open(f"{root.rstrip('/')}/{rel}", "rb") as fh:
                        data.append(fh.read())
                except OSError:
                    data.append(None)
            yield pd.DataFrame({"repository_id": pdf["repository_id"], "path": pdf["path"], "bytes": data})

    return listing.mapInPandas(read, "repository_id string, path string, bytes binary")


def read_commits(spark: SparkSession, path: str, fmt: str = "json"):
    """Exported commit log -> (commits, file_changes).

    Rows carry ``file_changes`` as an array; the flat change table is an explode.
    """
    df = spark.read.schema(S.COMMIT_LOG).format(fmt).load(path)
    commits = df.select(*[c for c in df.columns if c != "file_changes"],
                        X.py_strip(F.col("message")).alias("_m")).drop("message").withColumnRenamed("_m", "message")
    changes = df.select("repository_id", "hash", F.explode("file_changes").alias("fc")).select(
        "repository_id", "hash", "fc.*")
    return commits, changes


API_COMMIT = T.StructType([
    T.StructField("sha", T.StringType()),
    T.StructField("commit", T.StructType([
        T.StructField("message", T.StringType()),
        T.StructField("author", T.StructType([
            T.StructField("name", T.StringType()), T.StructField("email", T.StringType()),
            T.StructField("date", T.StringType())]))])),
    T.StructField("files", T.ArrayType(T.StructType([
        T.StructField("filename", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("additions", T.LongType()), T.StructField("deletions", T.LongType()),
        T.StructField("patch", T.StringType())]))),
])


def api_change_type(status: Column) -> Column:
    return (F.when(status == "added", "added").when(status == "removed", "deleted")
            .when(status == "renamed", "renamed").otherwise("modified"))


def read_api_commits(payloads: DataFrame, json_col: str = "payload"):
    """S3: hosted-API commit documents -> (commits, file_changes), no shuffle.

    Stats come from the ``files`` array with ``aggregate`` (files_changed = its size).
    """
    d = payloads.select("repository_id", F.from_json(F.col(json_col), API_COMMIT).alias("c"))
    files = F.coalesce(F.col("c.files"), F.array().cast(API_COMMIT["files"].dataType))
    commits = d.select(
        "repository_id",
        F.col("c.sha").alias("hash"),
        X.short_hash(F.col("c.sha")).alias("short_hash"),
        X.author_display(F.col("c.commit.author.name"), F.col("c.commit.author.email")).alias("author"),
        F.col("c.commit.author.date").alias("date"),
        X.py_strip(F.col("c.commit.message")).alias("message"),
        F.size(files).cast("long").alias("files_changed"),
        F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["additions"], F.lit(0))).alias("insertions"),
        F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["deletions"], F.lit(0))).alias("deletions"),
    )
    changes = d.select("repository_id", F.col("c.sha").alias("hash"), F.explode("c.files").alias("f")).select(
        "repository_id", "hash", F.col("f.filename").alias("path"),
        api_change_type(F.col("f.status")).alias("change_type"),
        F.col("f.additions").alias("insertions"), F.col("f.deletions").alias("deletions"),
        F.col("f.patch").alias("patch"))
    return commits, changes


def read_issue_events(events: DataFrame) -> DataFrame:
    """Issue / comment events -> (event_id, number, title, body, author, created_at).

    The body is the issue's for ``issues`` events and the comment's for
    ``issue_comment``; other event names are rejected (filtered out).
    """
    ok = events.where(F.col("event_name").isin("issues", "issue_comment"))
    is_issue = F.col("event_name") == "issues"
    return ok.select(
        "event_id", "event_name",
        F.col("issue.number").alias("number"),
        F.col("issue.title").alias("title"),
        F.when(is_issue, F.col("issue.body")).otherwise(F.col("comment.body")).alias("body"),
        F.when(is_issue, F.col("issue.user.login")).otherwise(F.col("comment.user.login")).alias("author"),
        F.when(is_issue, F.col("issue.created_at")).otherwise(F.col("comment.created_at")).alias("created_at"),
    )


def write_corpus(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Persist the star schema, one folder per table, partitioned by repository."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        if "repository_id" in df.columns:
            w = w.partitionBy("repository_id")
        w.parquet(f"{path.rstrip('/')}/{name}")


def to_context_json(df: DataFrame, cols: list[str] | None = None, out: str = "context") -> DataFrame:
    """One JSON text per row from the given (possibly nested) columns."""
    cols = cols or [c for c in df.columns if c != "query_id"]
    return df.select(*(["query_id"] if "query_id" in df.columns else []),
                     F.to_json(F.struct(*cols)).alias(out))
