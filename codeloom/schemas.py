"""Fixed schemas of the repository model, checked once at the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("repository_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("binary", T.BooleanType()),
    T.StructField("content", T.StringType()),
])

FILE_CHANGE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("old_path", T.StringType()),
    T.StructField("change_type", T.StringType()),
    T.StructField("insertions", T.LongType()),
    T.StructField("deletions", T.LongType()),
    T.StructField("patch", T.StringType()),
    T.StructField("parent_no", T.IntegerType()),
])

COMMITS = T.StructType([
    T.StructField("repository_id", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("parents", T.ArrayType(T.StringType())),
    T.StructField("author_name", T.StringType()),
    T.StructField("author_email", T.StringType()),
    T.StructField("author_ts", T.TimestampType()),
    T.StructField("committer_ts", T.TimestampType()),
    T.StructField("message", T.StringType()),
    T.StructField("seq", T.LongType()),
])

# Exported commit log (S2): a commit row with its changes nested.
COMMIT_LOG = T.StructType(list(COMMITS.fields) + [
    T.StructField("file_changes", T.ArrayType(FILE_CHANGE)),
])

MESSAGES = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

SYMBOLS = T.StructType([
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
    T.StructField("error", T.StringType()),
])


def check(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, failing early when one is missing."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
