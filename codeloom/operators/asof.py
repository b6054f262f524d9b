"""As-of lookup as a range-partitioned sorted merge.

Versions and requests, without contents, are split by sampled ranges of (repository, path, ordinal) and sorted,
so a path with any number of requests is spread over as many tasks as its share of the rows.  One pass over a
range gives each request the last version before it.  A range also reports its last path and that path's newest
version; requests at the head of a range, whose version lies in an earlier one, take it from those reports, of
which there is one a range.  Contents are joined at the end, for the versions that were found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import stored

REPO = "repository_id"
FIRST = -(1 << 63)
_NO_ORDINAL, _VERSION, _REQUEST, _LAST = -1, 0, 1, 2


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it (nulls are equal); the first counts as different."""
    if len(column) < 2:
        return np.ones(len(column), bool)
    a, b = column[1:], column[:-1]
    both_null = pc.and_(a.is_null(), b.is_null())
    same = pc.fill_null(pc.equal(a, b), both_null)
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)])


def _merge(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Requests of one sorted range with the newest version before each, then the report of the range."""
    place = TaskContext.get().partitionId()
    path, version, head = None, None, True            # of the last row so far; ``head``: still the range's first path
    for b in batches:
        if not b.num_rows:
            continue
        n, kind = b.num_rows, b.column("kind").to_numpy(zero_copy_only=False)
        at, deleted = b.column("at").to_numpy(zero_copy_only=False), b.column("deleted").to_numpy(zero_copy_only=False)
        new = _changes(b.column(REPO)) | _changes(b.column("path"))
        here = (b.column(REPO)[0].as_py(), b.column("path")[0].as_py())
        goes_on = path == here                        # the first path goes on from the batch before
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        seen = np.maximum.accumulate(np.where(kind == _VERSION, np.arange(n), -1))
        known = seen >= begin
        v_at, v_deleted, has = at[seen], deleted[seen].astype(bool), known.copy()
        if goes_on and version is not None:
            v_at, v_deleted = np.where(known | (begin > 0), v_at, version[0]), np.where(known | (begin > 0), v_deleted, version[1])
            has |= begin == 0
        is_open = (begin == 0) & (head and (goes_on or path is None)) & ~has
        asked = np.flatnonzero(kind != _VERSION)
        take = pa.array(asked)
        mask = ~has[asked]
        yield pa.RecordBatch.from_arrays(
            [b.column(REPO).take(take), b.column("path").take(take), b.column("request").take(take), b.column("ordinal").take(take),
             pa.array(kind[asked], pa.int32()), pa.array(np.full(len(asked), place), pa.int32()), pa.array(is_open[asked]),
             pa.array(v_at[asked], pa.int64(), mask=mask), pa.array(v_deleted[asked], pa.bool_(), mask=mask)], schema=schema)
        head = head and not new[1:].any() and (goes_on or path is None)
        path = (b.column(REPO)[n - 1].as_py(), b.column("path")[n - 1].as_py())
        version = (int(v_at[-1]), bool(v_deleted[-1])) if has[-1] else None
    if path is not None:
        row = {REPO: path[0], "path": path[1], "request": None, "ordinal": None, "kind": _LAST, "place": place, "open": False,
               "v_at": version and version[0], "v_deleted": version and version[1]}
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def content_at(requests: DataFrame, versions: DataFrame, ranges: int | None = None) -> DataFrame:
    """The version of each (repository, path) current at the request's ordinal.

    ``versions(repository_id, path, ordinal, deleted, content)``,
    ``requests(request_id, repository_id, path, ordinal)`` ->
    ``(request_id, repository_id, path, ordinal, version_ordinal, content, status)``.
    A version with ``ordinal <= request.ordinal`` applies; the newest such one wins and a deleted or absent one
    gives ``not found in commit``, as do requests with a null path or ordinal.  Of versions of one path and
    ordinal a live one goes before a deleted one, then the greatest content.  ``ranges`` is the number of ranges
    (the session's shuffle partitions by default).
    """
    keys = [REPO, "path"]
    live = versions.where(F.col(REPO).isNotNull() & F.col("path").isNotNull() & F.col("ordinal").isNotNull())
    no_request = F.lit(None).cast(requests.schema["request_id"].dataType)
    v = live.select(*keys, F.col("ordinal").cast("long").alias("at"), F.lit(_VERSION).alias("kind"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
                    no_request.alias("request"), F.lit(None).cast("long").alias("ordinal"))
    at = F.col("ordinal").cast("long")
    r = requests.select(*keys, F.coalesce(at, F.lit(FIRST)).alias("at"), F.when(at.isNull(), _NO_ORDINAL).otherwise(_REQUEST).alias("kind"),
                        F.lit(False).alias("deleted"), F.col("request_id").alias("request"), at.alias("ordinal"))
    both = v.unionByName(r)
    order = [*keys, "at", "kind"]
    split = both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)
    split = split.sortWithinPartitions(*order, F.col("deleted").desc())
    kinds = {f.name: f.dataType for f in both.schema.fields}
    out = T.StructType([T.StructField(c, kinds[c]) for c in (*keys, "request", "ordinal")]
                       + T.StructType.fromDDL("kind int, place int, open boolean, v_at long, v_deleted boolean").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        yield from _merge(batches, to_arrow_schema(out))
    merged = stored(split.mapInArrow(run, out))
    return _found(merged, live, requests, keys)


def _found(merged: DataFrame, live: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("v_at").isNotNull(), F.struct("v_at", "v_deleted")), ignorenulls=True).over(last)
    # a row a range that begins inside a path: the newest version the ranges before it saw
    heads = (merged.where(F.col("kind") == _LAST).select(*keys, "place", "v_at", "v_deleted")
             .unionByName(merged.where("open").select(*keys, "place").distinct()
                          .withColumn("v_at", F.lit(None).cast("long")).withColumn("v_deleted", F.lit(None).cast("boolean")))
             .groupBy(*keys, "place").agg(F.max("v_at").alias("v_at"), F.max_by("v_deleted", "v_at").alias("v_deleted"))
             .select(*keys, "place", carried.alias("c")).where("c is not null")
             .select(*keys, "place", F.lit(True).alias("open"), F.col("c.v_at").alias("c_at"), F.col("c.v_deleted").alias("c_deleted")))
    asked = merged.where(F.col("kind") != _LAST).join(heads, [*keys, "place", "open"], "left")
    null = F.lit(None)
    no_ordinal = F.col("kind") == _NO_ORDINAL
    v_at = F.when(no_ordinal, null).otherwise(F.coalesce("v_at", "c_at"))
    v_deleted = F.when(F.col("v_at").isNotNull(), F.col("v_deleted")).otherwise(F.col("c_deleted"))
    asked = asked.select(F.col("request").alias("request_id"), *keys, "ordinal",
                         F.when(~v_deleted, v_at).alias("version_ordinal"))
    wanted = asked.where("version_ordinal is not null").select(*keys, F.col("version_ordinal").alias("v")).distinct()
    contents = (live.where("deleted is null or not deleted").select(*keys, F.col("ordinal").cast("long").alias("v"), "content")
                .join(wanted, [*keys, "v"], "left_semi").groupBy(*keys, "v").agg(F.max("content").alias("content"))
                .withColumnRenamed("v", "version_ordinal"))
    kind = requests.schema["ordinal"].dataType
    return (asked.join(contents, [*keys, "version_ordinal"], "left")
            .select("request_id", *keys, F.col("ordinal").cast(kind).alias("ordinal"), "version_ordinal", "content",
                    F.when(F.col("version_ordinal").isNotNull(), "ok").otherwise("not found in commit").alias("status")))
