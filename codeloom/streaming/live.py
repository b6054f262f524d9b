"""Structured Streaming forms of the live inputs.

Each function takes a streaming DataFrame (or a path to read as a stream) and
returns either a streaming DataFrame or a started query.  Every stateful step
has a watermark so state is bounded (T1's keys stay, on RocksDB); sinks written from ``foreachBatch`` are
idempotent per batch id, so a replay after an executor or driver loss rewrites
the same output instead of duplicating it.  The same logic applied to a static
DataFrame gives the batch result the tests compare against.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

REPO = "repository_id"


# --- T1: commit ingest, each hash stored once --------------------------------------------

def _earlier_batches(spark: SparkSession, sink: str, batch_id: int) -> DataFrame | None:
    """Keys the batches before ``batch_id`` stored, or None before the first one."""
    keys = T.StructType([T.StructField(REPO, T.StringType()), T.StructField("hash", T.StringType()),
                         T.StructField("_batch", T.LongType())])
    try:
        stored = spark.read.schema(keys).parquet(sink)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return stored.where(F.col("_batch") < batch_id).select(REPO, "hash")   # a partition filter: own folder is not read


def store_batch(batch: DataFrame, batch_id: int, sink: str) -> None:
    """Write a batch's commits that no earlier batch stored, each once, as the folder ``_batch=batch_id``.

    The result depends on the batch and on earlier batches only, and replaces what an interrupted attempt
    left, so a replay gives the same table.
    """
    new = batch.dropDuplicates([REPO, "hash"])
    earlier = _earlier_batches(batch.sparkSession, sink, batch_id)
    if earlier is not None:
        new = new.join(earlier, [REPO, "hash"], "left_anti")
    new.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/_batch={batch_id}")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    """A setting for the queries started inside; the session's own value is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ingest_commits(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                   fmt: str = "parquet", available_now: bool = True):
    """File stream of commit exports -> commit table, each (repository, hash) once, one folder per batch.

    The keys seen so far are state on RocksDB, so a batch looks up its own keys and never reads the sink: its cost
    does not grow with the table.  There is no watermark: commit dates are not ordered, and a commit of any age is
    stored the first time it arrives.  A batch that is run again after a crash finds the state as it was before it
    and overwrites its own folder, so the table is the same.  ``store_batch`` does the same for single batches
    outside a stream, at the cost of reading the sink's keys.
    """
    src = spark.readStream.schema(schema).format(fmt).load(source)

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/_batch={batch_id}")
    w = src.dropDuplicates([REPO, "hash"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    with _conf(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        return w.start()


# --- T2: issue events -> retrieval context --------------------------------------------------

def issue_retrieval(stream: DataFrame, files: DataFrame, commits: DataFrame, changes: DataFrame,
                    sink: str, checkpoint: str, available_now: bool = True,
                    file_vectors=None, commit_vectors=None, embedder=None):
    """Each micro-batch of issue events becomes C4 context rows (stream-static joins).

    Top-k per question needs the whole candidate set, so it runs per batch in
    ``foreachBatch``; output is keyed by event id and overwritten per batch id.  With ``file_vectors`` and
    ``commit_vectors`` (tables kept by ``search.refresh_vectors``, or indexes of them) a batch embeds its own
    issues only.
    """
    from codeloom.operators.context import issue_context

    def write(batch: DataFrame, batch_id: int):
        ctx = issue_context(batch, files, commits, changes, file_vectors, commit_vectors, embedder)
        ctx.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/_batch={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# --- T3: commits per repository per day -------------------------------------------------------

def commit_frequency(df: DataFrame, ts_col: str = "author_ts", window: str = "1 day", slide: str | None = None,
                     watermark: str = "2 days") -> DataFrame:
    """Tumbling (or sliding) daily commit counts; late rows beyond the watermark are dropped."""
    # windows work on TIMESTAMP_NTZ directly, so day boundaries do not depend on the session zone
    d = df.withColumn("_ts", F.col(ts_col))
    if d.isStreaming:
        d = d.withWatermark("_ts", watermark)
    win = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    g = d.groupBy(REPO, win.alias("w")).agg(F.count("*").alias("n_commits"))
    return g.select(REPO, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_commits")


# --- T4: newest value per key, expiring -----------------------------------------------------

def latest_value(df: DataFrame, keys: list[str], ts_col: str, value_cols: list[str], asof, ttl_hours: int = 24):
    """T4 (batch): newest row per key written within ``ttl_hours`` before ``asof``; else status not_ready.

    Of rows with one time the greatest values win, column by column.
    """
    d = df.withColumn("_asof", asof)
    newest = d.groupBy(*keys).agg(F.max(F.struct(ts_col, *value_cols)).alias("_v"),
                                  F.first("_asof").alias("_asof"))
    ok = F.col(f"_v.{ts_col}") > (F.col("_asof") - F.make_interval(hours=F.lit(ttl_hours)))
    return newest.select(*keys, F.when(ok, F.lit("ready")).otherwise(F.lit("not_ready")).alias("status"),
                         *[F.when(ok, F.col(f"_v.{c}")).alias(c) for c in [ts_col, *value_cols]])


def latest_value_stream(stream: DataFrame, keys: list[str], ts_col: str, value_col: str, ttl_hours: int = 24,
                        watermark: str = "1 hour") -> DataFrame:
    """T4 (stream): per-key state holds the newest value; an event-time timer drops it
    ``ttl_hours`` after it was written and emits a ``not_ready`` row."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    key_schema = ", ".join(f"{k} string" for k in keys)
    out_schema = f"{key_schema}, status string, {ts_col} timestamp, {value_col} string"
    state_schema = f"{ts_col} timestamp, {value_col} string"
    ttl_ms = ttl_hours * 3600 * 1000

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([list(key) + ["not_ready", None, None]], columns=[*keys, "status", ts_col, value_col])
            return
        best = state.get if state.exists else None
        for pdf in pdfs:
            row = pdf.sort_values([ts_col, value_col], na_position="first").iloc[-1]
            new = (row[ts_col], row[value_col])
            if best is None or (new[0], new[1] is not None, new[1] or "") > (best[0], best[1] is not None, best[1] or ""):
                best = new
        state.update(best)
        state.setTimeoutTimestamp(int(pd.Timestamp(best[0]).value // 1_000_000) + ttl_ms)
        yield pd.DataFrame([list(key) + ["ready", best[0], best[1]]], columns=[*keys, "status", ts_col, value_col])

    s = stream.select(*[F.col(k).cast("string") for k in keys], F.col(ts_col).cast("timestamp"),
                      F.col(value_col).cast("string")).withWatermark(ts_col, watermark)
    return s.groupBy(*keys).applyInPandasWithState(fn, out_schema, state_schema, "update",
                                                   GroupStateTimeout.EventTimeTimeout)


# --- T5: sessions ---------------------------------------------------------------------------------

def sessions(df: DataFrame, key: str, ts_col: str, gap: str = "30 minutes", watermark: str = "1 hour",
             payload: list[str] | None = None) -> DataFrame:
    """T5: gap-based session windows per key: start, end (= last event + gap), number of events, time of the last
    event and, with ``payload``, its columns ``last_<column>``.

    The last event is aggregate state of the window: where a late event joins two sessions, the states are merged.
    Of events with one time the greatest payload is the last.
    """
    payload = payload or []
    d = df.withColumn("_ts", F.col(ts_col))
    if d.isStreaming:
        d = d.withWatermark("_ts", watermark)
    last = F.max(F.struct(F.col(ts_col).alias("last_ts"), *[F.col(c).alias(f"last_{c}") for c in payload])).alias("l")
    g = d.groupBy(key, F.session_window("_ts", gap).alias("s")).agg(F.count("*").alias("n_events"), last)
    return g.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events", "l.*")
