"""Streaming operators give the batch result."""

import datetime as dt
import os

from pyspark.sql import functions as F

from codeloom import schemas as S
from codeloom.streaming import live as L


def _commits(spark, rows):
    return spark.createDataFrame(rows, "repository_id string, hash string, author_ts timestamp, message string")


def test_commit_frequency_stream_equals_batch(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r1", f"h{i}", t0 + dt.timedelta(hours=7 * i), "m") for i in range(40)]
    df = _commits(spark, rows)
    src = os.path.join(scratch, "src")
    df.repartition(4).write.parquet(src)
    batch = {(r.repository_id, r.window_start, r.n_commits) for r in L.commit_frequency(df).collect()}
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (L.commit_frequency(stream).writeStream.outputMode("complete").format("memory")
         .queryName("freq_t3").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.repository_id, r.window_start, r.n_commits) for r in spark.sql("select * from freq_t3").collect()}
    assert got == batch


def test_ingest_commits_stores_each_hash_once(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r1", f"h{i % 5}", t0 + dt.timedelta(minutes=i), "m") for i in range(20)]
    df = _commits(spark, rows)
    src, sink, ck = (os.path.join(scratch, n) for n in ("src", "sink", "ck"))
    df.write.parquet(src)
    schema = df.schema
    q = L.ingest_commits(spark, src, schema, sink, ck)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 5 and out.select("hash").distinct().count() == 5


def test_ingest_keeps_late_commits_and_replays(spark, scratch):
    src, sink, ck = (os.path.join(scratch, n) for n in ("src", "sink", "ck"))
    new, old = dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 1) - dt.timedelta(days=400)
    first = _commits(spark, [("r1", "h1", new, "m"), ("r1", "h2", new, "m")])
    first.write.mode("append").parquet(src)
    L.ingest_commits(spark, src, first.schema, sink, ck).awaitTermination(120)
    second = _commits(spark, [("r1", "h2", new, "m"), ("r1", "h3", old, "m")])
    second.write.mode("append").parquet(src)
    L.ingest_commits(spark, src, first.schema, sink, ck).awaitTermination(120)
    stored = lambda: sorted((r["hash"], r["_batch"]) for r in spark.read.parquet(sink).collect())
    assert stored() == [("h1", 0), ("h2", 0), ("h3", 1)]
    L.store_batch(second, 1, sink)              # the last batch again, as after a crash before its commit
    assert stored() == [("h1", 0), ("h2", 0), ("h3", 1)]
    L.store_batch(first, 0, sink)
    assert stored() == [("h1", 0), ("h2", 0), ("h3", 1)]


def test_latest_value_batch_ttl(spark):
    asof = dt.datetime(2024, 1, 2, 12)
    df = spark.createDataFrame([("a", asof - dt.timedelta(hours=25), "x"), ("b", asof - dt.timedelta(hours=23), "y")],
                               "k string, ts timestamp, v string")
    out = {r.k: (r.status, r.v) for r in L.latest_value(df, ["k"], "ts", ["v"], F.lit(asof)).collect()}
    assert out == {"a": ("not_ready", None), "b": ("ready", "y")}


def test_sessions_stream_equals_batch(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    mins = [0, 10, 20, 100, 105, 300]
    df = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=m)) for m in mins], "user_id long, ts timestamp")
    batch = {(r.session_start, r.n_events) for r in L.sessions(df, "user_id", "ts").collect()}
    assert len(batch) == 3
    src = os.path.join(scratch, "ev")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = L.sessions(stream, "user_id", "ts").writeStream.outputMode("append").format("memory").queryName("sess_t5").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session_start, r.n_events) for r in spark.sql("select * from sess_t5").collect()}
    assert got <= batch  # append mode emits sessions closed by the watermark


def test_dedupe_schema_helper(spark):
    assert "hash" in S.COMMITS.fieldNames()


def test_latest_value_stream_expires(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0, "x"), ("b", t0 + dt.timedelta(hours=1), "y"), ("a", t0 + dt.timedelta(hours=30), "z"),
            ("c", t0 + dt.timedelta(hours=60), "w")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v string")
    src = os.path.join(scratch, "kv")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = L.latest_value_stream(stream, ["k"], "ts", "v", ttl_hours=24)
    q = out.writeStream.outputMode("update").format("memory").queryName("latest_t4").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.k, r.status, r.v) for r in spark.sql("select * from latest_t4").collect()}
    assert ("a", "ready", "z") in got and ("c", "ready", "w") in got


def test_issue_retrieval_stream(spark, scratch):
    from codeloom.sources import proxy as P
    from conftest import SF_SMALL
    ev = spark.createDataFrame([(1, "src1", "Question", "how does the order status change"),
                                (2, "src2", "Bug", "the parser fails on commit messages")],
                               "event_id long, repository_id string, title string, body string")
    src = os.path.join(scratch, "issues")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    sink, ck = os.path.join(scratch, "ctx"), os.path.join(scratch, "ck")
    q = L.issue_retrieval(stream, P.files(spark, SF_SMALL), P.commits(spark, SF_SMALL),
                          P.file_changes(spark, SF_SMALL), sink, ck)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == 2 and "relevant_files" in out.first().context_json


def test_ingest_batch_run_again_after_a_crash(spark, scratch):
    src, sink, ck = (os.path.join(scratch, n) for n in ("src", "sink", "ck"))
    t = dt.datetime(2024, 3, 1)
    first = _commits(spark, [("r1", "h1", t, "m"), ("r2", "h1", t, "m"), (None, "h9", t, "m"), (None, "h9", t, "m")])
    first.write.mode("append").parquet(src)
    L.ingest_commits(spark, src, first.schema, sink, ck).awaitTermination(120)
    _commits(spark, [("r1", "h1", t, "again"), ("r1", "h2", t, "m"), (None, "h9", t, "m")]).write.mode("append").parquet(src)
    L.ingest_commits(spark, src, first.schema, sink, ck).awaitTermination(120)
    stored = lambda: sorted((str(r["repository_id"]), r["hash"], r["_batch"]) for r in spark.read.parquet(sink).collect())
    want = [("None", "h9", 0), ("r1", "h1", 0), ("r1", "h2", 1), ("r2", "h1", 0)]
    assert stored() == want
    for name in ("1", ".1.crc"):                                 # a crash after the write and before the commit
        os.remove(os.path.join(ck, "commits", name))
    q = L.ingest_commits(spark, src, first.schema, sink, ck)
    q.awaitTermination(120)
    assert stored() == want
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider")


def test_a_batch_does_not_read_the_sink(spark, scratch, monkeypatch):
    src, sink, ck = (os.path.join(scratch, n) for n in ("src", "sink", "ck"))
    df = _commits(spark, [("r1", f"h{i}", dt.datetime(2024, 3, 1), "m") for i in range(10)])
    df.write.parquet(src)
    monkeypatch.setattr(L, "_earlier_batches", lambda *a: 1 / 0)
    q = L.ingest_commits(spark, src, df.schema, sink, ck)
    q.awaitTermination(120)
    assert q.exception() is None and spark.read.parquet(sink).count() == 10


def test_sessions_keep_their_last_event(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    files = [[(1, at(0), "a", 1.0), (1, at(50), "z", 2.0), (2, at(5), "b", 3.0)],
             [(1, at(25), "m", 4.0), (1, at(50), "zz", None), (1, at(10), "late", 9.0)],     # joins the two sessions of user 1
             [(3, at(100_000), "end", 0.0)]]
    cols = "user_id long, ts timestamp, kind string, value double"
    src = os.path.join(scratch, "ev")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, cols).coalesce(1).write.parquet(os.path.join(src, f"{i}"))
    every = spark.createDataFrame([r for f in files for r in f], cols)
    names = ["user_id", "session_start", "session_end", "n_events", "last_ts", "last_kind", "last_value"]
    batch = {tuple(r) for r in L.sessions(every, "user_id", "ts", payload=["kind", "value"]).select(*names).collect()}
    assert (1, at(0), at(80), 5, at(50), "zz", None) in batch and len(batch) == 3
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = (L.sessions(stream, "user_id", "ts", watermark="2 hours", payload=["kind", "value"]).select(*names)
         .writeStream.outputMode("append").format("memory").queryName("sess_state").start())
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select * from sess_state").collect()}
    assert got == {r for r in batch if r[0] != 3}                # the last session is still open


def test_latest_value_settles_ties(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0, v) for v in ("m", None, "z", "b")], "k string, ts timestamp, v string")
    out = L.latest_value(df, ["k"], "ts", ["v"], F.lit(t0))
    assert [r.v for r in out.collect()] == ["z"]
    src = os.path.join(scratch, "kv")
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = L.latest_value_stream(stream, ["k"], "ts", "v").writeStream.outputMode("update").format("memory").queryName("ties_t4").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from ties_t4").collect()[-1].v == "z"
