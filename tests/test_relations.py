"""Joins, windows, snapshots and retrieval against hand-computed fixtures (FIXTURES 3.5)."""

import math

from pyspark.sql import functions as F

from codeloom.operators import joins as J
from codeloom.operators import search as K
from codeloom.operators import snapshot as SN


def test_resolve_hashes_prefix_and_ambiguity(spark):
    commits = spark.createDataFrame([("abcdef12" + "0" * 32, 0), ("abcdef13" + "0" * 32, 1)], "hash string, seq long")
    refs = spark.createDataFrame([(1, "abcdef1"), (2, "ABCDEF13"), (3, "abc"), (4, "ffffffff")], "ref_id int, ref string")
    out = {r.ref_id: r for r in J.resolve_hashes(refs, commits).collect()}
    assert out[1].seq == 0 and out[1].match_count == 2
    assert out[2].seq == 1 and out[2].match_count == 1
    assert out[3].seq == 0 and out[3].match_count == 2 and out[4].hash is None      # references of any length resolve
    kept = {r.ref_id: r.hash for r in J.resolve_hashes(refs, commits, min_len=4).collect()}
    assert kept[3] is None and kept[1] is not None


def test_resolve_hashes_plan_is_equi_join(spark):
    commits = spark.createDataFrame([("abcdef12" + "0" * 32, 0)], "hash string, seq long")
    refs = spark.createDataFrame([(1, "abcdef1")], "ref_id int, ref string")
    plan = J.resolve_hashes(refs, commits)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_resolve_hashes_reads_each_ref_once(spark):
    commits = spark.createDataFrame([("abcdef12" + "0" * 32, 0), ("abcdef13" + "0" * 32, 1)], "hash string, seq long")
    reads = spark.sparkContext.accumulator(0)

    def typed(i):
        reads.add(1)
        return [" #ABC\u2003", "abcdef1", "abcdef13", "a", None, "zz", "abcdef130000x"][i % 7]
    refs = spark.range(70).select(F.col("id").alias("ref_id"), F.udf(typed, "string")("id").alias("ref"))
    got = {(r.normalized, r.seq, r.match_count) for r in J.resolve_hashes(refs, commits).collect()}
    assert got == {("abc", 0, 2), ("abcdef1", 0, 2), ("abcdef13", 1, 1), ("a", 0, 2), (None, None, 0), ("abcdef130000", 1, 1)}
    assert reads.value == 70


def test_content_at_asof(spark):
    ver = spark.createDataFrame([("r", "p", 3, False, "v3"), ("r", "p", 5, False, "v5"), ("r", "p", 8, True, None)],
                                "repository_id string, path string, ordinal long, deleted boolean, content string")
    req = spark.createDataFrame([(i, "r", "p", o) for i, o in enumerate([2, 4, 7, 8, 20])],
                                "request_id long, repository_id string, path string, ordinal long")
    for ranges in (1, 4, None):
        got = {r.ordinal: (r.status, r.content) for r in J.content_at(req, ver, ranges).collect()}
        assert got == {2: ("not found in commit", None), 4: ("ok", "v3"), 7: ("ok", "v5"),
                       8: ("not found in commit", None), 20: ("not found in commit", None)}


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")],
                                "repository_id string, path string, content string")
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "9"), ("r", "d", "3")],
                                "repository_id string, path string, content string")
    got = {(r.path, r.status, r.old_path) for r in SN.snapshot_diff(old, new).collect()}
    assert got == {("a", "unchanged", None), ("b", "modified", None), ("d", "renamed", "c")}
    delta = {r.path: (r.insertions, r.deletions) for r in SN.line_delta(old, new).collect()}
    assert delta["b"] == (1, 1) and delta["a"] == (0, 0)


def test_snapshot_diff_of_binaries(spark):
    cols = "repository_id string, path string, content string, binary boolean, size long"
    old = spark.createDataFrame([("r", "a.png", None, True, 10), ("r", "b.png", None, True, 5), ("r", "gone.png", None, True, 7),
                                 ("r", "t", "x", False, 1)], cols)
    new = spark.createDataFrame([("r", "a.png", None, True, 99), ("r", "b.png", None, True, 5), ("r", "came.zip", None, True, 7),
                                 ("r", "t2", "x", False, 1)], cols)
    d = SN.classify_change(SN.snapshot_diff(old, new))
    got = {r.path: (r.status, r.old_path, r.binary, r.message) for r in d.collect()}
    assert got["a.png"] == ("modified", None, True, "Binary file (no text diff available)")
    assert got["b.png"][0] == "unchanged" and got["t2"][:3] == ("renamed", "t", False)
    assert got["gone.png"][0] == "deleted" and got["came.zip"] == ("added", None, True, "File was added in this commit (binary content)")


def test_merge_parent_policy(spark):
    ch = spark.createDataFrame([("m", "x", 0), ("m", "x", 1)], "hash string, path string, parent_no int")
    assert SN.merge_parent_changes(ch, "all_parents").count() == 2
    assert SN.merge_parent_changes(ch, "first_parent").count() == 1


def test_cap_changes(spark):
    ch = spark.createDataFrame([("r", "h", f"f{i:03d}") for i in range(250)], "repository_id string, hash string, path string")
    out = J.cap_changes(ch, 200)
    assert out.count() == 200
    assert {r.note for r in out.select("note").distinct().collect()} == {"Display limited to 200 files"}
    assert out.agg(F.max("files_changed")).first()[0] == 200


def test_unknown_hashes(spark):
    commits = spark.createDataFrame([("abcdef1234",)], "hash string")
    m = spark.createDataFrame([("abcdef1",), ("abcdef1234",), ("1234567",)], "ref string")
    assert [r.ref for r in J.unknown_hashes(m, commits).collect()] == ["1234567"]


def test_upsert(spark):
    old = spark.createDataFrame([("r", "a", 0), ("r", "b", 0)], "repository_id string, hash string, n int")
    new = spark.createDataFrame([("r", "b", 5), ("r", "c", 7)], "repository_id string, hash string, n int")
    got = {r.hash: r.n for r in J.upsert_commits(old, new).collect()}
    assert got == {"a": 0, "b": 5, "c": 7}


def test_cosine_top_k_fixture(spark):
    corpus = spark.createDataFrame([("file1.py", [0.1, 0.2, 0.3]), ("file2.py", [0.4, 0.5, 0.6])],
                                   "key string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.4, 0.5, 0.6])], "query_id int, embedding array<float>")
    out = K.cosine_top_k(q, corpus, k=2).orderBy("rank").collect()
    assert [r.key for r in out] == ["file2.py", "file1.py"]
    assert math.isclose(out[0].score, 1.0, abs_tol=1e-6) and math.isclose(out[1].score, 0.974632, abs_tol=1e-6)
    assert [r.key for r in K.cosine_top_k(q, corpus, k=1).collect()] == ["file2.py"]


def test_search_commits_history_order(spark):
    commits = spark.createDataFrame(
        [(f"h{i}", i, [1.0, float(i)]) for i in range(6)], "hash string, seq long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, embedding array<double>")
    out = K.search_commits(q, commits, k=5).orderBy("position").collect()
    assert len(out) == 5 and [r.seq for r in out] == sorted(r.seq for r in out)
    assert out[-1].hash == "h5" and out[-1].rank == 1
    assert K.search_commits(q, commits, k=5, limit_after=3).count() == 3


def test_bm25_fixture(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "c")], "query_id int, text string")
    out = K.bm25_search(q, K.bm25_index(docs), k=5).collect()
    assert len(out) == 1 and out[0].doc_id == 2 and math.isclose(out[0].score, 0.635915, abs_tol=1e-6)


def test_hybrid(spark):
    bm = spark.createDataFrame([(1, 1, 10.0, 1), (1, 2, 5.0, 2)], "query_id int, doc_id int, score double, rank int")
    vec = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.1, 2)], "query_id int, doc_id int, score double, rank int")
    out = [(r.doc_id, r.score) for r in K.hybrid_search(bm, vec, k=3).orderBy("rank").collect()]
    assert out == [(1, 0.5), (2, 0.5), (3, 0.0)]
    rrf = [r.doc_id for r in K.hybrid_search(bm, vec, method="rrf", k=3).orderBy("rank").collect()]
    assert rrf[0] == 2


def test_ordered_position_matches_row_number(spark):
    import datetime as dt
    from pyspark.sql import Window
    from codeloom.operators import ordered as OR
    t0 = dt.datetime(2020, 1, 1)
    rows = [("hot", f"h{i:04d}", t0 + dt.timedelta(days=i % 400, minutes=i)) for i in range(900)]
    rows += [("cold", f"c{i}", t0 + dt.timedelta(days=3 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "repo string, hash string, ts timestamp")
    order = [F.col("ts").desc(), F.col("hash").desc()]
    got = OR.ordered_position(df, ["repo"], order, OR.month_bucket(F.col("ts")), descending=True)
    ref = df.withColumn("seq", F.row_number().over(Window.partitionBy("repo").orderBy(*order)) - 1)
    assert {tuple(r) for r in got.select("repo", "hash", "seq").collect()} == \
        {tuple(r) for r in ref.select("repo", "hash", "seq").collect()}
    prev = OR.previous_value(df, ["repo"], [F.col("ts"), F.col("hash")], OR.month_bucket(F.col("ts")), "hash")
    ref2 = df.withColumn("prev_hash", F.lag("hash").over(Window.partitionBy("repo").orderBy("ts", "hash")))
    assert {tuple(r) for r in prev.select("repo", "hash", "prev_hash").collect()} == \
        {tuple(r) for r in ref2.select("repo", "hash", "prev_hash").collect()}


def test_short_references_resolve(spark):
    commits = spark.createDataFrame([("abcdef0123", 1), ("abcxyz".replace("x", "1").replace("y", "2").replace("z", "3"), 0)], "hash string, seq long")
    refs = spark.createDataFrame([(1, "abcde"), (2, "abc"), (3, "abcdef0"), (4, "ffff"), (5, "zz")], "ref_id long, ref string")
    out = {r.ref_id: (r["hash"], r.match_count) for r in J.resolve_hashes(refs, commits).collect()}
    every = {r.ref_id: r.match_count for r in J.resolve_hashes(refs, commits, min_len=1).collect()}
    assert every[2] == 2
    assert out == {1: ("abcdef0123", 1), 2: ("abc123", 2), 3: ("abcdef0123", 1), 4: (None, 0), 5: (None, 0)}


def test_from_imports_and_relative_imports(spark):
    files = spark.createDataFrame([("r", p) for p in ("pkg/__init__.py", "pkg/a.py", "pkg/b.py", "pkg/sub/c.py", "top.py")],
                                  "repository_id string, path string")
    imports = [("pkg/a.py", None, "pkg.b.name", "pkg/b.py"), ("pkg/a.py", ".", "b", "pkg/b.py"), ("pkg/sub/c.py", "..", "a.x", "pkg/a.py"),
               ("pkg/a.py", None, "os.path", None), ("top.py", None, "pkg.b", "pkg/b.py"), ("top.py", ".", "pkg.a", "pkg/a.py"),
               ("top.py", None, "pkg", "pkg/__init__.py")]
    symbols = spark.createDataFrame([("r", p, "import", d, n) for p, d, n, _ in imports],
                                    "repository_id string, path string, kind string, parent string, name string")
    got = {(r.path, r.module): r.target_path for r in J.import_edges(symbols, files).collect()}
    assert got == {(p, n): t for p, _, n, t in imports}


def test_code_paths_are_files_of_their_own_repository(spark):
    from codeloom.operators import text_tables as TT
    asked = spark.createDataFrame([(1, "r", "```python:src/a.py\nx\n```"), (2, "s", "```python:src/a.py\nx\n```")],
                                  "query_id long, repository_id string, content string")
    files = spark.createDataFrame([("r", "src/a.py")], "repository_id string, path string")
    every = TT.extract_code_paths(asked, "content", ["query_id", "repository_id"])
    kept = TT.extract_code_paths(asked, "content", ["query_id", "repository_id"], files)
    assert [r.query_id for r in every.where("path = 'src/a.py'").orderBy("query_id").collect()] == [1, 2]
    assert [(r.query_id, r.path) for r in kept.collect()] == [(1, "src/a.py")]
    assert TT.extract_code_paths(asked, "content", ["query_id"], files).count() == 2
