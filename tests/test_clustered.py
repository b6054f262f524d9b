"""Bucketed tables are read without a shuffle, grow by files, and open again in any session."""

import os
import uuid

import pytest

from codeloom.operators import aggregates as A
from codeloom.operators import joins as J
from codeloom.sources import clustered as CL

COMMITS = "repository_id string, hash string, message string"
CHANGES = "repository_id string, hash string, path string, change_type string, insertions long, deletions long"
FILES = "repository_id string, path string, binary boolean, content string"


def _corpus(spark, repos, n=40):
    commits = [(r, f"{r}{i:04x}", f"m{i}") for r in repos for i in range(n)]
    changes = [(r, f"{r}{i:04x}", f"src/f{(i * 7 + j) % 11}.py", "modified", i, j) for r in repos for i in range(n) for j in range(i % 4)]
    files = [(r, f"src/f{i}.py", False, f"x = {i}") for r in repos for i in range(11)]
    return {"commits": spark.createDataFrame(commits, COMMITS), "changes": spark.createDataFrame(changes, CHANGES),
            "files": spark.createDataFrame(files, FILES)}


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _name():
    return "t" + uuid.uuid4().hex[:12]


def test_stored_tables_are_joined_and_grouped_without_a_shuffle(spark, scratch, no_broadcast):
    plain = _corpus(spark, ["r", "s"])
    t = CL.write_clustered(plain, scratch, _name(), buckets=4)
    j1 = J.commits_with_changes(t["commits"], t["changes"])
    a4 = A.commit_stats(t["commits"], t["changes"])
    a12 = A.file_churn(t["changes_by_path"])
    for df in (j1, a4, a12):
        assert "Exchange" not in _plan(df)
    assert _rows(j1) == _rows(J.commits_with_changes(plain["commits"], plain["changes"]))
    assert _rows(a4) == _rows(A.commit_stats(plain["commits"], plain["changes"]))
    assert _rows(a12) == _rows(A.file_churn(plain["changes"]))


def test_lookups_shuffle_the_requests_only(spark, scratch, no_broadcast):
    plain = _corpus(spark, ["r", "s"])
    t = CL.write_clustered(plain, scratch, _name(), buckets=16)
    asked = spark.createDataFrame([("r", "src/f1.py"), ("s", "nowhere")], "repository_id string, path string")
    found = J.lookup_files(asked, t["files"])
    assert _plan(found).count("Exchange hashpartitioning") == 1
    assert _rows(found) == _rows(J.lookup_files(asked, plain["files"]))
    hashes = spark.createDataFrame([("r", "r0003"), ("r", "r0003"), ("s", "none")], "repository_id string, hash string")
    assert CL.commit_changes_of(t, hashes).count() == 3


def test_append_leaves_stored_files_alone(spark, scratch, no_broadcast):
    CL.write_clustered(_corpus(spark, ["r", "s"]), scratch, _name(), buckets=4)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(scratch) for f in fs if f.endswith(".parquet")}
    before = files()
    CL.write_clustered(_corpus(spark, ["u"]), scratch, _name(), buckets=99, mode="append")
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    t = CL.open_clustered(spark, scratch, _name())
    whole = _corpus(spark, ["r", "s", "u"])
    a4 = A.commit_stats(t["commits"], t["changes"])
    assert "Exchange" not in _plan(a4) and _rows(a4) == _rows(A.commit_stats(whole["commits"], whole["changes"]))
    assert _rows(t["files"]) == _rows(whole["files"])


def test_overwrite_replaces_and_bad_calls_fail(spark, scratch):
    name = _name()
    CL.write_clustered(_corpus(spark, ["r", "s"]), scratch, name, buckets=4)
    t = CL.write_clustered(_corpus(spark, ["u"]), scratch, name, buckets=2)
    assert {r.repository_id for r in t["commits"].select("repository_id").distinct().collect()} == {"u"}
    empty = CL.write_clustered({"commits": spark.createDataFrame([], COMMITS)}, scratch + "/none", _name(), buckets=2)
    assert list(empty) == ["commits"] and empty["commits"].count() == 0
    with pytest.raises(ValueError):
        CL.write_clustered({"commits": t["commits"]}, scratch, name, mode="ignore")
    with pytest.raises(ValueError):
        CL.write_clustered({"other": t["commits"]}, scratch, name)
    with pytest.raises(ValueError):
        CL.write_clustered({"changes": t["changes"]}, scratch + "/none", _name(), mode="append")
