"""As-of lookup against a walk over sorted versions, with paths that cross the borders of ranges."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import asof as A

COLS = "repository_id string, path string, ordinal long, deleted boolean, content string"


def brute(requests, versions):
    out = []
    for i, repo, path, o in requests:
        past = [(v, not d, c or "") for r, p, v, d, c in versions
                if None not in (r, p, v, repo, path, o) and (r, p) == (repo, path) and v <= o]
        best = max(past, default=None)
        out.append((i, best[0], best[2], "ok") if best and best[1] else (i, None, None, "not found in commit"))
    return sorted(out)


def got(spark, requests, versions, ranges):
    req = spark.createDataFrame(requests, "request_id long, repository_id string, path string, ordinal long").repartition(3)
    ver = spark.createDataFrame(versions, COLS).repartition(2)
    out = A.content_at(req, ver, ranges)
    assert out.columns == ["request_id", "repository_id", "path", "ordinal", "version_ordinal", "content", "status"]
    return sorted((r.request_id, r.version_ordinal, r.content, r.status) for r in out.collect())


@pytest.mark.parametrize("ranges", [1, 3, 17, None])
def test_against_brute_force(spark, ranges):
    rnd = random.Random(ranges)
    paths = ["hot"] * 12 + ["a", "b", "c/d", "z"]
    versions = [(rnd.choice("rs"), rnd.choice(paths), rnd.randint(-50, 500), rnd.random() < 0.3, f"v{i}") for i in range(60)]
    versions += [("r", "hot", 7, False, "x"), ("r", "hot", 7, False, "y"), ("r", "hot", 7, True, "z"), (None, "a", 1, False, "n"), ("r", None, 1, False, "n"),
                 ("r", "a", None, False, "n"), ("s", "big", -(1 << 63), False, "least"), ("s", "big", (1 << 63) - 1, False, "most")]
    requests = [(i, rnd.choice("rs"), rnd.choice(paths), rnd.randint(-100, 600)) for i in range(800)]
    requests += [(9000, None, "a", 5), (9001, "r", None, 5), (9002, "s", "big", None), (9003, "s", "big", -(1 << 63)), (9004, "s", "big", (1 << 63) - 1),
                 (9005, "q", "none", 1), (9006, "r", "hot", 7)]
    assert got(spark, requests, versions, ranges) == brute(requests, versions)


def test_one_early_version_reaches_every_range(spark):
    versions = [("r", "p", 0, False, "first"), ("r", "q", 0, True, "gone"), ("r", "q", 500, False, "back")]
    requests = [(i, "r", "p" if i % 2 else "q", i) for i in range(1000)]
    assert got(spark, requests, versions, 20) == brute(requests, versions)


def test_empty(spark):
    one = [(1, "r", "p", 3)]
    assert got(spark, one, [], 4) == [(1, None, None, "not found in commit")]
    assert got(spark, [], [("r", "p", 1, False, "x")], 4) == []


def test_a_hot_path_is_many_tasks(spark, monkeypatch):
    seen = {}
    keep = A.stored
    monkeypatch.setattr(A, "stored", lambda df: seen.setdefault("merged", keep(df)))
    req = spark.range(1_000_000).select(F.col("id").alias("request_id"), F.lit("r").alias("repository_id"), F.lit("p").alias("path"), F.col("id").alias("ordinal"))
    ver = spark.createDataFrame([("r", "p", 10, False, "x")], COLS)
    out = A.content_at(req, ver, 16)
    assert out.where("status = 'ok' and content = 'x' and version_ordinal = 10").count() == 999_990
    sizes = [r["count"] for r in seen["merged"].groupBy("place").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 200_000
