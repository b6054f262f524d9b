"""The line field: marginals against enumeration, held-out accuracy, odd inputs."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import quality as Q
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for m in (1, 2, 5):
        s, pair = rng.normal(size=m) * 2, rng.normal(size=(2, 2)) * 2
        total, good = 0.0, np.zeros(m)
        for ys in itertools.product((0, 1), repeat=m):
            e = math.exp(sum(s[i] * y for i, y in enumerate(ys)) + sum(pair[a, b] for a, b in zip(ys, ys[1:])))
            total += e
            good += e * np.array(ys)
        assert np.allclose(Q.marginals(s.tolist(), pair), good / total)


def test_features_count_whole_lines():
    x, w = Q.line_features("ab CD\n\n%% | !!\nab CD")
    assert len(x) == 4 and w.tolist() == [6, 1, 8, 6]
    assert x[0, 8] == 0.5 and x[0, 13] == math.log(2) and x[1].sum() == 0 and x[2, 5] == 1 / 7


def test_fit_learns_neighbours_and_constants():
    rng = np.random.default_rng(1)
    chains = [Q._with_neighbours(rng.normal(size=(rng.integers(1, 9), Q.N_OWN)) + (2 if i % 2 else 0)) for i in range(60)]
    y = np.arange(60) % 2
    f = Q.fit_field(chains, y)
    p = [Q.marginals((((c - f.mean) / f.scale) @ f.node).tolist(), f.pair).mean() > 0.5 for c in chains]
    assert (np.array(p) == (y == 1)).mean() > 0.95
    assert Q.fit_field([], np.array([])).score("x") == 1.0 and Q.fit_field(chains[:1], np.array([0])).score("x") == 0.0


def test_held_out_accuracy(spark):
    r = QUERIES["op9_quality_crf"](spark, SF)
    assert r.columns == ["doc_id", "held_out", "score", "predicted"]
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    rows = r.where("held_out").join(lab, "doc_id").select("quality", "predicted", "score").collect()
    assert len(rows) > 40 and np.mean([x.quality == x.predicted for x in rows]) > 0.95
    assert all(0 <= x.score <= 1 for x in rows)


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(None, "a b c."), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "x. " * 200000), (0, "%%% " * 50)],
                                "doc_id long, text string")
    field = Q.fit(docs.unionByName(odd), lab.unionByName(lab.limit(5)).unionByName(lab.limit(1).withColumn("doc_id", F.lit(None))))
    out = odd.withColumn("score", F.lit("clash")).withColumn("s", Q.score(F.col("text"), field)).collect()
    assert len(out) == 5 and all(0 <= r.s <= 1 for r in out) and out[4].s < 0.3
    assert Q.keep_good(docs.limit(0), lab).count() == 0
    assert Q.fit(docs.limit(0), lab).constant == 1.0


def test_scores_of_a_batch_of_more_rows_than_are_read_at_once(spark):
    rng = np.random.default_rng(1)
    width = 3 * Q.N_OWN + 3
    field = Q.Field(np.zeros(width), np.ones(width), rng.normal(size=width) / 20, rng.normal(size=(2, 2)))
    texts = [None if i % 90 == 0 else "" if i % 91 == 0 else f"Line {i}\nand more | text {i * i}" for i in range(2 * Q.SLICE + 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    out = df.select("i", Q.score(F.col("text"), field).alias("s"))
    assert [r.s for r in out.orderBy("i").collect()] == [field.score(t) for t in texts]
