"""Weak supervision: mining, scanner, label model and held-out accuracy."""

import numpy as np
from codeloom.llm import toxicity as X
from codeloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_scanner_counts_words_and_stems():
    s = X.Scanner(["bad", "bad*", "badl*", "é"])
    assert s.count("Bad bads badly xbad bad! é éa") == {0: 2, 1: 2, 2: 1, 3: 1}
    assert X.Scanner([]).count("anything") == {}


def test_mining_finds_planted_terms_only():
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ran", "tol", "mek", "sib", "dup")]
    texts, y = [], []
    for i in range(600):
        t = list(rng.choice(words, 40))
        y.append(int(i % 4 == 0))
        if y[-1]:
            t[3] = "vexor"
            t[9] = "lumok" + rng.choice(["a", "e", "is", "ot"])
        texts.append(" ".join(t))
    terms = X.mine(texts, np.array(y))
    assert "vexor" in terms and "lumok*" in terms
    assert all(t.startswith(("vex", "lum")) for t in terms)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    v = np.zeros((4000, 6), int)
    for j, acc in enumerate((0.9, 0.8, 0.7, 0.7, 0.7)):
        v[:, j] = np.where(rng.random(4000) < acc, y, ~y) + 1
    v[:, 4] = v[:, 3]                                    # a copy must not count twice
    v[:, 5] = np.where(rng.random(4000) < 0.95, y, ~y) + 1
    p, acc, corr = X.label_model(v)
    assert ((p > 0.5) == y).mean() > 0.95 and corr[3, 4] > 0.9 and abs(corr[0, 1]) < 0.2
    assert abs(acc[0, 1, 2] - 0.9) < 0.06 and abs(acc[2, 0, 1] - 0.7) < 0.06


def test_held_out_accuracy(spark):
    r = QUERIES["op6_weak_toxicity"](spark, SF)
    assert r.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = r.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    hit = [x.predicted for x in rows if x.toxic]
    miss = [x.predicted for x in rows if not x.toxic]
    assert np.mean(hit) > 0.9 and np.mean(miss) < 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("idiot " if i % 2 else "fine ") * 5 + f"w{i}") for i in range(100)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None), (1, 1)], "doc_id long, toxic int")
    m = X.fit(docs, lab)
    odd = spark.createDataFrame([(None, "idiot idiot idiot"), (1, None), (2, ""), (3, "x " * 300000)], "doc_id long, text string")
    s = [r.s for r in odd.withColumn("score", F.lit(1)).select(X.score(F.col("text"), m).alias("s")).collect()]
    assert s[0] > 0.5 and max(s[1:]) < 0.3
    assert X.fit(docs.limit(0), lab).constant == 0.0 and X.fit(docs, lab.where("toxic = 1")).constant == 1.0
