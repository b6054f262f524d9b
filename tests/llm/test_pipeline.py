"""The corpus pipeline, stage by stage against brute force on a small table, and as a whole."""

import corpus_pipeline as C
import public_tokenizers
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_simhash import brute_components
from test_suffix_dedup import brute as brute_repeats
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.dtypes
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    def step(df, k):
        f = C.STAGES[k][1]
        f(spark, df, SF).write.parquet(f"{scratch}/{k}")
        out = spark.read.parquet(f"{scratch}/{k}")
        if k < 4:
            assert out.dtypes == cols and out.where("n_chars != length(text)").count() == 0
        return out
    good = step(docs, 0)
    lab = good.join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in lab}
    assert kept.get(0, 0) <= 1 and kept[1] >= labels.where("quality = 1").count() - 1
    lines = step(good, 1)
    want, got = {k: t for k, t, _, _ in brute_lines(pairs(good))}, dict(pairs(lines))
    # banding may miss a link at the threshold, it never adds one
    assert want.keys() == got.keys() and all(set(want[k].split("\n")) - {""} <= set(got[k].split("\n")) for k in want)
    assert sum(want[k] != got[k] for k in want) <= 0.01 * len(want)
    near = step(lines, 2)
    rows = pairs(lines)
    comp, _ = brute_components(rows)
    assert sorted(pairs(near)) == sorted(r for r, c in zip(rows, comp) if r[0] == c)
    subs = step(near, 3)
    assert sorted(pairs(subs)) == sorted((i, k.decode("utf-8", "ignore")) for i, _, _, _, k in brute_repeats(pairs(near)))
    packed = step(subs, 4)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in pairs(subs)}
    got = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want


def test_run_and_odd_rows(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, None, "en", None, None), (901, "", None, "s", 0),
                                 (902, "x", "en", "s", 1), (902, "x", "en", "s", 1)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{scratch}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{scratch}/labels.parquet")
    out = C.run(spark, scratch)
    assert out.count() > 0 and out.where("length <= 0 or offset + length > 4096").count() == 0
    empty = f"{scratch}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert C.run(spark, empty).count() == 0
