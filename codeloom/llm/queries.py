"""Registered queries of the pipeline operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import suffix_dedup as S
    r = S.remove_repeats(table(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                    F.sha2("kept", 256).alias("kept_sha256"))


@register("op2_simhash_golay")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import simhash as S
    near = S.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(F.col("id").alias("doc_id"), S.hex64(F.col("fp")).alias("fingerprint"),
                       F.col("component").alias("component_id"), "n_links")


@register("op3_voronoi_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import topk as T
    return T.top_k(table(spark, sf_dir, "embeddings"))


def _remainder(mod: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op4_harmonic_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import packing as P
    return P.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


_EXTRA_TURNS = "VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"


@register("op5_prefix_targets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import chat as C
    more = spark.sql(f"SELECT * FROM {_EXTRA_TURNS} AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return C.digest(C.examples(turns))


@register("op6_weak_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import toxicity as X
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = X.fit(docs, table(spark, sf_dir, "labels").where(_remainder(4) != 2))
    out = docs.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
                      X.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= X.THRESHOLD).cast("int"))


@register("op7_closed_syncmers")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import syncmers as S
    r = S.edit_fingerprints(table(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@register("op8_line_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import line_dedup as L
    return L.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op9_quality_crf")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import quality as Q
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = Q.fit(docs, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    out = docs.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"),
                      Q.score(F.col("text"), field).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= Q.THRESHOLD).cast("int"))


@register("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import pieces as P
    r = P.encode_table(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return r.select(F.col("id").alias("doc_id"), "n_ids", F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "parity")


@register("op11_infill")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import infill as I
    r = I.infill(table(spark, sf_dir, "documents"))
    back = I.restored(F.col("output"), F.col("form"))
    return r.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                    F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                    F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


# base32 of a digest of 40 hex digits: five digits are four characters
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)"
    for k in range(8) for s in (15, 10, 5, 0))


@register("op12_warc", f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS first_id FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import warc as W
    r = W.round_trip(table(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op13_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same QUALIFY n <= 5),
r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import hardneg as H
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return H.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))
