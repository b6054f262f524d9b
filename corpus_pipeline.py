"""Corpus pipeline: quality filter, line de-duplication, near-duplicate removal, substring de-duplication, packing.

``STAGES`` lists the steps in order.  Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` applies them to the table ``documents``, writing what a
stage returns as Parquet into the shared folder of ``spark.checkpoint.dir`` and reading it again, so a lost
executor never repeats an earlier stage.

Defined results for odd rows: a null text counts as empty from the stage that first rewrites it, a document
that loses all its text stays as a row with empty text, rows that share an id are one document from the
near-duplicate stage on, and rows without an id pass every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import line_dedup, packing, quality, simhash, suffix_dedup
from codeloom.llm.queries import vocabulary
from codeloom.session import checkpoint_dir

#: SQL cannot express the field over lines, fuzzy lines and fingerprints; tests hold each stage against brute force.
ORACLE_SQL = None


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return docs.select(*[n if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line field scores at its threshold or more; learned from the rows not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return quality.keep_good(docs, labels.where(learn))


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat, or nearly repeat, an earlier line of the corpus."""
    return _recount(line_dedup.dedup_lines(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that a smaller id has as well."""
    return _recount(suffix_dedup.cleaned(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", substring_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
