"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``, and filters of a fixed size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends here, and readers can pick columns."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FILTER_BITS = 1 << 25      # fixed, so a filter has at most FILTER_BITS / 64 rows whatever it was built from


def bit_filter(hashes: DataFrame, h: str) -> DataFrame:
    """One-hash Bloom filter of the longs in column ``h``: rows (__word, __bits), at most ``FILTER_BITS / 64``."""
    word = F.shiftright(F.col(h).bitwiseAND(F.lit(FILTER_BITS - 1)), 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast({h} & 63 as int))")
    return hashes.select(word.alias("__word"), bit.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))


def with_hit(df: DataFrame, h: Column, words: DataFrame) -> DataFrame:
    """``df`` with __hit: false where ``h`` is certainly not in the filter.  Rows stay where they are."""
    df = df.withColumn("__h", h).withColumn("__word", F.shiftright(F.col("__h").bitwiseAND(F.lit(FILTER_BITS - 1)), 6).cast("int"))
    hit = F.coalesce(F.expr("(shiftrightunsigned(__bits, cast(__h & 63 as int)) & 1L) = 1L"), F.lit(False))
    return df.join(F.broadcast(words), "__word", "left").withColumn("__hit", hit).drop("__h", "__word", "__bits")
