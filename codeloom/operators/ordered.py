"""Order-dependent values without one task per key (history position ``seq``, previous row).

``Window.partitionBy(key)`` sends every row of a key to one task; with few keys
(repositories) or one hot key that caps parallelism.  Here each key is split
into ordered buckets by a *monotone* coarsening of the order column (for
commit history: the month of the timestamp):

1. a row's position inside its (key, bucket) comes from a window partitioned
   by (key, bucket), so a hot key is spread over its buckets;
2. rows per (key, bucket) are counted (one small row per bucket) and
   prefix-summed over the buckets of the key;
3. position = rows in earlier buckets + position inside the bucket.

Everything is deterministic (no sampling, no partition ids), so the two
branches that read the input agree even when a task is retried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_position(df: DataFrame, key: list[str], order: list[Column], bucket: Column,
                     descending: bool = False, name: str = "seq") -> DataFrame:
    """0-based position of each row within its key in ``order`` (like ``row_number() - 1``).

    ``bucket`` must be monotone in ``order``: non-decreasing when the order is
    ascending (``descending=False``), non-increasing otherwise.
    """
    b = df.withColumn("_b", bucket)
    local = b.withColumn("_local", F.row_number().over(Window.partitionBy(*key, "_b").orderBy(*order)) - 1)
    counts = b.groupBy(*key, "_b").agg(F.count("*").alias("_n"))
    bo = F.col("_b").desc() if descending else F.col("_b").asc()
    w = Window.partitionBy(*key).orderBy(bo).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(*key, "_b", "_before")
    out = local.join(offs, [*key, "_b"])
    return out.withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_b", "_local", "_before")


def previous_value(df: DataFrame, key: list[str], order: list[Column], bucket: Column, col: str,
                   name: str | None = None, descending: bool = False) -> DataFrame:
    """Value of ``col`` on the previous row of the same key in ``order`` (like ``lag``); null for the first.

    Positions come from :func:`ordered_position`; the previous row is then an
    equi join on (key, position), whose keys are unique, so no key is hot.
    """
    name = name or f"prev_{col}"
    pos = ordered_position(df, key, order, bucket, descending, "_pos")
    prev = pos.select(*key, (F.col("_pos") + 1).alias("_pos"), F.col(col).alias(name))
    return pos.join(prev, [*key, "_pos"], "left").drop("_pos")


def month_bucket(ts: Column) -> Column:
    """Monotone coarsening of a timestamp used to split a key's history ('yyyy-MM' sorts in time order;
    no session time zone is involved for wall-clock timestamps)."""
    return F.date_format(ts, "yyyy-MM")
