"""Distributed union-find over an edge table, by alternating large-star and small-star steps.

Both steps are a partial-aggregated minimum per node joined back to the edges, so a hub that
touches a third of all nodes is one row per task before the shuffle and a skew join (split by
AQE) after it.  Every round ends in a reliable ``checkpoint`` in the folder the cluster names,
so a lost executor costs one round, and nothing but two numbers reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links of sortable ids -> (node, component): the smallest id reachable from each linked node.

    Nodes without a link to another node are not returned; self links and repeated links are harmless,
    links with a null end are ignored.  An empty edge table gives an empty result.
    """
    e = cut_lineage(edges.where("u is not null and v is not null and u != v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        e = cut_lineage(_small_star(_large_star(e)))
        now = _state(e)
        if now == state:
            break
        state = now
    # at the fixed point every node but a component's smallest points straight at the smallest
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
