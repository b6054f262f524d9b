"""Exact top-k search by inner product as a Voronoi join.

Vectors are grouped by their nearest pivot.  A cell's summary (count, radius) bounds every inner product
between a query cell and a data cell::

    |q . x - p . c| <= |p| r + s |c| + s r      (pivots p, c; radii s of the queries, r of the data)

The lower bounds of the cells, best first until they hold k vectors, give a threshold that each query's k-th
score reaches; cells whose upper bound is below it cannot hold a result and get none of the cell's queries.
The other cells are visited: queries are sent to the cell's chunks of at most ``CHUNK`` vectors, each chunk
returns its best k per query, and a ranking over those is the answer.  A vector in a third of all rows makes
a large cell, that is, many chunks.  The driver sees pivots and summaries, at most ``MAX_PIVOTS`` rows for
each vector length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import stored

MAX_PIVOTS = 512
CHUNK = 4096
BLOCK = 8192          # queries solved at once against a chunk


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as longs, null for vectors that take no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(wide, lambda x: F.floor(x * scale)))


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), dim)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where that is exact, else in integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2 ** 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: score descending, id ascending."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _visits(pivots: dict[int, np.ndarray], cells: list, k: int) -> list[tuple[int, int]]:
    """(query cell, data cell) pairs that may hold a result."""
    out = []
    for dim in sorted({c["dim"] for c in cells}):
        own = [c for c in cells if c["dim"] == dim]
        n = np.array([c["n"] for c in own], float)
        if dim not in pivots:                       # a length that no pivot has: nothing is known of the cell
            out += [(a["cell"], b["cell"]) for a in own if a["queries"] for b in own]
            continue
        p = pivots[dim][[c["cell"] & 0xFFFF for c in own]]
        r, norm = np.array([c["radius"] for c in own]), np.linalg.norm(p, axis=1)
        for i, c in enumerate(own):
            if not c["queries"]:
                continue
            s = c["query_radius"]
            mid, slack = p @ p[i], norm[i] * r + s * norm + s * r
            slack = slack * (1 + 1e-9) + 1e-6 * (1 + np.abs(mid))      # rounding of the bounds themselves
            low, high = mid - slack, mid + slack
            order = np.argsort(-low)
            have = np.cumsum(n[order] - (order == i))                  # a query is no candidate of its own
            enough = np.searchsorted(have, k)
            least = low[order[enough]] if enough < len(order) else -np.inf
            out += [(c["cell"], own[j]["cell"]) for j in np.flatnonzero(high >= least)]
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows by integer inner product for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id and the
    same number of components.  Ties go to the smaller id.  Vectors that are null or hold a null or non-finite
    component, and rows without an id, take no part.  Rows that repeat an id are candidates each; as queries
    they count once.  Scores must fit in a long.  Fewer than k candidates give fewer rows.
    """
    spark = vectors.sparkSession
    base = (vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v"))
            .where("id is not null and v is not null"))
    n = base.count()
    n_pivots = int(max(1, min(MAX_PIVOTS, -(-n // CHUNK))))
    pivots: dict[int, list] = {}
    for row in base.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect():      # MAX_PIVOTS rows at most
        pivots.setdefault(len(row.v), []).append(row.v)
    pivots = {d: np.unique(np.array(p, np.float64).reshape(len(p), d), axis=0) for d, p in pivots.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dim = b["v"].map(len).to_numpy()
            cell, dist = dim.astype(np.int64) << 16, np.zeros(len(b))
            blobs = [np.asarray(v, "<i8").tobytes() for v in b["v"]]
            for d in np.unique(dim):
                if d in pivots:
                    at = np.flatnonzero(dim == d)
                    x = _matrix([blobs[i] for i in at], d).astype(np.float64)
                    far = (x ** 2).sum(1)[:, None] - 2 * x @ pivots[d].T + (pivots[d] ** 2).sum(1)[None, :]
                    near = far.argmin(1)
                    cell[at] |= near
                    dist[at] = np.linalg.norm(x - pivots[d][near], axis=1)
            yield pd.DataFrame({"id": b["id"], "v": blobs, "dim": dim, "cell": cell, "dist": dist})
    placed = stored(base.mapInPandas(place, "id long, v binary, dim int, cell long, dist double"))
    query = F.col("id") % every == 0
    cells = placed.groupBy("cell", "dim").agg(
        F.count("*").alias("n"), F.max("dist").alias("radius"), F.count_if(query).alias("queries"),
        F.max(F.when(query, F.col("dist"))).alias("query_radius")).collect()        # a row a cell
    pairs = _visits(pivots, cells, k)
    chunks = {c["cell"]: max(1, -(-c["n"] // CHUNK)) for c in cells}
    blocks = max(1, -(-sum(c["queries"] for c in cells) // BLOCK))
    visits = spark.createDataFrame([(a, b, chunks[b]) for a, b in pairs], "qcell long, cell long, chunks int")
    sizes = spark.createDataFrame(list(chunks.items()), "cell long, chunks int")

    def piece(col: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(col), n).cast("int")
    q = (placed.where(query).groupBy("id").agg(F.min(F.struct("v", "dim", "cell")).alias("r"))
         .select("id", "r.v", "r.dim", F.col("r.cell").alias("qcell"), piece("id", F.lit(blocks)).alias("block"))
         .join(F.broadcast(visits), "qcell")                                       # MAX_PIVOTS ** 2 pairs at most
         .select("id", "v", "dim", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
    data = (placed.join(F.broadcast(sizes), "cell")                                # MAX_PIVOTS rows at most
            .select("id", "v", "dim", "cell", piece("id", F.col("chunks")).alias("chunk"),
                    F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))
    data = data.select(*[F.col(c).alias(c) for c in data.columns])                 # columns of its own beside q's

    def solve(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(qs) and len(xs):
            dim = int(qs["dim"].iloc[0])
            x, ids, qids = _matrix(xs["v"], dim), xs["id"].to_numpy(np.int64), qs["id"].to_numpy(np.int64)
            for at in range(0, len(qs), 512):
                s = _scores(_matrix(qs["v"].iloc[at:at + 512], dim), x)
                for row, qid in zip(s, qids[at:at + 512]):
                    other = ids != qid
                    best = _best(ids[other], row[other], k)
                    rows += [(qid, i, v) for i, v in zip(ids[other][best], row[other][best])]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")
    keys = ["cell", "chunk", "block"]
    found = q.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
