"""Hard-negative mining over a multiway hyperplane tree with distance ranges (GNAT).

Each inner node of the tree has up to ``ARITY`` split points; a vector belongs to the child of the nearest one.
For every split point i and sibling j the node keeps the least and greatest distance from i to any vector below
j, and the range of squared norms below j.  Since ``2 q.x = |q|^2 + |x|^2 - d(q, x)^2``, a window of inner
products is, for vectors of those norms, an annulus of distances around the query; what the triangle inequality
says about d(q, x) through each split point is intersected with the annuli, and a sibling that none meets is
eliminated with everything below it.

The split points are chosen on a bounded sample (``FIT_ROWS``), the ranges are taken over all rows, and every
row lies in one leaf.  A leaf is stored as chunks of at most ``CHUNK`` rows, so a vector that a third of all
rows share is many chunks.  Queries search in blocks: first their own leaf, whose k-th score narrows the windows,
then the leaves the tree leaves over; inside a leaf every row is scored exactly.  Positives are such a search
among rows of the same label, negatives one among the others within the windows that the positives' scores give.
The driver sees the sample, the ranges and one row a leaf, none of which grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import stored
from codeloom.llm.topk import _scores, quantised

ARITY = 8
FIT_ROWS = 4096            # vectors the split points are chosen from
LEAF_ROWS = 2048           # rows of a leaf that is not split again, as far as the sample tells
CHUNK = 4096               # rows of a leaf scored at once
BLOCK = 2048               # queries of neighbouring leaves that travel together
PIECE = 64                 # chunks of a leaf under one join key
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
_NOTHING = LOWEST


# --- the tree -----------------------------------------------------------------------------

class Tree:
    """Split points, ranges and leaves for vectors of one length."""

    def __init__(self, sample: np.ndarray, leaf_sample: float, arity: int = ARITY):
        self.points: list[np.ndarray] = []           # of each inner node, one row a child
        self.child: list[list[int]] = []             # inner node, or ~leaf
        self.leaves, self.ranges = 0, None
        self.root = self._split(sample.astype(np.float64), leaf_sample, arity)

    def _split(self, x: np.ndarray, leaf_sample: float, arity: int) -> int:
        at = [0]
        if len(x) > leaf_sample:                     # farthest first, from the sample's first vector
            far = _squares(x, x[:1])[:, 0]
            while len(at) < arity and far.max() > 0:
                at.append(int(far.argmax()))
                far = np.minimum(far, _squares(x, x[at[-1:]])[:, 0])
        if len(at) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        me, points = len(self.points), x[at]
        self.points.append(points)
        self.child.append([])
        near = _squares(x, points).argmin(1)
        self.child[me] = [self._split(x[near == j], leaf_sample, arity) for j in range(len(at))]
        return me

    def walk(self, x: np.ndarray, see=None) -> np.ndarray:
        """Leaf of each row; ``see(node, rows, distances, child)`` is called at each inner node on the way."""
        leaf, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = ~node
                continue
            d = _squares(x[rows], self.points[node])
            near = d.argmin(1)
            if see is not None:
                see(node, rows, np.sqrt(d), near)
            todo += [(c, rows[near == j]) for j, c in enumerate(self.child[node]) if (near == j).any()]
        return leaf

    def measure(self, x: np.ndarray, into: dict) -> None:
        """Widen ``into[(node, split point, child)]`` by the distances of rows; split point -1 stands for squared norms."""
        norm = (x ** 2).sum(1)

        def see(node, rows, d, near):
            for j in np.unique(near):
                own = near == j
                for i, v in [(-1, norm[rows[own]]), *enumerate(d[own].T)]:
                    a, b = into.get((node, i, int(j)), (np.inf, -np.inf))
                    into[(node, i, int(j))] = (min(a, v.min()), max(b, v.max()))
        self.walk(x, see)

    def reach(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of ``q`` with a window that some vector of the leaf may meet); windows are columns of low, high."""
        q2, out, todo = (q ** 2).sum(1), [], [(self.root, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out.append((~node, rows))
                continue
            d = np.sqrt(_squares(q[rows], self.points[node]))
            own = (self.points[node] ** 2).sum(1).max()
            for j, c in enumerate(self.child[node]):
                if (node, -1, j) not in self.ranges:                             # no row below
                    continue
                n_low, n_high = self.ranges[(node, -1, j)]
                r = np.array([self.ranges[(node, i, j)] for i in range(d.shape[1])])
                near = np.maximum(np.maximum(r[:, 0] - d, d - r[:, 1]).max(1), 0)
                far = (d + r[:, 1]).min(1)
                slack = 1e-6 * (1 + np.sqrt(np.maximum(q2[rows], max(own, n_high))))       # rounding of the bounds
                outer = (q2[rows] + n_high)[:, None] - 2 * low[rows]
                inner = (q2[rows] + n_low)[:, None] - 2 * high[rows]
                meets = ((low[rows] <= high[rows]) & (outer >= -slack[:, None] ** 2)
                         & ((near - slack)[:, None] <= np.sqrt(np.maximum(outer, 0)))
                         & ((far + slack)[:, None] >= np.sqrt(np.maximum(inner, 0)))).any(1)
                if meets.any():
                    todo.append((c, rows[meets]))
        return out


def _squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of rows to points."""
    return np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ p.T + (p ** 2).sum(1)[None, :], 0)


def fit(base: DataFrame, rows: int) -> dict[int, Tree]:
    """A tree for each vector length in a sample of ``FIT_ROWS`` rows, taken by a hash of the id."""
    sample: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect():
        sample.setdefault(len(r.v), []).append(r.v)
    share = min(1.0, FIT_ROWS / max(1, rows))
    return {d: Tree(np.unique(np.array(v, np.int64).reshape(len(v), d), axis=0), max(1, LEAF_ROWS * share)) for d, v in sample.items()}


# --- blobs --------------------------------------------------------------------------------

def pack(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them, with the width in front."""
    low, high = int(a.min(initial=0)), int(a.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + a.astype(f"<i{width}").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64)


def _matrix(vectors) -> np.ndarray:
    """One row a vector; unpacked blobs of equal width and length."""
    return np.array([unpack(v) for v in vectors], np.int64).reshape(len(vectors), -1)


# --- the search ---------------------------------------------------------------------------

def _place(base: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(id, label, v, dim, leaf): every row in its leaf, as a stored table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dim, blobs = b["v"].map(len).to_numpy(np.int64), [pack(np.asarray(v, np.int64)) for v in b["v"]]
            leaf = dim << 16
            for d in np.unique(dim):
                if d in trees:
                    at = np.flatnonzero(dim == d)
                    leaf[at] |= trees[d].walk(np.array([b["v"].iloc[i] for i in at], np.float64).reshape(len(at), d))
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "v": blobs, "dim": dim, "leaf": leaf})
    return stored(base.mapInPandas(run, "id long, label long, v binary, dim int, leaf long"))


def _ranges(placed: DataFrame, trees: dict[int, Tree]) -> None:
    """Give the trees their ranges over all rows: at most ARITY * (ARITY + 1) numbers an inner node reach the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, dict] = {d: {} for d in trees}
        for b in batches:
            for d, part in b.groupby("dim"):
                if d in trees:
                    trees[d].measure(_matrix(part["v"].tolist()).astype(np.float64), found[d])
        rows = [(d, *k, *v) for d in found for k, v in found[d].items()]
        yield pd.DataFrame(rows, columns=["dim", "node", "i", "j", "low", "high"])
    got = placed.select("dim", "v").mapInPandas(run, "dim int, node int, i int, j int, low double, high double")
    for t in trees.values():
        t.ranges = {}
    for r in got.groupBy("dim", "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        trees[r.dim].ranges[(r.node, r.i, r.j)] = (r.low, r.high)


def _chunks(placed: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(leaf, chunk, piece, n, ids, labels, vectors): leaves as rows of at most about ``CHUNK`` vectors."""
    spark = placed.sparkSession
    n = spark.createDataFrame([(k, -(-v // CHUNK)) for k, v in sizes.items()], "leaf long, chunks int")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(g["leaf"].iloc[0], g["chunk"].iloc[0], len(g), pack(g["id"].to_numpy()), pack(g["label"].to_numpy()),
                              pack(_matrix(g["v"].tolist())))], columns=["leaf", "chunk", "n", "ids", "labels", "vectors"])
    parts = (placed.join(F.broadcast(n), "leaf")                                 # a row a leaf
             .withColumn("chunk", F.pmod(F.xxhash64("id", "label", "v"), F.col("chunks")).cast("int"))
             # repeated rows have equal hashes: they are dealt on by their number in the partition
             .withColumn("chunk", F.pmod(F.col("chunk") + F.pmod(F.monotonically_increasing_id(), F.col("chunks")), F.col("chunks")).cast("int")))
    done = parts.groupBy("leaf", "chunk").applyInPandas(run, "leaf long, chunk int, n int, ids binary, labels binary, vectors binary")
    return stored(done.withColumn("piece", F.floor(F.col("chunk") / PIECE).cast("int")))


def _deal(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(leaf, block, pieces): neighbouring leaves of one length share a block of about ``BLOCK`` queries, a larger leaf has several."""
    out, block, held, last = [], 0, 0, None
    for leaf in sorted(counts):
        if held and (held + counts[leaf] > BLOCK or leaf >> 16 != last):
            block, held = block + 1, 0
        pieces = -(-counts[leaf] // BLOCK)
        out.append((leaf, block, pieces))
        block, held, last = (block + pieces, 0, None) if pieces > 1 else (block, held + counts[leaf], leaf >> 16)
    return out


def _blocks(queries: DataFrame, windows: DataFrame, sizes: dict[int, int], trees: dict[int, Tree], home: bool) -> DataFrame:
    """(block, leaf, piece, ...): for each leaf that a block's queries visit, those queries and their windows.

    With ``home`` each query visits its own leaf only, else the others that its windows reach.
    """
    spark = queries.sparkSession
    counts = {r.leaf: r["count"] for r in queries.groupBy("leaf").count().collect()}                                # a row a leaf
    n = spark.createDataFrame(_deal(counts), "leaf long, block long, pieces int")
    w = windows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("w", "low", "high"))).alias("windows"))      # k rows at most
    q = (queries.join(w, "id").join(F.broadcast(n), "leaf")
         .withColumn("block", F.col("block") + F.pmod(F.xxhash64("id"), F.col("pieces"))))
    columns = ["block", "leaf", "n", "qids", "qlabels", "qvectors", "slots", "qlow", "qhigh"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        dim, own = int(g["dim"].iloc[0]), g["leaf"].to_numpy() & 0xFFFF
        x, ids, labels = _matrix(g["v"].tolist()), g["id"].to_numpy(), g["label"].to_numpy()
        width = max(map(len, g["windows"]))
        slot, low, high = (np.full((len(g), width), v, np.int64) for v in (-1, 1, 0))        # 1 > 0: no window
        for i, ws in enumerate(g["windows"]):
            for k, one in enumerate(ws):
                slot[i, k], low[i, k], high[i, k] = one["w"], one["low"], one["high"]
        if home:
            visits = [(leaf, np.flatnonzero(own == leaf)) for leaf in np.unique(own)]
        elif dim in trees:
            reached = trees[dim].reach(x.astype(np.float64), low.astype(np.float64), high.astype(np.float64))
            visits = [(leaf, rows[own[rows] != leaf]) for leaf, rows in reached]
        else:
            visits = []
        out = [(g["block"].iloc[0], dim << 16 | int(leaf), len(r), pack(ids[r]), pack(labels[r]), pack(x[r]), pack(slot[r]), pack(low[r]), pack(high[r]))
               for leaf, r in visits if len(r)]
        return pd.DataFrame(out, columns=columns)
    schema = "block long, leaf long, n int, qids binary, qlabels binary, qvectors binary, slots binary, qlow binary, qhigh binary"
    done = q.groupBy("block").applyInPandas(run, schema)
    pieces = spark.createDataFrame([(k, -(-(-(-v // CHUNK)) // PIECE)) for k, v in sizes.items()], "leaf long, pieces int")
    return (done.join(F.broadcast(pieces), "leaf")                              # a row a leaf
            .select(*columns, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")))


def best_in(q: np.ndarray, qids: np.ndarray, qlabels: np.ndarray, slots: np.ndarray, low: np.ndarray, high: np.ndarray,
            x: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, k: int) -> list[pd.DataFrame]:
    """The k best rows (score descending, id ascending) of each query and window: frames of (id, w, found, score)."""
    out = []
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        s = _scores(q[part], x)
        allowed = (qlabels[part, None] == labels[None, :]) == same
        allowed &= qids[part, None] != ids[None, :]
        for c in range(slots.shape[1]):
            m = np.where(allowed & (s >= low[part, c, None]) & (s <= high[part, c, None]), s, _NOTHING)
            least = np.partition(m, m.shape[1] - k, axis=1)[:, m.shape[1] - k] if m.shape[1] > k else np.full(len(m), _NOTHING)
            i, j = np.nonzero((m >= least[:, None]) & (m > _NOTHING))
            order = np.lexsort((ids[j], -m[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[rank < k], j[rank < k]
            out.append(pd.DataFrame({"id": qids[part][i], "w": slots[part][i, c], "found": ids[j], "score": m[i, j]}))
    return out


def _solve(blocks: DataFrame, chunks: DataFrame, same: bool, k: int) -> DataFrame:
    """(id, w, found, score): the k best of every chunk that a block's queries visit."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]                                                            # one block and one chunk
        qids, ids = unpack(r["qids"]), unpack(r["ids"])
        rows = [unpack(r[c]).reshape(len(qids), -1) for c in ("slots", "qlow", "qhigh")]
        got = best_in(unpack(r["qvectors"]).reshape(len(qids), -1), qids, unpack(r["qlabels"]), *rows,
                      unpack(r["vectors"]).reshape(len(ids), -1), ids, unpack(r["labels"]), same, k)
        return pd.concat(got, ignore_index=True).astype({"id": "int64", "w": "int32", "found": "int64", "score": "int64"})
    met = blocks.drop("n").join(chunks.drop("n"), ["leaf", "piece"])
    return met.groupBy("leaf", "piece", "chunk", "block").applyInPandas(run, "id long, w int, found long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id", "w").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(queries: DataFrame, windows: DataFrame, chunks: DataFrame, sizes: dict[int, int], trees: dict[int, Tree], same: bool, k: int) -> DataFrame:
    """(id, w, rank, found, score): the k best rows of each query and window, by its own leaf and then the tree."""
    first = stored(_best(_solve(_blocks(queries, windows, sizes, trees, True), chunks, same, k), k))
    least = first.where(F.col("rank") == k).select("id", "w", F.col("score").alias("least"))
    narrow = windows.join(least, ["id", "w"], "left").select("id", "w", F.greatest("low", "least").alias("low"), "high")
    rest = _solve(_blocks(queries, narrow, sizes, trees, False), chunks, same, k)
    return stored(_best(first.drop("rank").unionByName(rest), k))


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole numbers s with low * score <= 100 * s <= high * score, as least and greatest."""
    return max(LOWEST, -(-low * score // 100)), min(HIGHEST, high * score // 100)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are the best ``positives`` other
    rows of its label by integer inner product, and for each of them the best ``negatives`` rows of other labels
    with ``low * positive <= 100 * negative <= high * positive`` are returned.  Ties go to the smaller id.

    Rows without an id, a label (a whole number) or a vector, and vectors with a null or non-finite component take
    no part; only vectors of equal length meet.  Rows that repeat an id are candidates each, never for an anchor of
    that id; as an anchor an id counts once, with its smallest label and vector.  Scores must fit in a long.  A
    positive without a negative in its window gives no row, nor does an empty table.  Other columns are ignored.
    """
    base = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                           quantised(F.col(vec_col), scale).alias("v"))
            .where("id is not null and label is not null and v is not null"))
    trees = fit(base, base.count())
    placed = _place(base, trees)
    _ranges(placed, trees)
    sizes = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}          # a row a leaf
    chunks = _chunks(placed, sizes)
    anchors = stored(placed.where(F.col("id") % every == 0).groupBy("id")
                     .agg(F.min(F.struct("label", "v", "dim", "leaf")).alias("r")).select("id", "r.*"))
    whole = anchors.select("id", F.lit(0).alias("w"), F.lit(LOWEST).cast("long").alias("low"), F.lit(HIGHEST).cast("long").alias("high"))
    pos = _search(anchors, whole, chunks, sizes, trees, True, positives)

    def limits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [_window(int(s), low, high) for s in b["score"]]
            yield pd.DataFrame({"id": b["id"], "w": b["rank"], "low": [e[0] for e in ends], "high": [e[1] for e in ends]})
    windows = pos.select("id", "rank", "score").mapInPandas(limits, "id long, w int, low long, high long").where("low <= high")
    neg = _search(anchors, windows, chunks, sizes, trees, False, negatives)
    kept = pos.select("id", F.col("rank").alias("w"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return neg.join(kept, ["id", "w"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"),
                                              "positive_score", F.col("score").alias("negative_score"))
