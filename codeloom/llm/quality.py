"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is a step of the chain and is good or bad.  Node features describe the line
itself and its two neighbours; transition weights tie neighbouring labels.  Forward-backward gives the
marginal probability that each line is good, and the document's score is their mean weighted by line
length.

The field is fitted on the driver from a bounded sample of labelled documents (``fit_docs`` documents,
the first ``fit_lines`` lines of each, parameters of ``fit``), every line carrying its document's
label.  Scoring reads whole texts, in tasks, document by document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_DOCS = 4000
FIT_LINES = 48
THRESHOLD = 0.3
SLICE = 256                 # texts read from a batch at once; memory only

# byte classes: 0 space, 1 lower case or non-ASCII, 2 upper case, 3 digit, 4 sentence mark, 5 bar, 6 bang, 7 other mark
_CLASS = np.full(256, 7, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _c in b".,;:'\"()-?":
    _CLASS[_c] = 4
_CLASS[ord("|")] = 5
_CLASS[ord("!")] = 6
N_OWN = 15


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights): a row per line of the text; the weight is the line's length plus one."""
    lines = (text or "").split("\n")
    raw = [ln.encode("utf-8", "replace") + b"\n" for ln in lines]
    size = np.array([len(b) for b in raw], np.int64)
    start = np.cumsum(size) - size
    cls = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    counts = np.stack([np.add.reduceat((cls == c).astype(np.int32), start) for c in range(8)], 1).astype(np.float64)
    counts[:, 0] -= 1
    times = Counter(lines)
    out = np.zeros((len(lines), N_OWN))
    n = size - 1
    share = counts / np.maximum(n, 1)[:, None]
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    out[:, 0] = np.log1p(n)
    out[:, 1:8] = share[:, 1:]
    out[:, 8] = counts[:, 2] / letters
    for i, ln in enumerate(lines):
        w = ln.split()
        k = len(w)
        if k:
            out[i, 9] = 1 - len(set(w)) / k
            out[i, 10] = sum(map(eq, w, w[1:])) / k
            out[i, 11] = n[i] / k / 10
            out[i, 12] = math.log1p(k)
        r = times[ln]
        out[i, 13] = math.log(r) if k else 0.0
        out[i, 14] = 1.0 if i and k and ln == lines[i - 1] else 0.0
    return out, size.astype(np.float64)


def _with_neighbours(own: np.ndarray) -> np.ndarray:
    pad = np.zeros((1, own.shape[1]))
    before, after = np.concatenate([pad, own[:-1]]), np.concatenate([own[1:], pad])
    edge = np.zeros((len(own), 2))
    edge[0, 0] = edge[-1, 1] = 1.0
    return np.concatenate([own, before, after, edge, np.ones((len(own), 1))], axis=1)


@dataclass
class Field:
    """Weights of the fitted field; ``constant`` is the score where there was nothing to learn from."""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    node: np.ndarray | None = None       # weight of each feature for "good"
    pair: np.ndarray | None = None       # transition weights [from, to]
    constant: float | None = None

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        own, weight = line_features(text)
        s = ((_with_neighbours(own) - self.mean) / self.scale) @ self.node
        return float(np.dot(marginals(s.tolist(), self.pair), weight) / weight.sum())


def _pass(a: float, pair) -> float:
    """Log-odds a step hands to its neighbour."""
    one, zero = pair[1][1] + a, pair[0][1]
    top = max(one, zero) + math.log1p(math.exp(-abs(one - zero)))
    one, zero = pair[1][0] + a, pair[0][0]
    return top - max(one, zero) - math.log1p(math.exp(-abs(one - zero)))


def marginals(s: list[float], pair: np.ndarray) -> np.ndarray:
    """P(good) of every step of a chain with node log-odds ``s``, by forward-backward."""
    fwd, back, m = pair.tolist(), pair.T.tolist(), len(s)
    f, b = [0.0] * m, [0.0] * m
    for t in range(1, m):
        f[t] = _pass(f[t - 1] + s[t - 1], fwd)
        b[m - 1 - t] = _pass(b[m - t] + s[m - t], back)
    z = np.clip(np.array(f) + np.array(b) + np.array(s), -500, 500)
    return 1 / (1 + np.exp(-z))


def fit_field(chains: list[np.ndarray], labels: np.ndarray, steps: int = 120, ridge: float = 2e-3) -> Field:
    """Maximum conditional likelihood (Adam on the exact gradient), chains batched by padding."""
    if not len(chains) or labels.min() == labels.max():
        return Field(constant=float(labels[0]) if len(chains) else 1.0)
    every = np.concatenate(chains)
    mean, scale = every.mean(0), every.std(0)
    mean[-1], scale[-1] = 0.0, 1.0
    scale[scale < 1e-9] = 1.0
    size = np.array([len(c) for c in chains])
    n, longest = len(chains), int(size.max())
    x = np.zeros((n, longest, every.shape[1]), np.float32)
    for i, c in enumerate(chains):
        x[i, :len(c)] = (c - mean) / scale
    live = np.arange(longest)[None, :] < size[:, None]
    y = labels.astype(np.float64)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))      # classes weigh the same
    per = (share / size)[:, None]                                    # and so do documents
    k = x.shape[2]
    theta, m1, m2 = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    lae = np.logaddexp
    for step in range(1, steps + 1):
        w, pair = theta[:k], theta[k:].reshape(2, 2)
        s = np.where(live, x @ w.astype(np.float32), 0).astype(np.float64)
        f, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        node = np.stack([np.zeros_like(s), s], 2)
        for t in range(1, longest):
            prev = f[:, t - 1] + node[:, t - 1]
            f[:, t] = lae(prev[:, :1] + pair[0], prev[:, 1:] + pair[1])
        for t in range(longest - 2, -1, -1):
            nxt = b[:, t + 1] + node[:, t + 1]
            on = live[:, t + 1]
            b[on, t] = lae(nxt[on, :1] + pair[:, 0], nxt[on, 1:] + pair[:, 1])
        belief = f + b + node
        z = lae(belief[:, :, 0], belief[:, :, 1])
        p = np.exp(belief[:, :, 1] - z)
        err = (y[:, None] - p) * live * per
        grad = np.zeros_like(theta)
        grad[:k] = np.einsum("nt,ntk->k", err.astype(np.float32), x)
        both = live[:, 1:]
        for i in range(2):
            for j in range(2):
                q = np.exp(f[:, :-1, i] + node[:, :-1, i] + pair[i, j] + node[:, 1:, j] + b[:, 1:, j] - z[:, :1])
                seen = (y == i) & (y == j)
                grad[k + 2 * i + j] = (((seen[:, None] - q) * both) * per).sum()
        grad -= ridge * theta
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad ** 2
        theta += 0.15 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-9)
    return Field(mean, scale, theta[:k], theta[k:].reshape(2, 2))


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, n: int, id_col: str = "doc_id",
                    text_col: str = "text") -> list:
    """At most ``n`` (id, text, label) rows in hash order, half of them from either class if it has that many."""
    lab = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
           .where("id is not null and y in (0, 1)").dropDuplicates(["id"]))
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n // 2)
        picked = part if picked is None else picked.unionByName(part)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.join(F.broadcast(picked), "id").dropDuplicates(["id"])       # n rows of two numbers at most


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> Field:
    """The field learned from at most ``fit_docs`` labelled documents, ``fit_lines`` lines of each.

    ``labels`` must hold the rows to learn from only.  Null labels and ids are ignored.  With no labelled
    document every score is 1; with one class only, every score is that class.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mats = [_with_neighbours(line_features(t)[0])[:fit_lines] for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": [m.astype(np.float32).tobytes() for m in mats]})
    rows = (sample_labelled(docs, labels, label_col, fit_docs, id_col, text_col)
            .mapInPandas(run, "id long, y int, x binary").collect())
    rows.sort(key=lambda r: r.id)
    width = 3 * N_OWN + 3
    return fit_field([np.frombuffer(r.x, np.float32).reshape(-1, width).astype(np.float64) for r in rows],
                     np.array([r.y for r in rows], np.int64))


def score(text: Column, field: Field) -> Column:
    """Quality of a text, 0 to 1 (null and empty texts are one empty line)."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([field.score(t) for at in range(0, len(b), SLICE) for t in b.slice(at, SLICE).to_pylist()], pa.float64())
    return run(text.cast("string"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score ``threshold`` or more, columns unchanged."""
    field = fit(docs, labels, text_col=text_col)
    return docs.where(score(F.col(text_col), field) >= threshold)
