"""Toxicity by weak supervision.

1. Terms.  Words, and stems (the first 3 to 8 letters of longer words), that are more frequent in the
   toxic than in the clean documents of a bounded labelled sample than chance explains.
2. Voters.  Terms are dealt to lexicon voters (words) and pattern voters (stems); further patterns vote on how
   many different terms a text has and how dense they are.  A voter says toxic, clean or nothing.
3. Label model.  A generative model of the votes: the class prior and each voter's distribution of votes given
   the class (its accuracies) by expectation maximisation, and the correlations between voters that the class
   does not explain; correlated voters share their say.  It yields the posterior probability that each
   document of the sample is toxic.
4. Classifier.  A logistic regression on term counts, trained on those posteriors, its intercept moved to the
   share of toxic documents among all labelled rows.

Scoring finds terms in whole texts with one Aho-Corasick automaton per worker.  Bounds of the fit are
parameters: ``fit_docs`` documents, the first ``fit_chars`` characters of each, ``max_terms`` words and as many
stems.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.quality import sample_labelled

FIT_DOCS = 6000
FIT_CHARS = 30_000
MAX_TERMS = 600
STEMS = (3, 4, 5, 6, 7, 8)
N_VOTERS = 10          # of either kind
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_SCANNERS: dict[int, object] = {}


def _terms_of(text: str) -> set[str]:
    """Words and stems (marked by a trailing star) of a text."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def mine(texts: list[str], labels: np.ndarray, max_terms: int = MAX_TERMS) -> list[str]:
    """Terms of the toxic texts by weight of evidence; copies of a text count once."""
    seen, toxic, clean, n = set(), Counter(), Counter(), [0, 0]
    for t, y in zip(texts, labels):
        key = zlib.crc32(" ".join(t.lower().split()[3:15]).encode())
        if key not in seen:
            seen.add(key)
            (toxic if y else clean).update(_terms_of(t))
            n[int(y)] += 1
    found, base = [], n[1] / max(1, n[0] + n[1])
    tried = sum(k >= 3 for k in toxic.values())
    for term, k in toxic.items():
        c = clean[term]
        q = k / (k + c)
        lift = math.log((k + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
        if k < 3 or len(term.rstrip("*")) < 3 or lift < math.log(4):
            continue
        # Chernoff bound on seeing this share of toxic texts by chance, over all terms tried
        chance = (k + c) * (q * math.log(q / base) + ((1 - q) * math.log((1 - q) / (1 - base)) if c else 0.0))
        if chance > math.log(tried) + 2:
            found.append((-chance, term))
    found.sort()
    return ([t for _, t in found if t[-1] != "*"][:max_terms] + [t for _, t in found if t[-1] == "*"][:max_terms])


class Scanner:
    """Counts of each term in a text."""

    def __init__(self, terms: list[str]):
        import ahocorasick
        self.machine = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, bool]]] = {}
        for i, t in enumerate(terms):
            at.setdefault(t.rstrip("*"), []).append((i, t[-1] == "*"))
        for t, uses in at.items():
            self.machine.add_word(t, (len(t), uses))
        if at:
            self.machine.make_automaton()
        self.empty = not at

    def count(self, text: str) -> dict[int, int]:
        low, out = text.lower(), {}
        if self.empty:
            return out
        for end, (n, uses) in self.machine.iter(low):
            if end >= n and low[end - n].isalpha():
                continue
            more = end + 1 < len(low) and low[end + 1].isalpha()
            for i, stem in uses:
                if stem == more:
                    out[i] = out.get(i, 0) + 1
        return out


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None        # a weight a term, then those of _shape
    intercept: float = 0.0
    constant: float | None = None            # the score where there was nothing to learn from
    accuracies: np.ndarray | None = None     # [voter, class, vote], for reports
    correlations: np.ndarray | None = None

    def score(self, text: str | None, scanner: Scanner) -> float:
        if self.constant is not None:
            return self.constant
        text = text or ""
        counts = scanner.count(text)
        z = self.intercept + float(np.dot(_shape(counts, text), self.weights[-N_SHAPE:]))
        z += sum(self.weights[i] * math.log1p(k) for i, k in counts.items())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


N_SHAPE = 5


def _shape(counts: dict[int, int], text: str) -> list[float]:
    n = text.count(" ") + text.count("\n") + 1
    dense = min(1.0, 20 * sum(counts.values()) / n)
    return [1.0 if counts else 0.0, math.log1p(len(counts)), dense, math.sqrt(dense), math.log(n) / 5 if counts else 0.0]


def votes(counts: list[dict[int, int]], terms: list[str], texts: list[str], labels: np.ndarray) -> np.ndarray:
    """[document, voter]: 0 nothing, 1 clean, 2 toxic; the last voter is the label."""
    deal = [zlib.crc32(t.encode()) % N_VOTERS + (N_VOTERS if t[-1] == "*" else 0) for t in terms]
    out = np.zeros((len(counts), 2 * N_VOTERS + 5), np.int64)
    out[:, -1] = 1 + labels
    for d, (c, text) in enumerate(zip(counts, texts)):
        for i in c:
            out[d, deal[i]] = 2
        any_, _, dense, *_ = _shape(c, text)
        out[d, 2 * N_VOTERS] = 2 if any_ else 1
        out[d, 2 * N_VOTERS + 1] = 2 if len(c) >= 3 else 1 if not c else 0
        out[d, 2 * N_VOTERS + 2] = 2 if dense >= 0.1 else 1 if dense < 0.01 else 0
        out[d, 2 * N_VOTERS + 3] = 2 if sum(c.values()) >= 5 else 0
    return out


def label_model(v: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, accuracies [voter, class, vote], correlations [voter, voter]) of a table of votes."""
    n, m = v.shape
    hot = np.stack([v == s for s in range(3)], 2).astype(np.float64)         # document, voter, vote
    say, corr = np.ones(m), np.zeros((m, m))
    shared = np.ones(m)
    shared[-1] = 0                                                             # its correlations are the class itself
    p = np.where(v[:, -1] == 2, 0.95, 0.05)                                    # start from the last voter
    acc = np.zeros((m, 2, 3))
    for _ in range(rounds):
        w = np.stack([1 - p, p], 1)
        acc = (np.einsum("nc,nms->mcs", w, hot) + 0.5) / (w.sum(0)[None, :, None] + 1.5)
        mean = np.einsum("nc,mc->nm", w, acc[:, :, 2])
        left = (v == 2) - mean                                               # what the class does not explain
        cov = left.T @ left / max(n, 1)
        dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / dev[:, None] / dev[None, :]
        np.fill_diagonal(corr, 0)
        say = 1 / (1 + shared * (np.maximum(corr, 0) @ shared))
        prior = np.clip(w.mean(0), 0.01, 0.99)
        logp = np.log(prior)[None, :] + np.einsum("nms,mcs,m->nc", hot, np.log(acc), say)
        p = 1 / (1 + np.exp(np.clip(logp[:, 0] - logp[:, 1], -500, 500)))
    return p, acc, corr


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (intercept last) of a logistic regression on soft labels, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(pen), x.T @ (p - q) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_model(texts: list[str], labels: np.ndarray, share: float) -> Model:
    if not len(texts) or labels.min() == labels.max():
        return Model(constant=float(labels[0]) if len(texts) else 0.0)
    terms = mine(texts, labels)
    scan = Scanner(terms)
    counts = [scan.count(t) for t in texts]
    p, acc, corr = label_model(votes(counts, terms, texts, labels))
    x = np.zeros((len(texts), len(terms) + N_SHAPE))
    for d, (c, t) in enumerate(zip(counts, texts)):
        for i, k in c.items():
            x[d, i] = math.log1p(k)
        x[d, len(terms):] = _shape(c, t)
    w = logistic(x, p)
    own = min(max(float(p.mean()), 0.01), 0.99)                  # the sample's classes are not as frequent as the rows'
    share = min(max(share, 1e-4), 0.99)
    shift = math.log(share / (1 - share)) - math.log(own / (1 - own))
    return Model(terms, w[:-1], float(w[-1] + shift), None, acc, corr)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """The model learned from at most ``fit_docs`` labelled documents; ``labels`` holds the rows to learn from only.

    Null labels and ids are ignored.  With no labelled document every score is 0, with one class only that class.
    """
    rows = (sample_labelled(docs, labels, label_col, fit_docs, id_col, text_col)
            .select("id", "y", F.substring(F.coalesce("text", F.lit("")), 1, fit_chars).alias("text")).collect())
    rows.sort(key=lambda r: r.id)
    share = labels.agg(F.avg(F.when(F.col(label_col).isin(0, 1), F.col(label_col).cast("double")))).first()[0] or 0.0
    return fit_model([r.text for r in rows], np.array([r.y for r in rows], np.int64), share)


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic, 0 to 1; null and empty texts hold no term."""
    key = hash(tuple(model.terms))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[key] = Scanner(model.terms)
        scan = _SCANNERS[key]
        for b in batches:
            yield pd.Series([model.score(t, scan) for t in b], dtype="float64")
    return run(text.cast("string"))
