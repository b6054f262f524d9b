"""SimHash near-duplicates found with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  If two fingerprints differ in at
most three bits, the errors fall on the segments as (0, <=1, any) in some order or as (1, 1, 1).
Each segment, seen as a word of the perfect binary [23, 12] Golay code, is decoded to the index of
its codeword; the indices of the word itself and of every word one bit away are its *fuzzy* set
(one index, or six).  A segment with at most one error always meets in that set:

* one segment equal and another with at most one error: key (equal segment, fuzzy index), six
  ordered pairs of segments;
* one error in each segment: one side emits (fuzzy, fuzzy, own) and the other (own, own, fuzzy).

So every pair within three bits shares a key of at least 33 bits.  Keys are shuffled once; each run
of equal keys is searched for links at the true bit distance, breadth first over the members not yet
reached, and emits a spanning forest (members - 1 links at most), never all pairs.  Components come
from the distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import connected_components
from codeloom.session import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))   # (shift, width) of the three segments
GENERATOR = 0xC75                           # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_CHUNK = 1 << 15                            # shingles hashed at once, bounds memory on huge texts


# --- fingerprints -------------------------------------------------------------------------

def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of one text: XXH64 of lower-cased word shingles, repeats counted, majority per bit."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    n, ones = len(w) - words + 1, np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, n, _CHUNK):
        part = w[at:min(at + _CHUNK, n) + words - 1]
        raw = b"".join([digest(join(s), seed) for s in zip(*(part[i:] for i in range(words)))])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): one row per document; fp is the 64-bit fingerprint as a signed long.

    Null and blank texts have fingerprint zero.  Null ids and repeated ids are carried through.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"id": b["id"], "fp": fp.view(np.int64)})
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # ids travel as strings so that a null id does not turn the batch into floats
    return (src.withColumn("id", F.col("id").cast("string")).mapInPandas(run, "id string, fp long")
            .select(F.col("id").cast("long").alias("id"), "fp"))


# --- Golay keys ---------------------------------------------------------------------------

def _remainder(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64)
    for i in range(22, 10, -1):
        r ^= ((r >> i) & 1) * (GENERATOR << (i - 11))
    return r


def _error_table() -> np.ndarray:
    """Syndrome -> error pattern: the code is perfect, so the 2048 patterns of weight <= 3 fill it."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one[None, :]).ravel()
    three = (two[:, None] | one[None, :]).ravel()
    patterns = np.unique(np.concatenate([[0], one, two, three]))
    table = np.zeros(2048, np.int64)
    table[_remainder(patterns)] = patterns
    return table


_TABLE = _error_table()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _TABLE[_remainder(words)]) >> 11


def _fuzzy(seg: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs: distinct codeword indices of a segment and of its one-bit neighbours."""
    near = np.concatenate([seg[:, None], seg[:, None] ^ (1 << np.arange(width))[None, :]], axis=1)
    pairs = np.unique((np.arange(len(seg))[:, None] << 12 | decode(near.ravel()).reshape(near.shape)).ravel())
    return pairs >> 12, pairs & 4095


def _cross(ra, a, rb, b):
    """All (row, a, b) with equal row; ra and rb are sorted."""
    n = int(max(ra.max(initial=-1), rb.max(initial=-1))) + 1
    cb = np.bincount(rb, minlength=n)
    first = np.cumsum(cb) - cb
    reps = cb[ra]
    row = np.repeat(ra, reps)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
    return row, np.repeat(a, reps), b[first[row] + inner]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every key under which each fingerprint (uint64) is filed."""
    segs = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    own = [decode(s) for s in segs]
    fuzzy = [_fuzzy(s, w) for s, (_, w) in zip(segs, SEGMENTS)]
    rows, keys = [], []
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                r, idx = fuzzy[j]
                rows.append(r)
                keys.append((kind << 36) | (segs[i][r] << 12) | idx)
                kind += 1
    r, a, b = _cross(*fuzzy[0], *fuzzy[1])
    rows.append(r)
    keys.append((6 << 36) | (a << 24) | (b << 12) | own[2][r])
    r, c = fuzzy[2]
    rows.append(r)
    keys.append((6 << 36) | (own[0][r] << 24) | (own[1][r] << 12) | c)
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the distinct fingerprints (uint64) linked at ``max_bits`` or fewer."""
    links, left = [], fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = np.bitwise_count(left ^ p) <= max_bits
            if near.any():
                hit = left[near]
                left = left[~near]
                queue.extend(hit)
                links.extend((int(p), int(q)) for q in hit)
    return links


def _links_of_runs(key: np.ndarray, fp: np.ndarray, max_bits: int, seen: set) -> None:
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    two = start[size == 2]
    a, b = fp[two], fp[two + 1]
    d = np.bitwise_count(a ^ b)
    ok = (d <= max_bits) & (d > 0)
    seen.update(zip(a[ok].tolist(), b[ok].tolist()))
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        members = np.unique(fp[s:s + n])
        if len(members) > 1:
            seen.update(_forest(members, max_bits))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links between distinct fingerprints at ``max_bits`` (at most 3) or fewer differing bits.

    The links span the same components as all such pairs do.  ``fps`` needs the column fp (long).
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the segment scheme covers at most three differing bits")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 4096):
                fp = b["fp"].to_numpy(np.int64)[at:at + 4096].view(np.uint64)
                row, key = golay_keys(fp)
                yield pd.DataFrame({"key": key, "fp": fp[row].view(np.int64)})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp, seen = np.empty(0, np.int64), np.empty(0, np.uint64), set()
        for b in batches:
            key = np.concatenate([key, b["key"].to_numpy(np.int64)])
            fp = np.concatenate([fp, b["fp"].to_numpy(np.int64).view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0   # the last run may go on
            if cut:
                _links_of_runs(key[:cut], fp[:cut], max_bits, seen)
                key, fp = key[cut:], fp[cut:]
            if len(seen) > 100_000:
                yield _links_frame(seen)
                seen = set()
        if len(key):
            _links_of_runs(key, fp, max_bits, seen)
        if seen:
            yield _links_frame(seen)

    keys = fps.select("fp").distinct().mapInPandas(emit, "key long, fp long")
    return (keys.repartition("key").sortWithinPartitions("key")
            .mapInPandas(search, "u long, v long").distinct())


def _links_frame(seen: set) -> pd.DataFrame:
    e = np.array(list(seen), np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"u": e[:, 0], "v": e[:, 1]})


# --- operator -----------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component, n_links): one row per document with the smallest id of its group.

    ``component`` is the smallest id reachable over fingerprints at ``max_bits`` or fewer differing
    bits (null only if every id of the group is null).  ``n_links`` counts the spanning links at the
    document's fingerprint.  Documents with equal fingerprints are one node of the search; empty
    tables give no rows; extra columns are ignored.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, words))
    found = cut_lineage(links(fps, max_bits))
    comp = connected_components(found)
    degree = (found.select("u").unionByName(found.select(F.col("v").alias("u")))
              .groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_links")))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    nodes = (nodes.join(comp, nodes["fp"] == comp["node"], "left").drop("node")
             .withColumn("component", F.coalesce("component", "fp")))
    low = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(low, "component").join(degree, F.col("fp") == F.col("node"), "left")
    nodes = nodes.select("fp", F.col("component_id").alias("component"),
                         F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return fps.join(nodes, "fp").select("id", "fp", "component", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents whose id is the smallest of their group; rows sharing an id are one document.

    Rows without an id cannot be told apart and are all kept.
    """
    near = near_duplicates(docs, id_col, text_col, words, max_bits)
    drop = near.where("id is not null and id != component").select(F.col("id").alias("__id")).distinct()
    kept = docs.join(drop, docs[id_col].cast("long") == drop["__id"], "left_anti")
    named = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return named.unionByName(kept.where(F.col(id_col).isNull()))


def hex64(col) -> F.Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))
