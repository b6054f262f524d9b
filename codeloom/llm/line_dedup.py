"""Fuzzy line de-duplication: MinHash of character shingles, high-recall banding, exact Jaccard, union-find.

Signatures and verification are numpy and sets inside Arrow batches; every join, count and shuffle is Spark's.

* Signature: ``BANDS`` x ``ROWS`` minima of hashed ``SHINGLE``-character shingles, every line alike.  A line shorter
  than one shingle is its own only shingle; a long line is read in slabs of ``SLAB`` characters.
* Banding: each band of ``ROWS`` minima is one bucket key.  Two lines at similarity s share one with probability
  1 - (1 - s^ROWS)^BANDS: 0.992 at 0.8, 0.9995 at 0.85; unrelated lines practically never do.
* Centres: the line of a bucket that shares most keys with other lines is compared with every line of the bucket,
  so a family of near copies costs one pair a line and mostly the same ones in every band.
* The rest: pairs in one bucket that those links leave in different components are compared as well, so every pair
  that shares a key is verified, ruled out by a bound or already of one component.  The bound: two sets of A and B
  shingles at similarity s differ in (A + B)(1 - s)/(1 + s) shingles at most, and a shingle in one set only
  flips one of the ``SKETCH`` bits of that set's parity sketch, so sketches differ in no more bits than the sets do.
* Verification: exact Jaccard of the sets of shingles of both whole lines, a shingle known by a 64-bit hash.
* Components of the verified links; of each component's occurrences in the corpus the first one,
  by (id, position), stays.

Exact copies of a line are one node from the start.  A line is known by its 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import connected_components
from codeloom.llm.tables import bit_filter, stored, with_hit

SHINGLE = 5
MIN_SIMILARITY = 0.8
BANDS = 16
ROWS = 6
SLAB = 1 << 16             # characters hashed at once; memory only
SLICE = 1 << 10             # rows of a batch worked on at once; memory only
SKETCH = 1024              # bits of a line's parity sketch
RECENT = 1 << 17           # ids of lines a task remembers so as not to read a repeated line again; memory only
WORDS = [f"s{i}" for i in range(SKETCH // 64)]
NO_ID = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))


def _shingle_hashes(text: str, kind: type = np.uint32) -> np.ndarray:
    """A mixed hash (uint32 or uint64) of the shingle at every place of ``text`` where one begins."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(kind, copy=False)
    bits = 8 * np.dtype(kind).itemsize
    factor, last = (kind(x >> (64 - bits) | 1) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9))
    shift = kind(bits // 2 - 1)
    h = c[:len(c) - SHINGLE + 1].copy()
    t = np.empty_like(h)
    for i in range(1, SHINGLE + 1):
        h *= factor
        np.right_shift(h, shift, out=t)
        h ^= t
        if i < SHINGLE:
            h += c[i:len(c) - SHINGLE + 1 + i]
    h *= last
    np.right_shift(h, shift, out=t)
    h ^= t
    return h


def _factors() -> np.ndarray:
    """The odd factors of the ``BANDS * ROWS`` hash functions of a hashed shingle; the same in every task."""
    return np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def _slabs(lines: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of lines, with the number of their line, in groups of about ``SLAB`` characters."""
    at, pieces, size = [], [], 0
    for i, line in enumerate(lines):
        line = line.ljust(SHINGLE, "\0")
        for lo in range(0, len(line) - SHINGLE + 1, SLAB):
            piece = line[lo:lo + SLAB + SHINGLE - 1]
            at.append(i)
            pieces.append(piece)
            size += len(piece)
            if size >= SLAB:
                yield at, pieces
                at, pieces, size = [], [], 0
    if at:
        yield at, pieces


def signatures(lines: list[str]) -> np.ndarray:
    """One row of ``BANDS * ROWS`` minima (uint32) a line."""
    factors = _factors()
    out = np.full((len(lines), BANDS * ROWS), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at, pieces in _slabs(lines):
        h = _shingle_hashes("".join(pieces))
        n = np.array([len(p) for p in pieces])
        ends = np.cumsum(n)
        inside = np.ones(ends[-1], dtype=bool)
        for back in range(1, SHINGLE):
            inside[ends - back] = False         # shingles that would run into the next piece
        h = h[inside[:len(h)]]
        starts = np.concatenate([[0], np.cumsum(n - SHINGLE + 1)[:-1]])
        low = np.empty((BANDS * ROWS, len(pieces)), dtype=np.uint32)
        v = np.empty_like(h)
        for j in range(BANDS * ROWS):
            np.multiply(h, factors[j], out=v)
            np.minimum.reduceat(v, starts, out=low[j])
        first = np.flatnonzero(np.diff(at, prepend=-1))     # a line may have several pieces
        rows = np.array(at)[first]
        out[rows] = np.minimum(out[rows], np.minimum.reduceat(low, first, axis=1).T)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` bucket keys (long) a line."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = (key ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lid, line) -> (key, lid), one row a band; a line that a task repeats among its last ``RECENT`` is read once."""
    met: set[int] = set()
    for batch in _small(batches):
        ids = batch.column("lid").to_pylist()
        first = {lid: i for i, lid in enumerate(ids) if lid not in met}
        if not first:
            continue
        if len(met) > RECENT:
            met.clear()
        met.update(first)
        lines = batch.column("line").take(pa.array(first.values(), pa.int32())).to_pylist()
        keys = band_keys(signatures(lines))
        lids = np.repeat(np.fromiter(first, dtype=np.int64, count=len(first)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(lids)], names=["key", "lid"])


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("lid != other").select(F.least("lid", "other").alias("a"), F.greatest("lid", "other").alias("b")).distinct()


def bucket_rows(lines: DataFrame) -> DataFrame:
    """(key, lid) of ``lines`` (lid, line): the lines of all buckets that hold two different lines or more.

    Signatures are computed and dealt by key once: the count of a bucket and the choice of its rows read the same
    exchange.  A line in a third of all rows is a row a task and band in it, not a row an occurrence.
    """
    keyed = lines.select("lid", "line").mapInArrow(_keyed, "key long, lid long").repartition("key")
    shared = keyed.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi")).where("lo != hi").select("key")
    return stored(keyed.join(shared.hint("shuffle_hash"), "key").distinct())


def centre_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): in every bucket each line with the one that shares most keys with other lines."""
    size = rows.groupBy("key").agg(F.count("*").alias("m"))
    score = rows.join(size, "key").groupBy("lid").agg(F.sum("m").alias("score"))
    centre = rows.join(score, "lid").groupBy("key").agg(F.max(F.struct("score", "lid")).getField("lid").alias("other"))
    return _pairs(rows.join(centre, "key").select("lid", "other"))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lid, line) -> (lid, n, s0, s1, ...): the number of different shingles and the parity sketch in longs."""
    for batch in _small(batches):
        lids, lines = (batch.column(c).to_pylist() for c in ("lid", "line"))
        lo = 0
        while lo < len(lids):                   # as many lines at once as bring about SLAB characters
            hi, size = lo, 0
            while hi < len(lids) and (hi == lo or size < SLAB):
                size += max(len(lines[hi]), SKETCH)
                hi += 1
            n, words = sketches(lines[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(lids[lo:hi], pa.int64()), pa.array(n), *(pa.array(w) for w in words.T)],
                                             names=["lid", "n", *WORDS])
            lo = hi


def sketched(text: DataFrame) -> DataFrame:
    """Sizes and parity sketches of the lines in ``text`` (lid, line)."""
    return text.select("lid", "line").mapInArrow(_sketched, "lid long, n long, " + ", ".join(f"{w} long" for w in WORDS))


def may_reach(similarity: float) -> Column:
    """False where the sketches (n, s0, ...) and (n2, s0_2, ...) prove two lines less alike than ``similarity``.

    The slack of half a shingle keeps rounding from ruling out a pair at the threshold.
    """
    differ = " + ".join(f"bit_count({w} ^ {w}_2)" for w in WORDS)
    most = (1 - similarity) / (1 + similarity)
    return F.expr(f"abs(n - n2) <= (n + n2) * {most!r}D + 0.5D and {differ} <= (n + n2) * {most!r}D + 0.5D")


def pairs_between(rows: DataFrame, comp: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs in one bucket that lie in different components and may reach ``similarity`` by their sketches.

    Only lines outside a bucket's largest component look for others, so a large family is not paired with itself.
    """
    rows = rows.join(comp.select(F.col("node").alias("lid"), "component"), "lid", "left")
    rows = stored(rows.select("key", "lid", F.coalesce("component", "lid").alias("c")))
    top = rows.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.max(F.struct("m", "c")).getField("c").alias("top"), F.count("*").alias("parts")).where("parts > 1")
    rows = stored(rows.join(top.select("key", "top"), "key").join(sketch, "lid"))
    other = rows.select("key", F.col("lid").alias("other"), F.col("c").alias("c2"), F.col("n").alias("n2"),
                        *[F.col(w).alias(f"{w}_2") for w in WORDS])
    met = rows.where("c != top").join(other, "key").where("c != c2 and (c2 = top or lid < other)").where(may_reach(similarity))
    return _pairs(met.select("lid", "other"))


def _sets(lines: list[str]) -> list[np.ndarray]:
    """The different shingles of each line as sorted 64-bit hashes.  A line shorter than one shingle is padded to one."""
    lines = [t.ljust(SHINGLE, "\0") for t in lines]
    h = _shingle_hashes("".join(lines), np.uint64)
    out, lo = [], 0
    for t in lines:
        x = np.sort(h[lo:lo + len(t) - SHINGLE + 1])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        lo += len(t)
    return out


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of different shingles of each line, and a row of ``SKETCH / 64`` longs a line, their parity sketch."""
    sets = _sets(lines)
    n = np.array([len(x) for x in sets], dtype=np.int64)
    at = np.repeat(np.arange(len(sets), dtype=np.int64) * SKETCH, n) + (np.concatenate(sets) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * SKETCH) & 1).astype(np.uint8).reshape(len(sets), SKETCH)
    return n, np.packbits(odd, axis=1).view(np.int64)


def jaccards(lines: list[str], pairs: list[tuple[int, int]]) -> list[float]:
    """Exact Jaccard of the shingles of pairs of ``lines``, given by their numbers; each line is cut and hashed once."""
    sets = _sets(lines)
    out = []
    for i, j in pairs:
        both = np.sort(np.concatenate([sets[i], sets[j]]))
        n = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(n / (len(both) - n))
    return out


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            lo = 0
            while lo < len(a):                  # as many pairs at once as bring about SLAB characters
                at, lines, size, hi = {}, [], 0, lo
                while hi < len(a) and (hi == lo or size < SLAB):
                    for lid, t in ((a[hi], ta[hi]), (b[hi], tb[hi])):
                        if lid not in at:
                            at[lid] = len(lines)
                            lines.append(t)
                            size += len(t)
                    hi += 1
                near = jaccards(lines, [(at[a[i]], at[b[i]]) for i in range(lo, hi)])
                keep = [i for i, j in zip(range(lo, hi), near) if j >= similarity]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b)], names=["u", "v"])
                lo = hi
    return run


def named(text: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines of ``text`` (lid, line) that ``pairs`` (a, b) name, and a few others: the filter has a fixed size."""
    ends = pairs.select(F.col("a").alias("lid")).unionByName(pairs.select(F.col("b").alias("lid")))
    return with_hit(text, F.col("lid"), bit_filter(ends, "lid")).where("__hit").select("lid", "line")


def verified(pairs: DataFrame, text: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the candidate pairs (a, b) at ``similarity`` or more, by the lines in ``text`` (lid, line)."""
    both = (pairs.join(text.select(F.col("lid").alias("b"), F.col("line").alias("tb")), "b")
            .join(text.select(F.col("lid").alias("a"), F.col("line").alias("ta")), "a"))
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(similarity), "u long, v long")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(k, gone): per document the positions (from 0) of lines that repeat an earlier one.

    Lines end at ``\\n``.  Blank lines are never duplicates.  A null id counts as larger than every id;
    rows that share an id count as one document.  Documents that lose nothing have no row.
    """
    base = _base(docs, id_col, text_col)
    lines = (base.select("k", F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
             .where(F.col("line").rlike(r"\S")).withColumn("lid", F.xxhash64("line")))
    rows = bucket_rows(lines)
    first = stored(centre_pairs(rows))
    wanted = stored(rows.select("lid").distinct())
    # a filter of fixed size keeps most other lines out of the shuffle
    text = with_hit(lines.select("lid", "line"), F.col("lid"), bit_filter(wanted, "lid")).where("__hit").select("lid", "line")
    text = stored(text.dropDuplicates(["lid"]).join(wanted, "lid", "left_semi"))
    links = stored(verified(first, text, similarity))
    comp = connected_components(links)
    rest = stored(pairs_between(rows, comp, sketched(text), similarity).join(first, ["a", "b"], "left_anti"))
    more = stored(verified(rest, named(text, rest), similarity))     # few lines are in them, so few are shuffled again
    comp = connected_components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    known = lines.groupBy("lid").agg(F.count("*").alias("n"), F.min(F.struct("k", "pos")).alias("place"))
    group = stored(known.join(comp, known["lid"] == comp["node"], "left").where((F.col("n") > 1) | F.col("component").isNotNull())
                   .select("lid", F.coalesce("component", "lid").alias("c"), "place"))
    stays = group.join(group.groupBy("c").agg(F.min("place").alias("stays")), "c").select("lid", "stays")
    seen = with_hit(lines.select("k", "pos", "lid"), F.col("lid"), bit_filter(group, "lid")).where("__hit")
    return (seen.join(stays, "lid").where(F.struct("k", "pos") != F.col("stays"))
            .groupBy("k").agg(F.collect_set("pos").alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` with duplicate lines cut out of the text, plus n_lines and n_removed (long, before and cut).

    Columns of ``docs`` keep their names and values, except that a null text becomes empty.  A document
    whose lines all go stays as a row with empty text.  Empty tables give no rows.
    """
    gone = stored(duplicate_lines(docs, id_col, text_col, similarity).select(F.col("k").alias("__k"), F.col("gone").alias("__gone")))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    # documents that lose nothing stay where they are; the filter has a fixed size
    marked = with_hit(docs, F.xxhash64(key), bit_filter(gone.select(F.xxhash64("__k").alias("h")), "h"))
    # a row a document that loses lines: joined by shuffle at every size, never sent whole through the driver
    out = marked.where("__hit").join(gone.hint("merge"), key == F.col("__k"), "left").drop("__k").unionByName(
        marked.where("not __hit").withColumn("__gone", F.lit(None).cast("array<int>")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ls = _lines(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size("__ls") - 1), F.col("__gone"))
    new = F.when(F.col("__gone").isNull(), text).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("__ls"), i)), "\n"))
    out = out.withColumn("__ls", F.when(F.col("__gone").isNotNull(), ls))
    return out.select(*[(new.alias(c) if c == text_col else F.col(c)) for c in docs.columns],
                      (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                      F.coalesce(F.size(F.col("__gone")), F.lit(0)).cast("long").alias("n_removed"))
