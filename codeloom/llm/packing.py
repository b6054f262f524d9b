"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of more than ``C / (k + 1)`` and at
most ``C / k`` tokens, and each of its bins takes exactly k of them, whatever they are.  So a piece's bin
follows from its rank in its class alone, ``rank // k``; partitions rank their own pieces and add the
counts of the partitions before them, and no bin is ever looked at by two workers.

Documents may be cut, which removes the classes' waste: whole sequences first, then from the rest the
largest ``C // k`` that fits, until at most ``C // 16`` tokens remain as a last piece.  Pieces cut to
``C // k`` fill their bins but for less than k tokens.

The last, incomplete bin of each class is emptied again; those pieces, fewer than k a class and so fewer
than a fixed number however large the corpus (about 25,000 for C = 4096), are packed best fit in one task.

Token ids come from the tokenizers library.  White space separates words for the tokenizer and is dropped,
so a text's ids are the concatenation of the ids of its white-space separated strings; those are encoded
once per worker, in batches, and remembered in a bounded cache.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.wordcache import PartCache
from codeloom.session import cut_lineage

CAPACITY = 4096
EOS = 2
_SPECIAL = b"<|"                       # every special token of the vocabulary starts with this
TOGETHER = 64                          # words joined to one string
BATCH = 64                             # strings given to the tokenizer at once; memory only
SLICE = 256                            # texts read from a batch at once; memory only
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of a text, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = PartCache(self.tokenizer.encode_batch_fast, BATCH)
        self.ends: dict[str, bool] = {}
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.between = next(((i, c) for i, c in special if c.encode().startswith(_SPECIAL)), None)

    def _ends_word(self, letter: str) -> bool:
        """Whether a full stop or comma after this letter is a string of its own: a mark that the letter normalises to would join it."""
        if letter not in self.ends:
            norm, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer.pre_tokenize_str
            cuts = [cut(x if norm is None else norm.normalize_str(x)) for x in (f"a{letter}.", f"a{letter},")]
            self.ends[letter] = [c[-1][0] for c in cuts] == [".", ","]
        return self.ends[letter]

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.  Many go through the tokenizer as one string: it cuts at a special token before all else."""
        if self.between is None:
            return self.cache.learn(texts)
        number, mark = self.between
        own = [i for i, t in enumerate(texts) if _SPECIAL.decode() in t]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(own, self.cache.learn([texts[i] for i in own])):
            out[i] = ids
        rest = sorted(set(range(len(texts))).difference(own)) if own else range(len(texts))
        groups = [rest[at:at + TOGETHER] for at in range(0, len(rest), TOGETHER)]
        for group, ids in zip(groups, self.cache.learn([mark.join([texts[i] for i in g]) for g in groups])):
            cut = 4 * np.flatnonzero(np.frombuffer(ids, "<u4") == number)
            for i, a, b in zip(group, [0, *(cut + 4).tolist()], [*cut.tolist(), len(ids)]):
                out[i] = ids[a:b]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """A word followed by a full stop or comma is two strings to the tokenizer, so only the word is encoded."""
        known, plain, ends = self.cache.known, {}, []
        for x in words:
            t = x.decode()
            if t[-1] in ".," and t[:-1].isalpha() and ("a" <= t[-2] <= "z" or self._ends_word(t[-2])):
                ends.append((x, x[:-1], x[-1:]))
                t = t[:-1]
            key = t.encode()
            if key not in known:
                plain[key] = t
        for x in (b".", b","):
            if x not in known:
                plain[x] = x.decode()
        known.update(zip(plain, self._ids(list(plain.values()))))
        for x, word, end in ends:
            known[x] = known[word] + known[end]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        # the tokenizer lower-cases all but special tokens
        return self.cache.join([(b if _SPECIAL in b else b.lower()).split() for b in raw], self._learn)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest > capacity // 16:
        k = -(-capacity // rest)
        out.append((capacity // k, k))
        rest -= capacity // k
    if rest:
        out.append((rest, capacity // rest))
    return out


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           eos: int = EOS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, cls[, ids]): the pieces of every document row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([eos], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part, rows = b.slice(at, SLICE), []
                for doc, ids in zip(part.column("id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length, k in cut(n, capacity):
                        own = ids[4 * start:4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(own), n, k) + ((own,) if keep_ids else ()))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, cls int"
    schema += ", ids binary" if keep_ids else ""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    src = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each piece: longest first, into the fullest bin that still has room."""
    room: list[tuple[int, int]] = []
    bins, n = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, n = capacity, n, n + 1
        bins[i] = b
        if free > lengths[i]:
            bisect.insort(room, (free - lengths[i], b))
    return bins


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         eos: int = EOS, keep_ids: bool = False, part_pieces: int = 50_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens[, ids]).

    Every document's ids followed by ``eos`` are cut into pieces; each id lies in exactly one piece, pieces
    of a sequence are gapless from offset 0 and hold at most ``capacity`` tokens.  Null and empty texts are
    the single id ``eos``.  Null and repeated ids are packed as rows of their own; other columns are ignored;
    an empty table gives no rows.  Sequence ids run from 0 without gaps.
    """
    p = cut_lineage(pieces(docs, path, id_col, text_col, capacity, eos, keep_ids))
    parts = max(1, -(-p.count() // part_pieces))
    p = p.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    each = p.groupBy("cls", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("cls", "part", F.coalesce(before, F.lit(0)).alias("before"))
    per = p.groupBy("cls").agg(F.count("*").alias("n"))                    # one row a class
    full = per.withColumn("bins", F.floor(F.col("n") / F.col("cls")))
    upto = F.sum("bins").over(Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1))
    full = full.select("cls", "bins", F.coalesce(upto, F.lit(0)).alias("base"), F.sum("bins").over(Window.partitionBy()).alias("all"))
    own = F.row_number().over(Window.partitionBy("part", "cls").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
    ranked = (p.withColumn("own", own).join(each, ["cls", "part"]).join(F.broadcast(full), "cls")   # a row a class: capacity at most
              .withColumn("rank", F.col("before") + F.col("own") - 1))
    whole = F.col("rank") < F.col("bins") * F.col("cls")
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    done = ranked.where(whole).select(*keep, "cls", "rank", (F.col("base") + F.floor(F.col("rank") / F.col("cls"))).alias("sequence_id"))

    def last_bins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cls", "rank"], ignore_index=True)
        return pd.DataFrame({"cls": pdf["cls"], "rank": pdf["rank"],
                             "sequence_id": pdf["all"] + np.array(best_fit(pdf["length"].tolist(), capacity), np.int64)})
    rest = ranked.where(~whole)
    # fewer than cls pieces of each class, so a bounded group
    placed = (rest.select("cls", "rank", "length", "all").groupBy("all")
              .applyInPandas(last_bins, "cls int, rank long, sequence_id long"))
    rest = rest.select(*keep, "cls", "rank").join(placed, ["cls", "rank"])
    out = done.unionByName(rest)
    w = Window.partitionBy("sequence_id")
    offset = F.sum("length").over(w.orderBy("cls", "rank").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("offset", F.coalesce(offset, F.lit(0))).withColumn("sequence_tokens", F.sum("length").over(w))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens",
                      *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary): the token ids of each sequence, from ``pack(..., keep_ids=True)``."""
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return got.select("sequence_id", F.aggregate(F.col("p.ids"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
