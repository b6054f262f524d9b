"""SentencePiece models on the tokenizers library.

The model file is a protobuf; it is read here field by field, and its normaliser, metaspace marker, pieces
and byte fallback are rebuilt as a ``tokenizers.Tokenizer``: a unigram model from the piece scores, or for a
BPE model the merges its scores imply (a pair merges with the rank of the piece it makes).

Texts are encoded in batches by the library's threads.  Where the model allows it (identity normaliser, no
piece with an inner metaspace) a text is the concatenation of its space-led strings, so each different string
is encoded once per worker and remembered in a bounded cache; otherwise whole texts go through the tokenizer.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.wordcache import PartCache

MARK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_LOADED: dict[str, "Backend"] = {}


# --- the model file -----------------------------------------------------------------------

def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i:i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, i = b[i:i + n], i + n
        else:
            raise ValueError(f"not a model file: wire type {kind}")
        yield tag >> 3, v


@dataclass
class Model:
    """What a model file says; field numbers are those of the public sentencepiece_model.proto."""
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    m = Model([])
    for f, v in _fields(data):
        if f == 1:
            p = dict(_fields(v))
            m.pieces.append((p[1].decode("utf-8"), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, _NORMAL)))
        elif f == 2:
            t = dict(_fields(v))
            m.kind, m.byte_fallback, m.unknown = t.get(3, UNIGRAM), bool(t.get(35, 0)), t.get(40, 0)
        elif f == 3:
            n = dict(_fields(v))
            m.charsmap, m.dummy_prefix = n.get(2, b""), bool(n.get(3, 1))
            m.squeeze, m.escape = bool(n.get(4, 1)), bool(n.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces in the order a BPE model merges them: best score of the piece they make first."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (_NORMAL, _USER)}
    found = []
    for p, i in ids.items():
        for cut in range(1, len(p)):
            a, b = p[:cut], p[cut:]
            if a in ids and b in ids:
                found.append((-m.pieces[i][1], i, ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(m: Model, chunk: bool = False):
    """The model as a tokenizer; with ``chunk`` its input already carries the dummy prefix."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    if m.kind == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[m.unknown][0],
                           fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback)
    t = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix and not chunk:
        steps.append(normalizers.Prepend(MARK))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, _ in m.pieces):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    ends = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(ends + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return t


class Backend:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = parse(f.read())
        m = self.model
        self.tokenizer = build(m)
        plain = not m.charsmap and not m.squeeze and m.escape and m.dummy_prefix
        self.by_string = plain and not any(MARK in p.lstrip(MARK) for p, _, _ in m.pieces)
        self.cache = PartCache(build(m, chunk=True).encode_batch_fast) if self.by_string else None
        control = {i for i, (_, _, kind) in enumerate(m.pieces) if kind == _CONTROL}
        self.bytes_of = [b"" if i in control else b" \xe2\x81\x87 " if kind == _UNKNOWN else bytes([int(p[3:5], 16)]) if kind == _BYTE
                         else p.replace(MARK, " ").encode() for i, (p, _, kind) in enumerate(m.pieces)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text, without begin or end markers."""
        if not self.by_string:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        split = [_SPACED.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        return [np.frombuffer(b, "<u4") for b in self.cache.join(split, self._learn)]

    def _learn(self, strings: list[str]) -> None:
        self.cache.known.update(zip(strings, self.cache.learn(strings)))

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; byte pieces are joined before they are read as UTF-8."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if self.model.dummy_prefix and raw[:1] == " " else raw


_SPACED = re.compile(" *[^ ]+| +")


def backend(path: str) -> Backend:
    if path not in _LOADED:
        _LOADED[path] = Backend(path)
    return _LOADED[path]


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True,
                 batch: int = 128) -> DataFrame:
    """(id, ids binary of little-endian uint32, n_ids, decoded, parity): every whole text encoded and decoded.

    With ``verify`` each text is also encoded by the sentencepiece library and ``parity`` says whether the ids
    agree (null otherwise).  Null texts count as empty; null and repeated ids and repeated rows are rows of
    their own; other columns are ignored.  A metaspace character in a text decodes as a space, as it does in
    the sentencepiece library.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = backend(path)
        if verify:
            import sentencepiece
            other = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at:at + batch]
                texts = [t or "" for t in part["text"]]
                ids = own.encode(texts)
                same = ([i.tolist() == j for i, j in zip(ids, other.encode(texts, num_threads=1))] if verify else [None] * len(ids))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "ids": [i.tobytes() for i in ids], "n_ids": [len(i) for i in ids],
                                    "decoded": [own.decode(i) for i in ids], "parity": same})
    src = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInPandas(run, "id string, ids binary, n_ids long, decoded string, parity boolean")
    return out.withColumn("id", F.col("id").cast("long"))


