"""Encode texts whose ids are the concatenation of the ids of their parts: each different part once per worker."""

from __future__ import annotations

import array
from collections.abc import Callable, Sequence

MAX_PARTS = 1_200_000


class PartCache:
    """Ids of parts as bytes of little-endian 32-bit numbers; emptied when it holds ``MAX_PARTS``."""

    def __init__(self, encode_batch: Callable, batch: int = 4096):
        self.encode_batch, self.batch, self.known = encode_batch, batch, {}

    def learn(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of texts that are not in the cache, by the library's batch encoder."""
        out = []
        for at in range(0, len(texts), self.batch):
            out += [array.array("I", e.ids).tobytes() for e in self.encode_batch(list(texts[at:at + self.batch]), add_special_tokens=False)]
        return out

    def join(self, split: list[list], learn_all: Callable[[list], None]) -> list[bytes]:
        """One bytes object per list of parts; ``learn_all`` fills the cache for parts it does not know."""
        if len(self.known) > MAX_PARTS:
            self.known.clear()
        known, get = self.known, self.known.get
        found = [list(map(get, parts)) for parts in split]
        gaps = [[i for i, v in enumerate(f) if v is None] if None in f else () for f in found]
        new = dict.fromkeys(parts[i] for parts, gap in zip(split, gaps) for i in gap)
        if new:
            learn_all(list(new))
            for parts, f, gap in zip(split, found, gaps):
                for i in gap:
                    f[i] = known[parts[i]]
        return [b"".join(f) for f in found]
