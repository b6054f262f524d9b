"""Fill-in-the-middle examples by repeated-capture matching.

A text is cut between its units (a run of non-space with the space before it, or trailing space).  One
``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of the group, so ``ends(1)`` gives
the number of units and the offset after each of them, and both cuts are looked up there.  The repetition is
possessive: units cover every text in one way only, so nothing is ever retried and memory is the list of ends.

The two cuts, the form and whether a text is transformed at all follow from a hash of the document's id, so a
repeated task writes the same rows.  Examples are put back together by ``restored``, in built-in functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50             # of a hundred texts, how many are transformed
SPM_RATE = 80         # of a hundred of those, how many have the suffix first

_SPACE = r"\x20\x09-\x0D"
UNITS = regex.compile(rf"([{_SPACE}]*+[^{_SPACE}]++|[{_SPACE}]++)*+")


def unit_ends(text: str) -> list[int]:
    """Offset after each unit, in code points."""
    return UNITS.fullmatch(text).ends(1)


def draws(seed: int, doc_id: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that follow from the seed and the id."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return int(h[0:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def transform(text: str, doc_id: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
           spm_rate: int = SPM_RATE, batch: int = 128) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): every whole text as one training example.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); a plain output is the text
    and its char counts are null.  Texts that are empty or hold a marker stay plain, so an output always reads
    back.  Null texts count as empty and a null id draws as the empty string; repeated ids and repeated rows
    are rows of their own with equal draws; other columns are ignored; an empty table gives no rows.
    """
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                rows = [(i, *transform(t or "", i or "", seed, rate, spm_rate))
                        for i, t in zip(b["id"].iloc[at:at + batch], b["text"].iloc[at:at + batch])]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInPandas(run, "id string, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of.

    Texts that hold a marker are plain, and no marker can arise where a piece meets one (each starts with its
    only ``<``), so an output of another form has exactly three.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])))
