"""Text column expressions shared by the text-table operators (U*, B1, K6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters: Unicode letters, digits and underscore (DuckDB/RE2 and Java agree on it).
NON_WORD = r"[^\p{L}\p{N}_]+"

# Python str.splitlines() boundaries.
SPLITLINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def tokenize(text: Column) -> Column:
    """Lower-cased word tokens (empty pieces possible at the ends; callers filter them)."""
    return F.split(F.lower(text), NON_WORD)


def splitlines(text: Column) -> Column:
    """``str.splitlines()``: no trailing empty piece after a final line break."""
    parts = F.split(text, SPLITLINES)
    n = F.size(parts)
    ends_with_break = text.rlike(f"(?:{SPLITLINES})$")
    return (F.when(text.isNull(), F.lit(None))
            .when(text == "", F.array().cast("array<string>"))
            .when(ends_with_break, F.slice(parts, 1, n - 1))
            .otherwise(parts))


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Hash mention in a message: backend (first match, no word boundary) and UI (all, bounded).
HASH_REF_FIRST = r"(?i)(?:commit\s+)?([0-9a-f]{7,40})"
HASH_REF_ALL = r"(?i)\b([0-9a-f]{7,40})\b"

# Code-element question patterns, in the reference's order (case-insensitive, name = group 1).
CODE_ELEMENT_PATTERNS = [
    r"function\s+(\w+)",
    r"class\s+(\w+)",
    r"method\s+(\w+)",
    r"implementation\s+of\s+(\w+)",
    r"how\s+does\s+(\w+)\s+work",
    r"show\s+me\s+(\w+)",
    r"find\s+(\w+)\s+in",
    r"where\s+is\s+(\w+)\s+defined",
    r"what\s+does\s+(\w+)\s+do",
]

# Path after a code fence: ```lang:path or ```lang path (group 2).
CODE_PATH_PATTERN = r"```[\w-]*(?::|(\s+))([^\s\n]+)"

# ---------------------------------------------------------------------------


def hash_ref_first(text: Column) -> Column:
    v = F.regexp_extract(text, HASH_REF_FIRST, 1)
    return F.when(v != "", v)


def hash_refs_all(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HASH_REF_ALL), 1)


# Python's str \w (letters, digits, underscore in any script), spelled so Java and RE2 agree.
WORD_CHAR = r"[\p{L}\p{N}_]"


def unicode_word(pattern: str) -> str:
    return pattern.replace(r"\w", WORD_CHAR)


def code_elements(text: Column) -> Column:
    """Names asked about, pattern order then position, names longer than 2 chars, duplicates kept."""
    parts = [F.regexp_extract_all(text, F.lit("(?i)" + unicode_word(p)), 1) for p in CODE_ELEMENT_PATTERNS]
    return F.filter(F.concat(*parts), lambda s: F.length(s) > 2)


def code_paths(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(unicode_word(CODE_PATH_PATTERN)), 2),
                    lambda s: ~s.contains("```"))
