"""Scalar column expressions (SURVEY P*, F*).

All are built-in Spark expressions: Column in, Column out, no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Extensions treated as binary content (lower-cased extension, with the dot).
BINARY_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".ico", ".bmp", ".tiff", ".webp",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".rar", ".7z",
    ".exe", ".dll", ".so", ".dylib", ".bin",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".flv",
    ".pyc", ".pyo", ".pyd",
    ".jar", ".class",
    ".o", ".a", ".lib",
]

# Lower-cased extension -> primary language.
LANGUAGE_BY_EXTENSION = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript/React",
    ".jsx": "JavaScript/React",
    ".java": "Java",
    ".go": "Go",
    ".rs": "Rust",
    ".c": "C",
    ".cpp": "C++",
    ".h": "C/C++",
    ".rb": "Ruby",
    ".php": "PHP",
    ".cs": "C#",
    ".swift": "Swift",
}

# Root marker files, in priority order, and the language each one implies.
LANGUAGE_MARKERS = [
    (("package.json",), "JavaScript/TypeScript"),
    (("go.mod",), "Go"),
    (("pom.xml",), "Java"),
    (("requirements.txt", "setup.py"), "Python"),
    (("Cargo.toml",), "Rust"),
    (("CMakeLists.txt",), "C/C++"),
    (("Gemfile",), "Ruby"),
]

# Case-sensitive last-dot suffix -> syntax-highlighter id (else "text").
HIGHLIGHT_BY_SUFFIX = {
    "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx",
    "py": "python", "rb": "ruby", "java": "java", "c": "c", "cpp": "cpp",
    "cs": "csharp", "go": "go", "rs": "rust", "php": "php", "html": "html",
    "css": "css", "scss": "scss", "json": "json", "md": "markdown",
    "yml": "yaml", "yaml": "yaml", "xml": "xml", "sh": "bash", "bash": "bash",
}

# "Important file" patterns, matched from the start of the relative path.
IMPORTANT_PATTERNS = [
    r".*\.md$", r".*\.py$", r".*\.java$", r".*\.js$", r".*\.ts$", r".*\.go$",
    r".*\.rs$", r".*\.c$", r".*\.cpp$", r".*\.h$",
    r"package\.json$", r"requirements\.txt$", r"Dockerfile$",
    r"docker-compose\.yml$", r"\.github/workflows/.*\.yml$",
]

# Extensions analysed for complexity (case-sensitive suffix match).
ANALYZABLE_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".cs"]

DOC_SUFFIXES = [".md", ".rst", ".txt"]
TEST_SUFFIXES = ["_test.py", ".test.js", "spec.js", "test_"]

CODE_QUERY_KEYWORDS = ["function", "class", "method", "implementation", "code", "definition"]
COMMIT_QUERY_KEYWORDS = ["commit", "change", "revision", "version", "diff", "hash"]

# ---------------------------------------------------------------------------


def _lit_map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _any_suffix(c: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | c.endswith(s)
    return out


def _any_substring(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


# --- P1..P4 commit fields ---------------------------------------------------

def short_hash(h: Column) -> Column:
    return F.substring(h, 1, 7)


def author_display(name: Column, email: Column) -> Column:
    return F.concat(name, F.lit(" <"), email, F.lit(">"))


def author_name_of(display: Column) -> Column:
    """Text before the first '<' (not trimmed)."""
    return F.split_part(display, F.lit("<"), F.lit(1))


def commit_subject(message: Column) -> Column:
    return F.split_part(message, F.lit("\n"), F.lit(1))


def py_strip(s: Column) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends."""
    return F.regexp_replace(s, r"^[\s\x1c-\x1f\u0085\p{Z}]+|[\s\x1c-\x1f\u0085\p{Z}]+$", "")


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


# --- P5 path pieces ---------------------------------------------------------

def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def path_depth(path: Column) -> Column:
    """Number of directories above the file (0 at the root)."""
    return F.size(F.split(path, "/")) - 1


def file_ext(path: Column) -> Column:
    """``os.path.splitext`` extension of the base name; leading dots are not one."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


# --- P6..P10 lookups -----------------------------------------------------------

def is_binary_path(path: Column) -> Column:
    return F.lower(file_ext(path)).isin(BINARY_EXTENSIONS)


def language_of_ext(ext: Column) -> Column:
    return F.coalesce(_lit_map(LANGUAGE_BY_EXTENSION)[F.lower(ext)], F.lit("Unknown"))


def highlight_language(path: Column) -> Column:
    suffix = F.element_at(F.split(path, r"\."), -1)
    return F.coalesce(_lit_map(HIGHLIGHT_BY_SUFFIX)[suffix], F.lit("text"))


def is_binary_bytes(content: Column, n: int | Column = 8192) -> Column:
    """NUL byte within the first n bytes of a BINARY column."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.instr(F.substring(content, F.lit(1), n).cast("string"), "\x00") > 0


def change_type(status: Column) -> Column:
    return (F.when(status == "A", "added").when(status == "D", "deleted")
            .when(status == "R", "renamed").otherwise("modified"))


# --- P11..P16 parsing --------------------------------------------------------

def parse_name_status(line: Column) -> Column:
    """struct(status, path) split on the first tab; null when the line has no tab."""
    parts = F.split(line, "\t", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("status"), parts[1].alias("path")))


def parse_shortstat(text: Column) -> Column:
    """struct(files_changed, insertions, deletions) from the last line of a stat summary."""
    last = F.element_at(F.split(F.regexp_replace(text, r"\n+$", ""), "\n"), -1)
    ok = last.contains("changed") & (last.contains("insertion") | last.contains("deletion"))

    def num(pat):
        v = F.regexp_extract(last, pat, 1)
        return F.when(ok & (v != ""), v.cast("long")).otherwise(F.lit(0).cast("long"))

    return F.struct(num(r"(\d+) file").alias("files_changed"),
                    num(r"(\d+) insertion").alias("insertions"),
                    num(r"(\d+) deletion").alias("deletions"))


def format_shortstat(files_changed: Column, insertions: Column, deletions: Column) -> Column:
    """git-style summary line, the input form of :func:`parse_shortstat`."""
    return F.concat(
        F.lit(" "), files_changed.cast("string"),
        F.when(files_changed == 1, F.lit(" file changed")).otherwise(F.lit(" files changed")),
        F.when(insertions > 0, F.concat(F.lit(", "), insertions.cast("string"),
                                        F.when(insertions == 1, F.lit(" insertion(+)")).otherwise(F.lit(" insertions(+)"))))
         .otherwise(F.lit("")),
        F.when(deletions > 0, F.concat(F.lit(", "), deletions.cast("string"),
                                       F.when(deletions == 1, F.lit(" deletion(-)")).otherwise(F.lit(" deletions(-)"))))
         .otherwise(F.lit("")),
    )


def repo_url_parts(url: Column) -> Column:
    """struct(owner, repo, repo_name) of a hosted-repository URL."""
    u = F.regexp_replace(url, "/+$", "")
    pat = r"https://github\.com/([^/]+)/([^/]+)/?"
    matched = u.rlike(pat)
    return F.struct(
        F.when(matched, F.regexp_extract(u, pat, 1)).alias("owner"),
        F.when(matched, F.regexp_extract(u, pat, 2)).alias("repo"),
        F.regexp_replace(F.element_at(F.split(u, "/"), -1), r"\.git$", "").alias("repo_name"),
    )


def display_repo_name(name: Column, tool_prefix: str = "") -> Column:
    """Display form of a clone directory name; ``tool_prefix`` is the clone tool's directory prefix."""
    stripped = name
    if tool_prefix:
        stripped = F.when(name.startswith(tool_prefix),
                          F.substring(name, len(tool_prefix) + 1, 1 << 30)).otherwise(name)
    return (F.when(name.isNull() | (name == ""), F.lit("Unknown Repository"))
            .when(stripped.contains("/"), F.element_at(F.split(stripped, "/"), -1))
            .otherwise(F.regexp_replace(stripped, r"\.git$", "")))


def normalize_hash(text: Column, min_len: int = 0) -> Column:
    h = F.regexp_replace(text, "[^0-9a-fA-F]+", "")         # space at the ends goes with it
    return F.when(F.length(h) >= min_len, h) if min_len > 1 else F.nullif(h, F.lit(""))         # one replacement a row


def truncate_text(s: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(suffix))).otherwise(s)


def complexity_band(c: Column) -> Column:
    return F.when(c > 10, "High").when(c > 5, "Medium").otherwise("Low")


def language_by_marker(root_names: Column) -> Column:
    """First language whose marker file is among the root names, else null."""
    out = None
    for names, lang in LANGUAGE_MARKERS:
        cond = F.lit(False)
        for n in names:
            cond = cond | F.array_contains(root_names, n)
        out = F.when(cond, lang) if out is None else out.when(cond, lang)
    return out


# --- F1..F7 predicates -----------------------------------------------------------

def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def is_important(path: Column, root_only: bool = True) -> Column:
    alt = "|".join(f"(?:{p[:-1]})" for p in IMPORTANT_PATTERNS)
    if root_only:
        return path.rlike(f"^(?:{alt})$")
    return path.rlike(f"(^|/)(?:{alt})$")


def is_analyzable(path: Column, content: Column) -> Column:
    return _any_suffix(path, ANALYZABLE_EXTENSIONS) & content.isNotNull() & (F.length(content) > 0)


def is_documentation(path: Column) -> Column:
    low = F.lower(path)
    return _any_suffix(low, DOC_SUFFIXES) | low.contains("doc")


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("test") | _any_suffix(low, TEST_SUFFIXES)


def is_code_query(text: Column) -> Column:
    return _any_substring(F.lower(text), CODE_QUERY_KEYWORDS)


def is_commit_query(text: Column) -> Column:
    return _any_substring(F.lower(text), COMMIT_QUERY_KEYWORDS)


def is_diff_content(text: Column) -> Column:
    return (text.contains("```diff") | text.contains("+++") | text.contains("---")
            | text.rlike(r"(?m)^[+-][^+-]"))
