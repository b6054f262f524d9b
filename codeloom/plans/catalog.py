"""Registered queries: one Spark builder per operator plus its DuckDB oracle.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (through the proxy views).  Doubles are rounded to 6 places on
both sides so the value hashes compare.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import search as K
from codeloom.plans import oracle as O
from codeloom.session import checkpoint_dir, stored
from codeloom.sources import clustered as CL
from codeloom.sources import proxy as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --- K1 flagship: label centroids as questions, top-5 nearest vectors --------------------

K1_SQL = """
WITH pos AS (
  SELECT vec_id, label, CAST(x AS DOUBLE) AS x, i
  FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
cent AS (SELECT label AS query_id, i, avg(x) AS q FROM pos GROUP BY label, i),
qn AS (SELECT query_id, sqrt(sum(q * q)) AS n FROM cent GROUP BY query_id),
en AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM pos GROUP BY vec_id),
d AS (SELECT c.query_id, p.vec_id, sum(c.q * p.x) AS dp FROM cent c JOIN pos p ON c.i = p.i GROUP BY 1, 2),
s AS (SELECT d.query_id, d.vec_id, d.dp / (qn.n * en.n) AS score
      FROM d JOIN qn ON d.query_id = qn.query_id JOIN en ON d.vec_id = en.vec_id WHERE qn.n > 0 AND en.n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS INTEGER) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS key,
       round(score, 6) AS score
FROM r WHERE rank <= 5
"""


@register("k1_search_files", K1_SQL)
def q_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = P.vectors(spark, sf_dir)
    queries = K.centroids(vecs, "label").withColumnRenamed("label", "query_id")
    top = K.cosine_top_k(queries, vecs.select("key", "embedding"), k=5)
    return top.select(F.col("query_id").cast("int"), F.col("rank").cast("int"), F.col("key").cast("long"),
                      F.round("score", 6).alias("score"))


# =====================================================================================
# Shared builders
# =====================================================================================

from codeloom.functions import exprs as X  # noqa: E402
from codeloom.functions import text as TX  # noqa: E402
from codeloom.operators import aggregates as A  # noqa: E402
from codeloom.operators import joins as J  # noqa: E402
from codeloom.operators import snapshot as SN  # noqa: E402
from codeloom.operators import symbols as SY  # noqa: E402
from codeloom.operators import text_tables as TT  # noqa: E402

REPO = "repository_id"
W_ = O.with_


def r6(c):
    return F.round(c, 6)


def _symbols(spark, sf_dir):
    return SY.python_symbols(P.files(spark, sf_dir))


def _file_scores(spark, sf_dir):
    """Per-file complexity (A13) for the debt / hot-spot queries."""
    files = P.files(spark, sf_dir)
    fm = SY.function_metrics(_symbols(spark, sf_dir)).where(F.col("kind") == "function")
    return A.function_summary(files, fm).withColumn("maintainability", F.lit(None).cast("double"))


# Known-answer facts of the proxy Python files (SQL side).
PY_L = "(1 + length(text) - length(replace(text, chr(10), '')))"   # comment lines before the code
PY_K = "CAST(doc_id % 4 AS INTEGER)"
PY_D = "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END"


def py_docs_cte() -> str:
    """Python proxy files with their original document text (for known answers)."""
    return O.files_cte() + """,
pyd AS (
  SELECT f.repository_id, f.path, d.doc_id, d.text, d.n_chars
  FROM files f JOIN documents d ON f.doc_id = d.doc_id
  WHERE f.path LIKE '%.py' AND NOT f.binary)"""


FILE_COMPLEXITY_SQL = f"""
file_cx AS (
  SELECT repository_id, path,
         CASE WHEN path LIKE '%.py' THEN 1.0 + (doc_id % 4) / 2.0 ELSE 0.0 END AS complexity,
         CASE WHEN path LIKE '%.py' THEN 2 ELSE 0 END AS n_functions
  FROM files)"""


# =====================================================================================
# P / F : scalar expressions
# =====================================================================================

@register("p_commit_fields", W_(O.commits_cte()) + r"""
SELECT repository_id, hash, substr(hash, 1, 7) AS short_hash,
       author_name || ' <' || author_email || '>' AS author,
       split_part(author_name || ' <' || author_email || '>', '<', 1) AS author_short,
       split_part(message, chr(10), 1) AS subject,
       regexp_replace(message, '^\s+|\s+$', '', 'g') AS message,
       strftime(author_ts, '%Y-%m-%dT%H:%M:%S') AS date
FROM commits""")
def q_p_commit_fields(spark, sf):
    c = P.commits(spark, sf, with_seq=False)
    disp = X.author_display(F.col("author_name"), F.col("author_email"))
    return c.select(REPO, "hash", X.short_hash(F.col("hash")).alias("short_hash"), disp.alias("author"),
                    X.author_name_of(disp).alias("author_short"), X.commit_subject(F.col("message")).alias("subject"),
                    X.py_strip(F.col("message")).alias("message"), X.iso_date(F.col("author_ts")).alias("date"))


def _lang_case(e):
    return "CASE " + e + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGE_BY_EXTENSION.items()) \
        + " ELSE 'Unknown' END"


def _hl_case(e):
    return "CASE " + e + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.HIGHLIGHT_BY_SUFFIX.items()) \
        + " ELSE 'text' END"


_IMPORTANT_RE = "^(?:" + "|".join(f"(?:{p[:-1]})" for p in X.IMPORTANT_PATTERNS) + ")$"


@register("p_file_paths", W_(O.raw_tree_cte()) + f"""
SELECT repository_id, path, {O.ext_sql('path')} AS ext,
       regexp_extract(path, '[^/]*$', 0) AS basename,
       regexp_extract(path, '^(.*)/[^/]*$', 1) AS dirname,
       CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth,
       lower({O.ext_sql('path')}) IN ({O.BINARY_LIST}) AS is_binary,
       {_lang_case('lower(' + O.ext_sql('path') + ')')} AS language,
       {_hl_case("string_split(path, '.')[-1]")} AS highlight,
       regexp_matches(path, '(^|/)\\.') AS is_hidden,
       regexp_matches(path, '{_IMPORTANT_RE}') AS is_important,
       ({' OR '.join(f"ends_with(path, '{e}')" for e in X.ANALYZABLE_EXTENSIONS)}) AND length(text) > 0 AS is_analyzable,
       ({' OR '.join(f"ends_with(lower(path), '{e}')" for e in X.DOC_SUFFIXES)}) OR contains(lower(path), 'doc')
         AS is_documentation,
       contains(lower(path), 'test') OR ({' OR '.join(f"ends_with(lower(path), '{e}')" for e in X.TEST_SUFFIXES)})
         AS is_test
FROM raw_tree""")
def q_p_file_paths(spark, sf):
    t = P.raw_tree(spark, sf)
    p = F.col("path")
    return t.select(REPO, "path", X.file_ext(p).alias("ext"), X.basename(p).alias("basename"),
                    X.dirname(p).alias("dirname"), X.path_depth(p).cast("int").alias("depth"),
                    X.is_binary_path(p).alias("is_binary"), X.language_of_ext(X.file_ext(p)).alias("language"),
                    X.highlight_language(p).alias("highlight"), X.is_hidden(p).alias("is_hidden"),
                    X.is_important(p).alias("is_important"), X.is_analyzable(p, F.col("text")).alias("is_analyzable"),
                    X.is_documentation(p).alias("is_documentation"), X.is_test(p).alias("is_test"))


@register("p10_file_changes", W_(O.file_changes_cte()) + "SELECT * FROM file_changes")
def q_p10(spark, sf):
    return P.file_changes(spark, sf)


_STATS_SQL = W_(O.commits_cte(), O.file_changes_cte()) + """,
per AS (SELECT repository_id, hash, count(*) AS n, sum(insertions) AS ins, sum(deletions) AS dels
        FROM file_changes GROUP BY 1, 2),
stats AS (
  SELECT c.*, CAST(coalesce(n, 0) AS BIGINT) AS files_changed, CAST(coalesce(ins, 0) AS BIGINT) AS insertions,
         CAST(coalesce(dels, 0) AS BIGINT) AS deletions
  FROM commits c LEFT JOIN per p ON c.repository_id = p.repository_id AND c.hash = p.hash)
"""


@register("p12_shortstat", _STATS_SQL + r""",
t AS (SELECT repository_id, hash, ' ' || CAST(files_changed AS VARCHAR)
        || CASE WHEN files_changed = 1 THEN ' file changed' ELSE ' files changed' END
        || CASE WHEN insertions > 0 THEN ', ' || CAST(insertions AS VARCHAR)
                || CASE WHEN insertions = 1 THEN ' insertion(+)' ELSE ' insertions(+)' END ELSE '' END
        || CASE WHEN deletions > 0 THEN ', ' || CAST(deletions AS VARCHAR)
                || CASE WHEN deletions = 1 THEN ' deletion(-)' ELSE ' deletions(-)' END ELSE '' END AS stat
      FROM stats),
g AS (SELECT *, contains(stat, 'changed') AND (contains(stat, 'insertion') OR contains(stat, 'deletion')) AS ok FROM t)
SELECT repository_id, hash, stat,
  CASE WHEN ok AND regexp_extract(stat, '(\d+) file', 1) <> '' THEN CAST(regexp_extract(stat, '(\d+) file', 1) AS BIGINT) ELSE 0 END AS files_changed,
  CASE WHEN ok AND regexp_extract(stat, '(\d+) insertion', 1) <> '' THEN CAST(regexp_extract(stat, '(\d+) insertion', 1) AS BIGINT) ELSE 0 END AS insertions,
  CASE WHEN ok AND regexp_extract(stat, '(\d+) deletion', 1) <> '' THEN CAST(regexp_extract(stat, '(\d+) deletion', 1) AS BIGINT) ELSE 0 END AS deletions
FROM g""")
def q_p12(spark, sf):
    s = A.commit_stats(P.commits(spark, sf, with_seq=False), P.file_changes(spark, sf))
    t = s.select(REPO, "hash", X.format_shortstat(F.col("files_changed"), F.col("insertions"),
                                                  F.col("deletions")).alias("stat"))
    return t.select(REPO, "hash", "stat", X.parse_shortstat(F.col("stat")).alias("p")).select(
        REPO, "hash", "stat", "p.files_changed", "p.insertions", "p.deletions")


@register("p13_repo_url", r"""
WITH u AS (SELECT page_id, url, regexp_replace(url, '/+$', '') AS u FROM pages)
SELECT page_id,
  CASE WHEN regexp_matches(u, 'https://github\.com/([^/]+)/([^/]+)/?') THEN regexp_extract(u, 'https://github\.com/([^/]+)/([^/]+)/?', 1) END AS owner,
  CASE WHEN regexp_matches(u, 'https://github\.com/([^/]+)/([^/]+)/?') THEN regexp_extract(u, 'https://github\.com/([^/]+)/([^/]+)/?', 2) END AS repo,
  regexp_replace(string_split(u, '/')[-1], '\.git$', '') AS repo_name,
  CASE WHEN url IS NULL OR url = '' THEN 'Unknown Repository'
       WHEN contains(url, '/') THEN string_split(url, '/')[-1]
       ELSE regexp_replace(url, '\.git$', '') END AS display_name
FROM u""")
def q_p13(spark, sf):
    pg = P.table(spark, sf, "pages").select("page_id", "url")
    parts = X.repo_url_parts(F.col("url"))
    return pg.select("page_id", parts["owner"].alias("owner"), parts["repo"].alias("repo"),
                     parts["repo_name"].alias("repo_name"), X.display_repo_name(F.col("url")).alias("display_name"))


@register("p16_truncate", r"""
SELECT doc_id,
  CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS t2000,
  CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || '...[truncated]' ELSE text END AS t5000,
  CAST(length(text) AS INTEGER) AS n
FROM documents""")
def q_p16(spark, sf):
    d = P.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", X.truncate_text(F.col("text"), 2000).alias("t2000"),
                    X.truncate_text(F.col("text"), 5000, "...[truncated]").alias("t5000"),
                    F.length("text").alias("n"))


_DIFF_LIKE = ("(contains(content, '```diff') OR contains(content, '+++') OR contains(content, '---') "
              "OR regexp_matches(content, '(?m)^[+-][^+-]'))")


@register("f6_query_flags", W_(O.messages_cte()) + f"""
SELECT session_id, turn,
  ({' OR '.join(f"contains(lower(content), '{k}')" for k in X.CODE_QUERY_KEYWORDS)}) AS is_code_query,
  ({' OR '.join(f"contains(lower(content), '{k}')" for k in X.COMMIT_QUERY_KEYWORDS)}) AS is_commit_query,
  {_DIFF_LIKE} AS is_diff_content
FROM messages""")
def q_f6(spark, sf):
    m = P.messages(spark, sf)
    c = F.col("content")
    return m.select("session_id", "turn", X.is_code_query(c).alias("is_code_query"),
                    X.is_commit_query(c).alias("is_commit_query"), X.is_diff_content(c).alias("is_diff_content"))


@register("f8_user_sessions", W_(O.messages_cte()) + """
SELECT session_id, CAST(max(turn) AS BIGINT) AS last_turn, CAST(count(*) AS BIGINT) AS n_messages
FROM messages GROUP BY session_id HAVING arg_max(role, turn) = 'user'""")
def q_f8(spark, sf):
    return A.user_sessions(P.messages(spark, sf)).select(
        "session_id", F.col("last_turn").cast("long"), F.col("n_messages").cast("long"))


# =====================================================================================
# A : aggregations
# =====================================================================================

_EXT_COUNTS = f"""
ext_counts AS (
  SELECT repository_id, lower({O.ext_sql('path')}) AS ext, CAST(count(*) AS BIGINT) AS n_files
  FROM files WHERE {O.ext_sql('path')} <> '' GROUP BY 1, 2)"""


@register("a2_extension_histogram", W_(O.files_cte(), _EXT_COUNTS) + "SELECT * FROM ext_counts")
def q_a2(spark, sf):
    return A.extension_histogram(P.files(spark, sf)).select(REPO, "ext", F.col("n_files").cast("long"))


def _marker_sql():
    arms = " ".join(f"WHEN path IN ({', '.join(O.sql_str(n) for n in names)}) THEN {i}"
                    for i, (names, _l) in enumerate(X.LANGUAGE_MARKERS))
    langs = " ".join(f"WHEN {i} THEN '{lang}'" for i, (_n, lang) in enumerate(X.LANGUAGE_MARKERS))
    return arms, langs


@register("a1_detect_language", W_(O.files_cte(), _EXT_COUNTS) + f""",
mk AS (SELECT repository_id, min(CASE {_marker_sql()[0]} END) AS marker FROM files GROUP BY 1),
top AS (SELECT repository_id, ext AS top_ext FROM (
          SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY n_files DESC, ext) AS rn FROM ext_counts)
        WHERE rn = 1)
SELECT mk.repository_id,
       coalesce(CASE marker {_marker_sql()[1]} END, {_lang_case("coalesce(top_ext, '')")}) AS language, top_ext
FROM mk LEFT JOIN top ON mk.repository_id = top.repository_id""")
def q_a1(spark, sf):
    return A.detect_language(P.files(spark, sf))


@register("a3_directory_rollup", W_(O.files_cte()) + """,
parts AS (SELECT repository_id, size, string_split(path, '/') AS p,
                 CASE WHEN content IS NULL THEN 0
                      ELSE length(content) - length(replace(content, chr(10), ''))
                           + CASE WHEN length(content) > 0 AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END
                 END AS lines
          FROM files),
anc AS (SELECT repository_id, size, lines, array_to_string(list_slice(p, 1, i), '/') AS directory
        FROM parts, range(0, len(p)) AS r(i))
SELECT repository_id, directory, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size) AS BIGINT) AS bytes,
       CAST(sum(lines) AS BIGINT) AS lines
FROM anc GROUP BY 1, 2""")
def q_a3(spark, sf):
    return A.directory_rollup(P.files(spark, sf)).select(REPO, "directory", F.col("n_files").cast("long"),
                                                         "bytes", "lines")


@register("a4_commit_stats", _STATS_SQL + """
SELECT repository_id, hash, seq, files_changed, insertions, deletions FROM stats""")
def q_a4(spark, sf):
    return A.commit_stats(P.commits(spark, sf), P.file_changes(spark, sf)).select(
        REPO, "hash", "seq", "files_changed", "insertions", "deletions")


@register("a6_repository_metrics", W_(O.files_cte(), O.commits_cte()) + """,
f AS (SELECT repository_id, CAST(count(*) AS BIGINT) AS total_files,
             CAST(sum(CASE WHEN content IS NULL THEN 0
                      ELSE length(content) - length(replace(content, chr(10), ''))
                           + CASE WHEN length(content) > 0 AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END
                 END) AS BIGINT) AS total_lines
      FROM files GROUP BY 1),
c AS (SELECT repository_id, CAST(count(DISTINCT author_email) AS BIGINT) AS contributor_count,
             count(*) / greatest(1, date_diff('day', min(author_ts), max(author_ts)) + 1) AS commit_frequency
      FROM commits GROUP BY 1)
SELECT coalesce(f.repository_id, c.repository_id) AS repository_id, total_files, total_lines, contributor_count,
       round(commit_frequency, 6) AS commit_frequency
FROM f FULL OUTER JOIN c ON f.repository_id = c.repository_id""")
def q_a6(spark, sf):
    m = A.repository_metrics(P.files(spark, sf), P.commits(spark, sf, with_seq=False))
    return m.select(REPO, "total_files", "total_lines", "contributor_count", r6(F.col("commit_frequency")).alias("commit_frequency"))


_DEBT_SQL = W_(O.files_cte(), FILE_COMPLEXITY_SQL) + f""",
counts AS (
  SELECT repository_id, count(*) AS n_files,
         count(*) FILTER (WHERE ({' OR '.join(f"ends_with(lower(path), '{e}')" for e in X.DOC_SUFFIXES)})
                                OR contains(lower(path), 'doc')) AS n_doc,
         count(*) FILTER (WHERE contains(lower(path), 'test')
                                OR ({' OR '.join(f"ends_with(lower(path), '{e}')" for e in X.TEST_SUFFIXES)})) AS n_test
  FROM files GROUP BY 1),
analysed AS (
  SELECT f.repository_id, f.path, x.complexity FROM files f JOIN file_cx x USING (repository_id, path)
  WHERE ({' OR '.join(f"ends_with(f.path, '{e}')" for e in X.ANALYZABLE_EXTENSIONS)})
    AND f.content IS NOT NULL AND length(f.content) > 0),
cx AS (SELECT repository_id, avg(complexity) AS avg_c, count(*) AS n_analysed FROM analysed GROUP BY 1),
debt AS (
  SELECT c.repository_id, CAST(n_files AS BIGINT) AS n_files, CAST(coalesce(n_analysed, 0) AS BIGINT) AS n_analysed,
         coalesce(avg_c, 0.0) AS avg_complexity,
         least(100.0, coalesce(avg_c, 0.0) * 10) AS code_complexity,
         greatest(0.0, 100 - n_doc / n_files * 500) AS documentation,
         greatest(0.0, 100 - n_test / n_files * 500) AS test_coverage
  FROM counts c LEFT JOIN cx ON c.repository_id = cx.repository_id)
"""


@register("a7_technical_debt", _DEBT_SQL + """
SELECT repository_id, n_files, n_analysed, round(avg_complexity, 6) AS avg_complexity,
       round(code_complexity, 6) AS code_complexity, round(documentation, 6) AS documentation,
       round(test_coverage, 6) AS test_coverage,
       round(code_complexity * 0.4 + documentation * 0.3 + test_coverage * 0.3, 6) AS score
FROM debt""")
def q_a7(spark, sf):
    debt, _top = A.technical_debt(P.files(spark, sf), _file_scores(spark, sf))
    return debt.select(REPO, "n_files", "n_analysed", *[r6(F.col(c)).alias(c) for c in
                       ("avg_complexity", "code_complexity", "documentation", "test_coverage", "score")])


@register("a8_top_files", _DEBT_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY complexity DESC, path) AS rank FROM analysed)
SELECT repository_id, CAST(rank AS INTEGER) AS rank, path, round(complexity, 6) AS complexity FROM r WHERE rank <= 10""")
def q_a8(spark, sf):
    _debt, top = A.technical_debt(P.files(spark, sf), _file_scores(spark, sf))
    return top.select(REPO, F.col("rank").cast("int"), "path", r6(F.col("complexity")).alias("complexity"))


_A6_PARTS = """
f6 AS (SELECT repository_id, CAST(count(*) AS BIGINT) AS total_files FROM files GROUP BY 1),
c6 AS (SELECT repository_id, CAST(count(DISTINCT author_email) AS BIGINT) AS contributor_count FROM commits GROUP BY 1)"""


@register("a6_metrics_with_debt", _DEBT_SQL + ",\n" + O.commits_cte() + "," + _A6_PARTS + """
SELECT coalesce(f6.repository_id, c6.repository_id) AS repository_id, total_files, contributor_count,
       round(avg_complexity, 6) AS avg_complexity,
       round(code_complexity * 0.4 + documentation * 0.3 + test_coverage * 0.3, 6) AS technical_debt_score
FROM f6 FULL OUTER JOIN c6 ON f6.repository_id = c6.repository_id
LEFT JOIN debt ON debt.repository_id = coalesce(f6.repository_id, c6.repository_id)""")
def q_a6_debt(spark, sf):
    files = P.files(spark, sf)
    debt, _top = A.technical_debt(files, _file_scores(spark, sf))
    m = A.repository_metrics(files, P.commits(spark, sf, with_seq=False), debt=debt)
    return m.select(REPO, "total_files", "contributor_count", *[r6(F.col(c)).alias(c) for c in ("avg_complexity", "technical_debt_score")])


@register("a11_contributor_sketches", W_(O.commits_cte()) + """
SELECT repository_id, CAST(date_trunc('month', author_ts) AS DATE) AS period, CAST(count(*) AS BIGINT) AS n_commits,
       CAST(count(DISTINCT author_email) AS BIGINT) AS contributors, TRUE AS sketch_close
FROM commits GROUP BY 1, 2""")
def q_a11_sketches(spark, sf):
    c = P.commits(spark, sf, with_seq=False)
    exact = c.groupBy(REPO, F.date_trunc("month", "author_ts").cast("date").alias("period")).agg(
        F.count("*").alias("n_commits"), F.countDistinct("author_email").alias("contributors"))
    merged = A.activity_between(A.activity_sketches(c), "month").select(REPO, "period", F.col("contributors").alias("est"))
    close = F.abs(F.col("est") - F.col("contributors")) <= 1 + 0.08 * F.col("contributors")       # five standard errors
    return exact.join(merged, [REPO, "period"]).select(REPO, "period", "n_commits", "contributors", close.alias("sketch_close"))


@register("a9_conversation_history", W_(O.messages_cte()) + """
SELECT m.session_id, m.turn, m.role, m.content FROM messages m
JOIN (SELECT session_id, max(turn) AS last FROM messages GROUP BY 1) l ON m.session_id = l.session_id
WHERE m.turn < l.last""")
def q_a9(spark, sf):
    return A.conversation_history(P.messages(spark, sf))


@register("a10_user_text", W_(O.messages_cte()) + """
SELECT session_id, string_agg(content || chr(10), '' ORDER BY turn) AS user_text, arg_max(content, turn) AS query
FROM messages WHERE role = 'user' GROUP BY session_id""")
def q_a10(spark, sf):
    return A.user_text_concat(P.messages(spark, sf))


@register("a11_author_activity", W_(O.commits_cte(), O.file_changes_cte()) + """,
c AS (SELECT repository_id, author_email, CAST(count(*) AS BIGINT) AS n_commits, min(author_ts) AS first_ts,
             max(author_ts) AS last_ts FROM commits GROUP BY 1, 2),
t AS (SELECT c.repository_id, c.author_email, CAST(count(DISTINCT f.path) AS BIGINT) AS files_touched
      FROM file_changes f JOIN commits c ON f.repository_id = c.repository_id AND f.hash = c.hash GROUP BY 1, 2)
SELECT c.repository_id, c.author_email, n_commits, first_ts, last_ts, CAST(coalesce(files_touched, 0) AS BIGINT) AS files_touched
FROM c LEFT JOIN t ON c.repository_id = t.repository_id AND c.author_email = t.author_email""")
def q_a11(spark, sf):
    return A.author_activity(P.commits(spark, sf, with_seq=False), P.file_changes(spark, sf))


@register("a12_file_churn", W_(O.file_changes_cte()) + """
SELECT repository_id, path, CAST(count(*) AS BIGINT) AS n_changes, CAST(sum(insertions) AS BIGINT) AS insertions,
       CAST(sum(deletions) AS BIGINT) AS deletions, CAST(count(DISTINCT hash) AS BIGINT) AS n_commits
FROM file_changes GROUP BY 1, 2""")
def q_a12(spark, sf):
    return A.file_churn(P.file_changes(spark, sf))


@register("a13_function_summary", W_(O.files_cte(), FILE_COMPLEXITY_SQL) + """
SELECT repository_id, path, round(complexity, 6) AS complexity, CAST(n_functions AS BIGINT) AS n_functions FROM file_cx""")
def q_a13(spark, sf):
    files = P.files(spark, sf)
    fm = SY.function_metrics(_symbols(spark, sf)).where(F.col("kind") == "function")
    s = A.function_summary(files, fm)
    return s.select(REPO, "path", r6(F.col("complexity")).alias("complexity"), "n_functions")


# =====================================================================================
# J / W / X : joins, windows, snapshots
# =====================================================================================

@register("j1_commit_changes", W_(O.commits_cte(), O.file_changes_cte()) + """
SELECT c.repository_id, c.hash, CAST(count(f.path) AS BIGINT) AS n_changes,
       coalesce(string_agg(f.path, ',' ORDER BY f.path, f.change_type, f.insertions, f.deletions), '') AS paths
FROM commits c LEFT JOIN file_changes f ON c.repository_id = f.repository_id AND c.hash = f.hash
GROUP BY 1, 2""")
def q_j1(spark, sf):
    j = J.commits_with_changes(P.commits(spark, sf, with_seq=False), P.file_changes(spark, sf))
    return j.select(REPO, "hash", "n_changes",
                    F.array_join(F.transform("file_changes", lambda s: s["path"]), ",").alias("paths"))


# The same answers from bucketed tables, written from the whole proxy tables into the shared folder

def _clustered(spark, tables):
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    return CL.write_clustered(tables, folder, f"corpus_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))


@register("s5_clustered_stats", ORACLES["a4_commit_stats"])
def q_s5_stats(spark, sf):
    t = _clustered(spark, {"commits": P.commits(spark, sf), "changes": P.file_changes(spark, sf)})
    return A.commit_stats(t["commits"], t["changes"]).select(REPO, "hash", "seq", "files_changed", "insertions", "deletions")


@register("s5_clustered_changes", ORACLES["j1_commit_changes"])
def q_s5_changes(spark, sf):
    t = _clustered(spark, {"commits": P.commits(spark, sf, with_seq=False), "changes": P.file_changes(spark, sf)})
    return J.commits_with_changes(t["commits"], t["changes"]).select(
        REPO, "hash", "n_changes", F.array_join(F.transform("file_changes", lambda s: s["path"]), ",").alias("paths"))


@register("s5_clustered_churn", ORACLES["a12_file_churn"])
def q_s5_churn(spark, sf):
    return A.file_churn(_clustered(spark, {"changes": P.file_changes(spark, sf)})["changes_by_path"])


def _refs(spark, sf):
    """Hash references as users type them: 4..10-char prefixes of order hashes, mixed case, some with '#'."""
    li = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    pref = F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, F.col("l_linenumber") + 3)
    ref = (F.when(F.col("l_linenumber") % 2 == 0, F.upper(pref))
           .when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("#"), pref)).otherwise(pref))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ref_id"), ref.alias("ref"))


_REFS_SQL = """
refs AS (
  SELECT l_orderkey * 8 + l_linenumber AS ref_id,
         CASE WHEN l_linenumber % 2 = 0 THEN upper(substr(md5(CAST(l_orderkey AS VARCHAR)), 1, l_linenumber + 3))
              WHEN l_linenumber % 3 = 0 THEN '#' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, l_linenumber + 3)
              ELSE substr(md5(CAST(l_orderkey AS VARCHAR)), 1, l_linenumber + 3) END AS ref
  FROM lineitem)"""


@register("j2_resolve_hashes", W_(O.commits_cte(), _REFS_SQL) + r""",
n AS (SELECT ref_id, ref, CASE WHEN length(regexp_replace(trim(ref), '[^0-9a-fA-F]', '', 'g')) >= 1
                              THEN lower(regexp_replace(trim(ref), '[^0-9a-fA-F]', '', 'g')) END AS normalized FROM refs),
m AS (SELECT u.normalized, c.hash, c.seq,
             row_number() OVER (PARTITION BY u.normalized ORDER BY c.seq, c.hash) AS rn,
             count(*) OVER (PARTITION BY u.normalized) AS cnt
      FROM (SELECT DISTINCT normalized FROM n WHERE normalized IS NOT NULL) u
      JOIN commits c ON substr(lower(c.hash), 1, 1) = substr(u.normalized, 1, 1)
                    AND starts_with(lower(c.hash), u.normalized))
SELECT n.ref_id, n.ref, n.normalized, m.hash, m.seq, CAST(coalesce(m.cnt, 0) AS BIGINT) AS match_count
FROM n LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON n.normalized = m.normalized""")
def q_j2(spark, sf):
    return J.resolve_hashes(_refs(spark, sf), P.commits(spark, sf))


@register("j3_file_lookup", W_(O.files_cte()) + f"""
SELECT l.doc_id AS request_id, 'src' || CAST(l.doc_id % 20 AS VARCHAR) AS repository_id, r.path,
       CASE WHEN f.binary IS NULL THEN 'not_found' WHEN f.binary THEN 'binary' ELSE 'ok' END AS status,
       md5(CASE WHEN NOT f.binary THEN f.content END) AS content_md5
FROM labels l
CROSS JOIN LATERAL (SELECT CASE WHEN l.quality = 0 THEN {O.doc_path_sql('l.doc_id')} || '.bak'
                                ELSE {O.doc_path_sql('l.doc_id')} END AS path) r
LEFT JOIN files f ON f.repository_id = 'src' || CAST(l.doc_id % 20 AS VARCHAR) AND f.path = r.path""")
def q_j3(spark, sf):
    lab = P.table(spark, sf, "labels").select("doc_id", "quality")
    p = P.doc_path(F.col("doc_id"))
    req = lab.select(F.col("doc_id").alias("request_id"),
                     F.concat(F.lit("src"), (F.col("doc_id") % P.N_REPOS).cast("string")).alias(REPO),
                     F.when(F.col("quality") == 0, F.concat(p, F.lit(".bak"))).otherwise(p).alias("path"))
    out = J.lookup_files(req, P.files(spark, sf))
    return out.select("request_id", REPO, "path", "status", F.md5("content").alias("content_md5"))


@register("j4_content_at", f"""
WITH ver AS (SELECT {O.doc_path_sql('l_partkey')} AS path, l_orderkey * 8 + l_linenumber AS ordinal,
                    l_returnflag = 'R' AS deleted,
                    'rev ' || CAST(l_orderkey AS VARCHAR) || ' line ' || CAST(l_linenumber AS VARCHAR) AS content
             FROM lineitem),
req AS (SELECT l_orderkey * 8 + l_linenumber AS request_id, {O.doc_path_sql('l_suppkey')} AS path,
               l_orderkey * 8 + l_linenumber AS ordinal FROM lineitem),
a AS (SELECT req.request_id, req.path, req.ordinal, ver.ordinal AS v_ordinal, ver.deleted, ver.content
      FROM req ASOF LEFT JOIN ver ON req.path = ver.path AND req.ordinal >= ver.ordinal)
SELECT request_id, path, ordinal,
       CASE WHEN v_ordinal IS NOT NULL AND NOT deleted THEN v_ordinal END AS version_ordinal,
       CASE WHEN v_ordinal IS NOT NULL AND NOT deleted THEN content END AS content,
       CASE WHEN v_ordinal IS NOT NULL AND NOT deleted THEN 'ok' ELSE 'not found in commit' END AS status
FROM a""")
def q_j4(spark, sf):
    li = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    ordinal = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    ver = li.select(F.lit("r").alias(REPO), P.doc_path(F.col("l_partkey")).alias("path"), ordinal.alias("ordinal"),
                    (F.col("l_returnflag") == "R").alias("deleted"),
                    F.concat(F.lit("rev "), F.col("l_orderkey").cast("string"), F.lit(" line "),
                             F.col("l_linenumber").cast("string")).alias("content"))
    req = li.select(ordinal.alias("request_id"), F.lit("r").alias(REPO), P.doc_path(F.col("l_suppkey")).alias("path"),
                    ordinal.alias("ordinal"))
    out = J.content_at(req, ver)
    return out.select("request_id", "path", "ordinal", "version_ordinal", "content", "status")


_DOC_REFS_ALL = r"""
mentions AS (
  SELECT DISTINCT doc_id, r AS ref FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b([0-9a-f]{7,40})\b', 1)) AS r FROM documents
    WHERE NOT (contains(text, '```diff') OR contains(text, '+++') OR contains(text, '---')
               OR regexp_matches(text, '(?m)^[+-][^+-]'))))"""


@register("j5_unknown_hashes", W_(O.commits_cte(), _DOC_REFS_ALL) + """
SELECT doc_id, ref FROM mentions m
WHERE lower(ref) NOT IN (SELECT lower(hash) FROM commits)
  AND lower(ref) NOT IN (SELECT lower(substr(hash, 1, 7)) FROM commits)""")
def q_j5(spark, sf):
    d = P.table(spark, sf, "documents").select("doc_id", "text")
    mentions = TT.extract_hash_refs(d, "text", ["doc_id"], mode="all").select("doc_id", "ref").distinct()
    return J.unknown_hashes(mentions, P.commits(spark, sf, with_seq=False))


@register("u11_hash_refs_first", r"""
SELECT doc_id, regexp_extract(text, '(?i)(?:commit\s+)?([0-9a-f]{7,40})', 1) AS ref,
       lower(regexp_replace(trim(regexp_extract(text, '(?i)(?:commit\s+)?([0-9a-f]{7,40})', 1)), '[^0-9a-fA-F]', '', 'g'))
         AS normalized
FROM documents WHERE regexp_extract(text, '(?i)(?:commit\s+)?([0-9a-f]{7,40})', 1) <> ''""")
def q_u11(spark, sf):
    d = P.table(spark, sf, "documents").select("doc_id", "text")
    r = TT.extract_hash_refs(d, "text", ["doc_id"], mode="first")
    return r.select("doc_id", "ref", F.lower(X.normalize_hash(F.col("ref"))).alias("normalized"))


@register("u11_hash_refs_all", W_(_DOC_REFS_ALL) + "SELECT doc_id, ref FROM mentions")
def q_u11_all(spark, sf):
    d = P.table(spark, sf, "documents").select("doc_id", "text")
    return TT.extract_hash_refs(d, "text", ["doc_id"], mode="all").select("doc_id", "ref").distinct()


@register("j8_commit_upsert", _STATS_SQL + """
SELECT repository_id, hash, message, files_changed, insertions, deletions FROM stats""")
def q_j8(spark, sf):
    c = P.commits(spark, sf, with_seq=False)
    basic = c.select(REPO, "hash", "message", F.lit(0).cast("long").alias("files_changed"),
                     F.lit(0).cast("long").alias("insertions"), F.lit(0).cast("long").alias("deletions"))
    ch = P.file_changes(spark, sf)
    detailed = ch.groupBy(REPO, "hash").agg(F.count("*").cast("long").alias("files_changed"),
                                            F.sum("insertions").cast("long").alias("insertions"),
                                            F.sum("deletions").cast("long").alias("deletions"))
    return J.upsert_commits(basic, detailed)


@register("w1_recent_commits", W_(O.commits_cte()) + "SELECT repository_id, hash, seq FROM commits WHERE seq < 50")
def q_w1(spark, sf):
    return J.recent_commits(P.commits(spark, sf), 50).select(REPO, "hash", "seq")


@register("w2_cap_changes", W_(O.file_changes_cte()) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY repository_id, hash ORDER BY path, change_type, insertions, deletions)
             AS file_no, count(*) OVER (PARTITION BY repository_id, hash) AS total_files FROM file_changes)
SELECT repository_id, hash, path, change_type, insertions, deletions, CAST(file_no AS INTEGER) AS file_no,
       CAST(least(total_files, 200) AS BIGINT) AS files_changed,
       CASE WHEN total_files > 200 THEN 'Display limited to 200 files' END AS note
FROM r WHERE file_no <= 200""")
def q_w2(spark, sf):
    ch = P.file_changes(spark, sf)
    w = J.cap_changes(ch, 200)
    return w.select(REPO, "hash", "path", "change_type", "insertions", "deletions", F.col("file_no").cast("int"),
                    F.col("files_changed").cast("long"), "note")


@register("w6_commit_cadence", W_(O.commits_cte()) + """
SELECT repository_id, hash, author_ts,
       lag(author_ts) OVER (PARTITION BY repository_id ORDER BY author_ts, hash) AS prev_ts,
       CAST(epoch(author_ts) - epoch(lag(author_ts) OVER (PARTITION BY repository_id ORDER BY author_ts, hash)) AS BIGINT)
         AS gap_seconds
FROM commits""")
def q_w6(spark, sf):
    return J.commit_cadence(P.commits(spark, sf, with_seq=False)).select(REPO, "hash", "author_ts", "prev_ts", "gap_seconds")


@register("w7_file_sample", W_(O.files_cte()) + """
SELECT repository_id, path FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY md5(path || '0'), path) AS rn FROM files
  WHERE content IS NOT NULL AND length(content) > 0 AND (""" + " OR ".join(
    f"ends_with(path, '{e}')" for e in X.ANALYZABLE_EXTENSIONS) + """))
WHERE rn <= 20""")
def q_w7(spark, sf):
    files = P.files(spark, sf)
    return A.sample_files(files.where(X.is_analyzable(F.col("path"), F.col("content"))), cap=20).select(REPO, "path")


_SNAP_SQL = W_(O.files_cte(), O.snapshots_cte()) + """,
o AS (SELECT repository_id, path, coalesce(sha256(content), 'none:') AS d FROM old_snap),
n AS (SELECT repository_id, path, coalesce(sha256(content), 'none:') AS d FROM new_snap),
j AS (SELECT coalesce(o.repository_id, n.repository_id) AS repository_id, coalesce(o.path, n.path) AS path,
             o.d AS d_old, n.d AS d_new
      FROM o FULL OUTER JOIN n ON o.repository_id = n.repository_id AND o.path = n.path),
gone AS (SELECT repository_id, path, d_old AS digest,
                row_number() OVER (PARTITION BY repository_id, d_old ORDER BY path) AS pair FROM j WHERE d_new IS NULL),
came AS (SELECT repository_id, path, d_new AS digest,
                row_number() OVER (PARTITION BY repository_id, d_new ORDER BY path) AS pair FROM j WHERE d_old IS NULL),
pairs AS (SELECT g.repository_id, g.path AS old_path, c.path AS new_path
          FROM gone g JOIN came c ON g.repository_id = c.repository_id AND g.digest = c.digest AND g.pair = c.pair
          WHERE g.digest <> 'none:')
"""


@register("x1_snapshot_diff", _SNAP_SQL + """
SELECT repository_id, path, CAST(NULL AS VARCHAR) AS old_path,
       CASE WHEN d_old = d_new THEN 'unchanged' ELSE 'modified' END AS status
FROM j WHERE d_old IS NOT NULL AND d_new IS NOT NULL
UNION ALL SELECT repository_id, new_path, old_path, 'renamed' FROM pairs
UNION ALL SELECT repository_id, path, NULL, 'added' FROM came c
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.repository_id = c.repository_id AND p.new_path = c.path)
UNION ALL SELECT repository_id, path, NULL, 'deleted' FROM gone g
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.repository_id = g.repository_id AND p.old_path = g.path)""")
def q_x1(spark, sf):
    old, new = P.snapshots(spark, sf)
    return SN.snapshot_diff(old, new)


def _sql_lines(src: str, content: str = "content") -> str:
    """splitlines() of a text that only uses '\\n' breaks, as (… , pos, line) rows."""
    return f"""(SELECT *, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM (
      SELECT *, CASE WHEN {content} = '' THEN []::VARCHAR[]
                     WHEN ends_with({content}, chr(10)) THEN list_slice(string_split({content}, chr(10)), 1,
                                                                   len(string_split({content}, chr(10))) - 1)
                     ELSE string_split({content}, chr(10)) END AS parts
      FROM {src}))"""


@register("x3_line_delta", W_(O.files_cte(), O.snapshots_cte()) + f""",
u AS (SELECT repository_id, path, line, -1 AS s FROM {_sql_lines("(SELECT repository_id, path, coalesce(content, '') AS content FROM old_snap)")}
      UNION ALL
      SELECT repository_id, path, line, 1 AS s FROM {_sql_lines("(SELECT repository_id, path, coalesce(content, '') AS content FROM new_snap)")}),
per AS (SELECT repository_id, path, line, sum(s) AS d FROM u GROUP BY 1, 2, 3)
SELECT repository_id, path, CAST(sum(greatest(d, 0)) AS BIGINT) AS insertions,
       CAST(sum(greatest(-d, 0)) AS BIGINT) AS deletions
FROM per GROUP BY 1, 2""")
def q_x3(spark, sf):
    old, new = P.snapshots(spark, sf)
    return SN.line_delta(old, new)


# =====================================================================================
# U : text and code tables
# =====================================================================================

@register("u1_explode_lines", W_(O.files_cte()) + f"""
SELECT repository_id, path, CAST(pos AS INTEGER) AS line_no, line
FROM {_sql_lines("(SELECT * FROM files WHERE content IS NOT NULL)")}""")
def q_u1(spark, sf):
    return TT.explode_lines(P.files(spark, sf).where(F.col("content").isNotNull()))


@register("u6_raw_metrics", W_(O.files_cte()) + f""",
l AS (SELECT repository_id, path, regexp_replace(line, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS s FROM {_sql_lines("(SELECT * FROM files WHERE content IS NOT NULL)")}),
c AS (SELECT repository_id, path, s, starts_with(s, '#') OR starts_with(s, '//') OR starts_with(s, '/*')
             OR starts_with(s, '*') AS is_comment FROM l),
per AS (SELECT repository_id, path, count(*) FILTER (WHERE s <> '' AND NOT is_comment) AS sloc,
               count(*) FILTER (WHERE is_comment) AS comments, count(*) FILTER (WHERE s = '') AS blank,
               count(*) AS loc FROM c GROUP BY 1, 2)
SELECT repository_id, path, CAST(loc AS BIGINT) AS loc, CAST(sloc AS BIGINT) AS sloc,
       CAST(comments AS BIGINT) AS comments, CAST(blank AS BIGINT) AS blank,
       round(CASE WHEN sloc > 0 THEN comments / sloc ELSE 0.0 END, 6) AS comment_ratio
FROM per""")
def q_u6(spark, sf):
    m = SY.raw_metrics(P.files(spark, sf).where(F.col("content").isNotNull()))
    return m.select(REPO, "path", "loc", "sloc", "comments", "blank", r6(F.col("comment_ratio")).alias("comment_ratio"))


# --- U2 / U5 / J9 / J10 / J11: Python symbols (known answers) -------------------------

_PY_ROWS = "WITH " + py_docs_cte() + f""",
pyk AS (SELECT repository_id, path, doc_id, {PY_L} AS L, {PY_K} AS k, {PY_D} AS d FROM pyd),
sym AS (
  SELECT repository_id, path, 'import' AS kind, 'os' AS name, NULL AS parent, L + 1 AS line_start, L + 1 AS line_end,
         NULL AS args, NULL AS bases, NULL AS docstring, NULL AS code_id, NULL::INTEGER AS complexity FROM pyk
  UNION ALL
  SELECT repository_id, path, 'import', CASE WHEN doc_id >= 20 THEN {O.module_sql('(doc_id - 20)')} ELSE 'sys' END,
         NULL, L + 2, L + 2, NULL, NULL, NULL, NULL, NULL FROM pyk
  UNION ALL
  SELECT repository_id, path, 'variable', 'LIMIT_' || CAST(doc_id AS VARCHAR), NULL, L + 4, L + 4, NULL, NULL, NULL,
         'var_LIMIT_' || CAST(doc_id AS VARCHAR) || '_' || CAST(L + 4 AS VARCHAR), NULL FROM pyk
  UNION ALL
  SELECT repository_id, path, 'variable', 'total', NULL, L + 7 + d, L + 7 + d, NULL, NULL, NULL,
         'var_total_' || CAST(L + 7 + d AS VARCHAR), NULL FROM pyk
  UNION ALL
  SELECT repository_id, path, 'function', 'f_' || CAST(doc_id AS VARCHAR), NULL, L + 6, L + 8 + d + 2 * k, 'a,b', NULL,
         CASE WHEN d = 1 THEN 'Doc ' || CAST(doc_id AS VARCHAR) || '.' END,
         'func_f_' || CAST(doc_id AS VARCHAR) || '_' || CAST(L + 6 AS VARCHAR), 1 + k FROM pyk
  UNION ALL
  SELECT repository_id, path, 'class', 'C_' || CAST(doc_id AS VARCHAR), NULL, L + 10 + d + 2 * k, L + 12 + d + 2 * k,
         NULL, CASE WHEN doc_id >= 20 THEN 'C_' || CAST(doc_id - 20 AS VARCHAR) ELSE 'object' END, NULL,
         'class_C_' || CAST(doc_id AS VARCHAR) || '_' || CAST(L + 10 + d + 2 * k AS VARCHAR), NULL FROM pyk
  UNION ALL
  SELECT repository_id, path, 'method', 'run', 'C_' || CAST(doc_id AS VARCHAR), L + 11 + d + 2 * k, L + 12 + d + 2 * k,
         'self,n', NULL, NULL,
         'method_C_' || CAST(doc_id AS VARCHAR) || '_run_' || CAST(L + 11 + d + 2 * k AS VARCHAR), 1 FROM pyk
  UNION ALL
  SELECT repository_id, path, 'function', 'run', NULL, L + 11 + d + 2 * k, L + 12 + d + 2 * k, 'self,n', NULL, NULL,
         'func_run_' || CAST(L + 11 + d + 2 * k AS VARCHAR), 1 FROM pyk)
"""


@register("u2_python_symbols", _PY_ROWS + """
SELECT repository_id, path, kind, name, parent, CAST(line_start AS INTEGER) AS line_start,
       CAST(line_end AS INTEGER) AS line_end, args, bases, NULL::VARCHAR AS alias, docstring, code_id,
       CAST(complexity AS INTEGER) AS complexity
FROM sym""")
def q_u2(spark, sf):
    s = _symbols(spark, sf).where(F.col("kind") != "module")
    return s.select(REPO, "path", "kind", "name", "parent", "line_start", "line_end",
                    F.array_join("args", ",").alias("args"), F.array_join("bases", ",").alias("bases"),
                    "alias", "docstring", "code_id", "complexity")


@register("u5_function_complexity", _PY_ROWS + """
SELECT repository_id, path, kind, name, parent, CAST(line_start AS INTEGER) AS line_number,
       CAST(complexity AS INTEGER) AS complexity
FROM sym WHERE kind IN ('function', 'method')""")
def q_u5(spark, sf):
    return SY.function_metrics(_symbols(spark, sf))


@register("j9_symbol_search", _PY_ROWS + """,
names AS (SELECT 'f_' || CAST(doc_id AS VARCHAR) AS name FROM labels
          UNION ALL SELECT 'C_' || CAST(doc_id AS VARCHAR) FROM labels)
SELECT s.name, s.repository_id, s.path, s.kind, CAST(s.line_start AS INTEGER) AS line_start,
       CASE WHEN s.kind IN ('function', 'method') THEN 'def ' || s.name || '(' || replace(s.args, ',', ', ') || ')' END
         AS signature
FROM names n JOIN sym s ON n.name = s.name WHERE s.kind IN ('function', 'class', 'method')""")
def q_j9(spark, sf):
    lab = P.table(spark, sf, "labels").select("doc_id")
    names = (lab.select(F.concat(F.lit("f_"), F.col("doc_id").cast("string")).alias("name"))
             .unionByName(lab.select(F.concat(F.lit("C_"), F.col("doc_id").cast("string")).alias("name"))))
    hits = SY.search_symbols(names, _symbols(spark, sf))
    return hits.select("name", REPO, "path", "kind", "line_start", "signature")


_ASKED_PREFIXES = ("f_", "C_", "g_", "h_", "K_")


def _decl_list(pats):
    return ", ".join("regexp_extract_all(line, " + O.sql_str(p) + ", 1)" for p in pats)


@register("j9_symbol_search_all", _PY_ROWS + f""",
names AS ({" UNION ALL ".join(f"SELECT '{p}' || CAST(doc_id AS VARCHAR) AS name FROM labels" for p in _ASKED_PREFIXES)}),
lines AS (SELECT repository_id, path, CAST(pos AS INTEGER) AS line_no, line
          FROM {_sql_lines("(SELECT * FROM files WHERE content IS NOT NULL AND NOT ends_with(path, '.py'))")}),
decl AS (SELECT DISTINCT repository_id, path, line_no, line,
                unnest(flatten([{_decl_list(TT.DECL_FUNCTION)}])) AS name, 'function' AS kind FROM lines
         UNION
         SELECT DISTINCT repository_id, path, line_no, line,
                unnest(regexp_extract_all(line, {O.sql_str(TT.DECL_CLASS[0])}, 1)), 'class' FROM lines),
hits AS (SELECT repository_id, path, line_no, line, name, max(kind) AS kind FROM decl GROUP BY 1, 2, 3, 4, 5)
SELECT s.name, s.repository_id, s.path, s.kind, CAST(s.line_start AS INTEGER) AS line_start,
       CASE WHEN s.kind IN ('function', 'method') THEN 'def ' || s.name || '(' || replace(s.args, ',', ', ') || ')' END
         AS signature,
       CASE WHEN s.kind = 'class' THEN 'def run(self, n)' END AS methods
FROM names n JOIN sym s ON n.name = s.name WHERE s.kind IN ('function', 'class', 'method')
UNION ALL
SELECT h.name, h.repository_id, h.path, h.kind, h.line_no, regexp_replace(h.line, '^\\s+|\\s+$', '', 'g'), NULL
FROM names n JOIN hits h ON n.name = h.name""")
def q_j9_all(spark, sf):
    lab = P.table(spark, sf, "labels").select("doc_id")
    names = lab.select(F.explode(F.array(*[F.concat(F.lit(p), F.col("doc_id").cast("string")) for p in _ASKED_PREFIXES])).alias("name"))
    hits = SY.search_symbols(names, _symbols(spark, sf), files=P.files(spark, sf))
    return hits.select("name", REPO, "path", "kind", "line_start", "signature",
                       F.array_join(F.col("methods")["signature"], "; ").alias("methods"))


@register("j10_inheritance", _PY_ROWS + """
SELECT s.repository_id, s.path, s.name AS class_name, s.bases AS base_name, t.path AS base_path
FROM sym s LEFT JOIN sym t ON t.kind = 'class' AND t.repository_id = s.repository_id AND t.name = s.bases
WHERE s.kind = 'class'""")
def q_j10(spark, sf):
    e = J.inheritance_edges(_symbols(spark, sf))
    return e.select(REPO, "path", "class_name", "base_name", "base_path")


@register("j11_import_edges", _PY_ROWS + r""",
prov AS (SELECT repository_id, path AS target_path,
                replace(regexp_replace(regexp_replace(path, '/__init__\.py$', ''), '\.py$', ''), '/', '.') AS module
         FROM files WHERE ends_with(path, '.py'))
SELECT s.repository_id, s.name AS module, s.path, p.target_path
FROM sym s LEFT JOIN prov p ON p.repository_id = s.repository_id AND p.module = s.name
WHERE s.kind = 'import'""")
def q_j11(spark, sf):
    e = J.import_edges(_symbols(spark, sf), P.files(spark, sf))
    return e.select(REPO, "module", "path", "target_path")


# --- U3 / W4: regex symbols in non-Python files ------------------------------------------

def _re_list(pats):
    return ", ".join("regexp_extract_all(line, " + O.sql_str(p) + ", 1)" for p in pats)


@register("u3_regex_symbols", W_(O.files_cte()) + f""",
lines AS (SELECT repository_id, path, CAST(pos AS INTEGER) AS line_no, line
          FROM {_sql_lines("(SELECT * FROM files WHERE content IS NOT NULL AND NOT ends_with(path, '.py'))")}),
cand AS (SELECT repository_id, path, line_no, line, flatten([{_re_list(TT.DECL_FUNCTION)}]) AS fns,
                regexp_extract_all(line, {O.sql_str(TT.DECL_CLASS[0])}, 1) AS cls FROM lines),
hits0 AS (SELECT DISTINCT repository_id, path, line_no, line, unnest(fns) AS name, 'function' AS kind FROM cand
          UNION
          SELECT DISTINCT repository_id, path, line_no, line, unnest(cls) AS name, 'class' AS kind FROM cand),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, path, line_no, name ORDER BY kind DESC) AS r
                        FROM hits0) WHERE r = 1),
ctx AS (SELECT h.repository_id, h.path, h.name, h.kind, h.line_no,
               string_agg(l.line, chr(10) ORDER BY l.line_no) AS source
        FROM hits h JOIN lines l ON l.repository_id = h.repository_id AND l.path = h.path
         AND l.line_no BETWEEN greatest(1, h.line_no - 1)
                           AND h.line_no + CASE WHEN h.kind = 'class' THEN 50 ELSE 20 END - 1
        GROUP BY 1, 2, 3, 4, 5)
SELECT h.repository_id, h.path, h.name, h.kind, h.line_no AS line_start,
       regexp_replace(h.line, '^\\s+|\\s+$', '', 'g') AS signature, md5(c.source) AS source_md5
FROM hits h JOIN ctx c USING (repository_id, path, name, kind, line_no)""")
def q_u3(spark, sf):
    r = TT.regex_symbols(P.files(spark, sf))
    return r.select(REPO, "path", "name", "kind", "line_start", "signature", F.md5("source").alias("source_md5"))


# --- U8 ---------------------------------------------------------------------------------------

def _readme_sql():
    hit = " OR ".join(f"contains(lower(split_part(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), chr(10), 1)), '{k}')"
                      for k in TT.README_KEYWORDS)
    strip = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    st = strip.format(x="s")
    body = strip.format(x=f"array_to_string(list_slice(string_split({st}, chr(10)), 2, len(string_split({st}, chr(10)))), chr(10))")
    sec = (f"lambda s: CASE WHEN {hit} THEN chr(10) || chr(10) || '## ' || lower(split_part({st}, chr(10), 1)) "
           f"|| chr(10) || substr({body}, 1, 500) || '...' ELSE '' END")
    prio = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(TT.README_NAMES))
    names = ", ".join(O.sql_str(n) for n in TT.README_NAMES)
    c = "coalesce(readme, '')"
    secs = f"regexp_split_to_array({c}, '#{{1,6}}\\s+')"
    return W_(O.files_cte()) + f""",
cand AS (SELECT repository_id, content, CASE path {prio} END AS p FROM files WHERE path IN ({names})),
best AS (SELECT repository_id, arg_min(content, p) AS readme FROM cand GROUP BY 1),
repos AS (SELECT DISTINCT repository_id FROM files),
j AS (SELECT r.repository_id, b.readme FROM repos r LEFT JOIN best b ON r.repository_id = b.repository_id)
SELECT repository_id,
  CASE WHEN readme IS NULL THEN 'No README found'
       WHEN {strip.format(x=c)} = '' THEN 'No README content available.'
       WHEN length({c}) < 1500 THEN {strip.format(x=c)}
       ELSE {strip.format(x=secs + '[1]')}
            || array_to_string(list_transform(list_slice({secs}, 2, len({secs})), {sec}), '')
  END AS summary
FROM j"""


@register("u8_readme_summary", _readme_sql())
def q_u8(spark, sf):
    return TT.readme_summary(P.files(spark, sf))


# --- U9 / U10 / W3: diffs --------------------------------------------------------------------

def _diff_lines_sql(compat: bool) -> str:
    skip = "(starts_with(line, '---') OR starts_with(line, '+++'))" + ("" if compat else " AND hunk = 0")
    hh = r"'@@ -(\d+),?\d* \+(\d+),?\d* @@'"
    return W_(O.diffs_cte()) + f""",
l0 AS (SELECT diff_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS idx, unnest(p) AS line
       FROM (SELECT diff_id, string_split(diff, chr(10)) AS p FROM diffs)),
l1 AS (SELECT *, sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END)
                   OVER (PARTITION BY diff_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hunk
       FROM l0),
l2 AS (SELECT *, CASE WHEN starts_with(line, '@@') THEN 'header' WHEN {skip} THEN 'skip'
                      WHEN starts_with(line, '-') THEN 'removed' WHEN starts_with(line, '+') THEN 'added'
                      ELSE 'context' END AS kind,
              starts_with(line, '@@') AND regexp_extract(line, {hh}, 1) <> '' AS reset,
              CASE WHEN starts_with(line, '@@') AND regexp_extract(line, {hh}, 1) <> ''
                   THEN CAST(regexp_extract(line, {hh}, 1) AS BIGINT) END AS l0,
              CASE WHEN starts_with(line, '@@') AND regexp_extract(line, {hh}, 1) <> ''
                   THEN CAST(regexp_extract(line, {hh}, 2) AS BIGINT) END AS r0
       FROM l1),
l3 AS (SELECT *,
         sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER w AS seg,
         coalesce(last_value(l0 IGNORE NULLS) OVER w, 0) AS bl,
         coalesce(last_value(r0 IGNORE NULLS) OVER w, 0) AS br
       FROM l2 WINDOW w AS (PARTITION BY diff_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l4 AS (SELECT *,
         bl + coalesce(sum(CASE WHEN kind IN ('removed', 'context') THEN 1 ELSE 0 END) OVER ws, 0) AS left_no,
         br + coalesce(sum(CASE WHEN kind IN ('added', 'context') THEN 1 ELSE 0 END) OVER ws, 0) AS right_no
       FROM l3 WINDOW ws AS (PARTITION BY diff_id, seg ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dl AS (SELECT diff_id, idx, CAST(hunk AS INTEGER) AS hunk, kind,
              CASE WHEN kind IN ('removed', 'added') THEN substr(line, 2) ELSE line END AS text,
              CASE WHEN kind = 'removed' THEN CAST(left_no AS BIGINT) END AS left_no,
              CASE WHEN kind = 'added' THEN CAST(right_no AS BIGINT) END AS right_no
       FROM l4)
"""


@register("u9_diff_lines", _diff_lines_sql(False) + "SELECT * FROM dl")
def q_u9(spark, sf):
    return TT.parse_diff_lines(P.unified_diffs(spark, sf))


@register("u9_diff_lines_compat", _diff_lines_sql(True) + "SELECT * FROM dl")
def q_u9c(spark, sf):
    return TT.parse_diff_lines(P.unified_diffs(spark, sf), compat=True)


@register("u9_diff_blocks", _diff_lines_sql(False) + """,
b AS (SELECT diff_id, hunk,
        coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (WHERE kind = 'removed'), '') AS removed,
        coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (WHERE kind = 'added'), '') AS added,
        coalesce(string_agg(CAST(left_no AS VARCHAR), ',' ORDER BY idx) FILTER (WHERE kind = 'removed'), '') AS removed_nos,
        coalesce(string_agg(CAST(right_no AS VARCHAR), ',' ORDER BY idx) FILTER (WHERE kind = 'added'), '') AS added_nos,
        CAST(count(*) FILTER (WHERE kind = 'removed') AS INTEGER) AS n_removed,
        CAST(count(*) FILTER (WHERE kind = 'added') AS INTEGER) AS n_added
      FROM dl WHERE kind IN ('removed', 'added') GROUP BY 1, 2),
h AS (SELECT diff_id, hunk, text AS header FROM dl WHERE kind = 'header'),
fb AS (SELECT d.diff_id, string_split(d.diff, chr(10)) AS p FROM diffs d
       WHERE d.diff_id NOT IN (SELECT diff_id FROM b) AND length(trim(d.diff)) > 0
         AND NOT (starts_with(d.diff, 'Binary') OR starts_with(d.diff, 'File was') OR starts_with(d.diff, 'Could not')
                  OR starts_with(d.diff, 'Error')))
SELECT b.diff_id, b.hunk AS block_no, h.header, b.n_removed, b.n_added, b.removed, b.added, b.removed_nos, b.added_nos
FROM b LEFT JOIN h ON b.diff_id = h.diff_id AND b.hunk = h.hunk
UNION ALL
SELECT diff_id, 0, 'Changes', 0, CAST(len(p) AS INTEGER), '', array_to_string(p, chr(10)), '',
       array_to_string(list_transform(range(1, len(p) + 1), lambda x: CAST(x AS VARCHAR)), ',')
FROM fb""")
def q_u9b(spark, sf):
    b = TT.parse_diff_blocks(P.unified_diffs(spark, sf))
    return b.select("diff_id", "block_no", "header", F.size("removed").alias("n_removed"),
                    F.size("added").alias("n_added"), F.array_join("removed", "\n").alias("removed"),
                    F.array_join("added", "\n").alias("added"),
                    F.array_join(F.transform("removed_line_numbers", lambda x: x.cast("string")), ",").alias("removed_nos"),
                    F.array_join(F.transform("added_line_numbers", lambda x: x.cast("string")), ",").alias("added_nos"))


# --- U12 / U13: code names and paths asked about in chat -----------------------------------------

@register("u12_code_elements", W_(O.messages_cte()) + f"""
SELECT session_id, turn, CAST(generate_subscripts(n, 1) - 1 AS INTEGER) AS element_no, unnest(n) AS name
FROM (SELECT session_id, turn,
             list_filter(flatten([{', '.join('regexp_extract_all(content, ' + O.sql_str('(?i)' + TX.unicode_word(p)) + ', 1)' for p in TX.CODE_ELEMENT_PATTERNS)}]),
                         lambda s: length(s) > 2) AS n
      FROM messages)""")
def q_u12(spark, sf):
    return TT.extract_code_elements(P.messages(spark, sf), "content", ["session_id", "turn"]).select(
        "session_id", "turn", F.col("element_no").cast("int"), "name")


@register("u13_code_paths", W_(O.messages_cte()) + f"""
SELECT DISTINCT session_id, turn, p AS path FROM (
  SELECT session_id, turn, unnest(regexp_extract_all(content, {O.sql_str(TX.unicode_word(TX.CODE_PATH_PATTERN))}, 2)) AS p
  FROM messages) WHERE NOT contains(p, '```')""")
def q_u13(spark, sf):
    return TT.extract_code_paths(P.messages(spark, sf), "content", ["session_id", "turn"])


# =====================================================================================
# K / B : retrieval
# =====================================================================================

def _tok_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{TX.NON_WORD}'), lambda t: t <> '')"


def _tf_sql(name: str, src: str, ids: str, text: str) -> str:
    """Sparse hashed term counts (ids..., bucket, tf) of a text column."""
    return f"""{name} AS (
  SELECT {ids}, CAST(('0x' || substr(md5(tok), 1, 4))::BIGINT % 64 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT {ids}, unnest({_tok_sql(text)}) AS tok FROM {src}) GROUP BY ALL)"""


@register("k6_hashed_tf", W_(_tf_sql("tf", "documents", "doc_id", "text")) + "SELECT * FROM tf")
def q_k6(spark, sf):
    d = P.table(spark, sf, "documents").select("doc_id", "text")
    return K.hashed_term_counts(d, ["doc_id"], "text")


def _bench_questions(spark, sf):
    """Benchmark items as questions, each addressed to one repository."""
    q = P.questions(spark, sf)
    return q.withColumn(REPO, F.concat(F.lit("src"), (F.col("query_id") % P.N_REPOS).cast("string")))


@register("k2_search_commits", W_(O.commits_cte(),
                                  _tf_sql("qtf", "benchmark", "item_id", "text"),
                                  _tf_sql("ctf", "commits", "hash", "message")) + """,
q AS (SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS repository_id FROM benchmark),
qn AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM qtf GROUP BY 1),
cn AS (SELECT hash, sqrt(sum(tf * tf)) AS n FROM ctf GROUP BY 1),
dots AS (SELECT qtf.item_id, ctf.hash, sum(qtf.tf * ctf.tf) AS dp FROM qtf JOIN ctf USING (bucket) GROUP BY 1, 2),
cand AS (SELECT q.query_id, c.repository_id, c.hash, c.seq,
                CAST(coalesce(d.dp, 0) AS DOUBLE) / (qn.n * cn.n) AS score
         FROM q JOIN qn ON q.query_id = qn.item_id
         JOIN commits c ON c.repository_id = q.repository_id JOIN cn ON cn.hash = c.hash
         LEFT JOIN dots d ON d.item_id = q.query_id AND d.hash = c.hash
         WHERE qn.n > 0 AND cn.n > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, hash) AS rank FROM cand),
t5 AS (SELECT * FROM top WHERE rank <= 5)
SELECT query_id, repository_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seq, hash) AS INTEGER) AS position,
       hash, seq, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score
FROM t5""")
def q_k2(spark, sf):
    q = _bench_questions(spark, sf)
    qv = K.hashed_embedding(q, ["query_id", REPO], "text")
    c = P.commits(spark, sf)
    cv = K.hashed_embedding(c, [REPO, "hash", "seq"], "message")
    out = K.search_commits(qv, cv, k=5, on=[REPO])
    return out.select("query_id", REPO, F.col("position").cast("int"), "hash", "seq", F.col("rank").cast("int"),
                      r6(F.col("score")).alias("score"))


_BM25_SQL = f"""
dt AS (SELECT doc_id, unnest({_tok_sql('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_tok_sql('text')}) AS term FROM benchmark),
bm AS (SELECT qt.query_id, tf.doc_id,
              sum(ln(1 + (st.n_docs - df.df + 0.5) / (df.df + 0.5))
                  * (tf.tf * 2.5) / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl))) AS score
       FROM qt JOIN tf ON qt.term = tf.term JOIN dl ON dl.doc_id = tf.doc_id JOIN df ON df.term = tf.term, st
       GROUP BY 1, 2),
bm_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
                          FROM bm) WHERE rank <= 10)"""


@register("b1_bm25", "WITH " + _BM25_SQL + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM bm_top""")
def q_b1(spark, sf):
    docs = P.table(spark, sf, "documents").select("doc_id", "text")
    idx = K.bm25_index(docs)
    out = K.bm25_search(P.questions(spark, sf), idx, k=10)
    return out.select("query_id", F.col("rank").cast("int"), "doc_id", r6(F.col("score")).alias("score"))


@register("b2_hybrid", "WITH " + _BM25_SQL + ",\n" + _tf_sql("qtf", "benchmark", "item_id", "text") + ",\n"
          + _tf_sql("dtf", "documents", "doc_id", "text") + """,
qn AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM qtf GROUP BY 1),
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM dtf GROUP BY 1),
dots AS (SELECT qtf.item_id, dtf.doc_id, sum(qtf.tf * dtf.tf) AS dp FROM qtf JOIN dtf USING (bucket) GROUP BY 1, 2),
cos AS (SELECT qn.item_id AS query_id, dn.doc_id, CAST(coalesce(d.dp, 0) AS DOUBLE) / (qn.n * dn.n) AS score
        FROM qn CROSS JOIN dn LEFT JOIN dots d ON d.item_id = qn.item_id AND d.doc_id = dn.doc_id
        WHERE qn.n > 0 AND dn.n > 0),
cos_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
                           FROM cos) WHERE rank <= 10),
nt AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w
                   THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s
       FROM bm_top WINDOW w AS (PARTITION BY query_id)),
nv AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w
                   THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s
       FROM cos_top WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT coalesce(nt.query_id, nv.query_id) AS query_id, coalesce(nt.doc_id, nv.doc_id) AS doc_id,
                 0.5 * coalesce(nt.s, 0.0) + 0.5 * coalesce(nv.s, 0.0) AS score
          FROM nt FULL OUTER JOIN nv ON nt.query_id = nv.query_id AND nt.doc_id = nv.doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused)
WHERE rank <= 10""")
def q_b2(spark, sf):
    docs = P.table(spark, sf, "documents").select("doc_id", "text")
    qs = P.questions(spark, sf)
    bm = K.bm25_search(qs, K.bm25_index(docs), k=10)
    qv = K.hashed_embedding(qs, ["query_id"], "text")
    dv = K.hashed_embedding(docs, ["doc_id"], "text").withColumnRenamed("doc_id", "key")
    cos = K.cosine_top_k(qv, dv, k=10).withColumnRenamed("key", "doc_id")
    out = K.hybrid_search(bm, cos, alpha=0.5, k=10)
    return out.select("query_id", F.col("rank").cast("int"), "doc_id", r6(F.col("score")).alias("score"))


# =====================================================================================
# H : advertised analyses
# =====================================================================================

from codeloom.operators import dup as D  # noqa: E402


@register("h1_high_impact_commits", _STATS_SQL + """
SELECT repository_id, hash, CAST(insertions + deletions AS BIGINT) AS churn, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY insertions + deletions DESC, hash) AS rank FROM stats)
WHERE rank <= 10""")
def q_h1(spark, sf):
    s = A.commit_stats(P.commits(spark, sf, with_seq=False), P.file_changes(spark, sf))
    return D.high_impact_commits(s, 10).select(REPO, "hash", F.col("churn").cast("long"), F.col("rank").cast("int"))


@register("j12_hot_spots", W_(O.files_cte(), FILE_COMPLEXITY_SQL, O.file_changes_cte()) + """,
ch AS (SELECT repository_id, path, count(*) AS n_changes, sum(insertions) AS ins, sum(deletions) AS dels
       FROM file_changes GROUP BY 1, 2)
SELECT ch.repository_id, ch.path, CAST(n_changes AS BIGINT) AS n_changes, round(x.complexity, 6) AS complexity,
       round((ins + dels) * x.complexity, 6) AS impact
FROM ch JOIN file_cx x ON ch.repository_id = x.repository_id AND ch.path = x.path""")
def q_j12(spark, sf):
    churn = A.file_churn(P.file_changes(spark, sf))
    h = J.hot_spots(churn, _file_scores(spark, sf))
    return h.select(REPO, "path", "n_changes", r6(F.col("complexity")).alias("complexity"),
                    r6(F.col("impact")).alias("impact"))


@register("h2_doc_quality", "WITH " + py_docs_cte() + """,
cov AS (SELECT repository_id, 3 * count(*) AS n_documentable,
               count(*) FILTER (WHERE doc_id % 3 = 0) AS n_documented FROM pyd GROUP BY 1),
fs AS (SELECT repository_id, count(*) AS n_files,
              count(*) FILTER (WHERE ends_with(lower(path), '.md') OR ends_with(lower(path), '.rst')
                                     OR ends_with(lower(path), '.txt') OR contains(lower(path), 'doc')) AS n_doc_files,
              bool_or(path IN ('README.md', 'README.rst', 'Readme.md', 'readme.md')) AS has_readme
       FROM files GROUP BY 1)
SELECT fs.repository_id, CAST(coalesce(n_documentable, 0) AS BIGINT) AS n_documentable,
       CAST(coalesce(n_documented, 0) AS BIGINT) AS n_documented,
       round(CASE WHEN n_documentable > 0 THEN n_documented / n_documentable ELSE 0.0 END, 6) AS docstring_coverage,
       has_readme, round(n_doc_files / n_files, 6) AS doc_ratio
FROM fs LEFT JOIN cov ON fs.repository_id = cov.repository_id""")
def q_h2(spark, sf):
    q = D.doc_quality(_symbols(spark, sf), P.files(spark, sf))
    return q.select(REPO, "n_documentable", "n_documented", r6(F.col("docstring_coverage")).alias("docstring_coverage"),
                    "has_readme", r6(F.col("doc_ratio")).alias("doc_ratio"))


@register("h3_exact_duplicates", W_(O.files_cte()) + """
SELECT sha256(content) AS digest, CAST(count(*) AS BIGINT) AS n_copies,
       min(repository_id || ':' || path) AS first_file, CAST(count(DISTINCT repository_id) AS BIGINT) AS n_repositories
FROM files WHERE NOT files.binary AND content IS NOT NULL AND length(content) > 0
GROUP BY 1 HAVING count(*) > 1""")
def q_h3(spark, sf):
    return D.exact_duplicates(P.files(spark, sf)).select("digest", F.col("n_copies").cast("long"), "first_file",
                                                         F.col("n_repositories").cast("long"))


_H3_SQL = f"""
WITH d AS (SELECT min(doc_id) AS doc, text FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT doc, list_filter({_tok_sql("text")}, lambda x: length(x) > 0) AS w FROM d),
s AS (SELECT DISTINCT doc, unnest(CASE WHEN len(w) >= 3
        THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc, count(*) AS n FROM s GROUP BY doc),
i AS (SELECT a.doc AS doc_a, b.doc AS doc_b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc < b.doc GROUP BY 1, 2)
SELECT doc_a, doc_b, round(c / (na.n + nb.n - c), 6) AS jaccard
FROM i JOIN n na ON na.doc = doc_a JOIN n nb ON nb.doc = doc_b
WHERE CAST(c AS DOUBLE) / (na.n + nb.n - c) >= 0.7
UNION ALL
SELECT d.doc, x.doc_id, 1.0 FROM documents x JOIN d ON x.text = d.text WHERE x.doc_id <> d.doc"""


@register("h3_near_duplicates", _H3_SQL)
def q_h3n(spark, sf):
    docs = P.table(spark, sf, "documents").select("doc_id", "text")
    return D.near_duplicates(docs).select("doc_a", "doc_b", r6(F.col("jaccard")).alias("jaccard"))


@register("t3_commit_frequency_batch", W_(O.commits_cte()) + """
SELECT repository_id, date_trunc('day', author_ts) AS day, CAST(count(*) AS BIGINT) AS n_commits
FROM commits GROUP BY 1, 2""")
def q_t3(spark, sf):
    c = P.commits(spark, sf, with_seq=False)
    f = L.commit_frequency(c, "author_ts", "1 day")
    return f.select(REPO, F.col("window_start").alias("day"), "n_commits")


@register("a5_file_metrics", "WITH " + py_docs_cte() + f""",
pyk AS (SELECT repository_id, path, doc_id, {PY_L} AS L, {PY_K} AS k, {PY_D} AS d FROM pyd),
m AS (SELECT repository_id, path, k, L AS comments, 9 + d + 2 * k AS sloc, k + 2 AS g,
             CASE WHEN k > 0 THEN 6 * k * log2(6) ELSE 0.0 END AS v FROM pyk)
SELECT repository_id, path, CAST(sloc AS BIGINT) AS lines_of_code,
       round(1.0 + k / 2.0, 6) AS cyclomatic_complexity,
       round(CASE WHEN v <= 0 OR sloc <= 0 THEN 100.0 ELSE greatest(0.0, least(100.0,
             (171 - 5.2 * ln(v) - 0.23 * g - 16.2 * ln(sloc) + 50 * sin(sqrt(2.4 * radians(comments * 100.0 / sloc))))
             * 100 / 171)) END, 6) AS maintainability_index,
       round(comments / sloc, 6) AS comment_ratio
FROM m""")
def q_a5(spark, sf):
    return _file_metrics(P.files(spark, sf).where(F.col("path").endswith(".py")), _symbols(spark, sf))


def _file_metrics(files, symbols):
    m = SY.file_metrics(files, symbols)
    return m.select(REPO, "path", "lines_of_code", r6(F.col("cyclomatic_complexity")).alias("cyclomatic_complexity"),
                    r6(F.col("maintainability_index")).alias("maintainability_index"),
                    r6(F.col("comment_ratio")).alias("comment_ratio"))


_ANALYSABLE_SQL = " OR ".join(f"ends_with(path, {O.sql_str(e)})" for e in X.ANALYZABLE_EXTENSIONS)


@register("a5_file_metrics_all", "WITH " + py_docs_cte() + f""",
pyk AS (SELECT repository_id, path, doc_id, {PY_L} AS L, {PY_K} AS k, {PY_D} AS d FROM pyd),
m AS (SELECT repository_id, path, k, L AS comments, 9 + d + 2 * k AS sloc, k + 2 AS g,
             CASE WHEN k > 0 THEN 6 * k * log2(6) ELSE 0.0 END AS v FROM pyk),
rest AS (SELECT repository_id, path, content FROM files
         WHERE content IS NOT NULL AND NOT ends_with(path, '.py') AND ({_ANALYSABLE_SQL})),
l AS (SELECT repository_id, path, regexp_replace(line, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS s FROM {_sql_lines("(SELECT * FROM rest)")}),
c AS (SELECT repository_id, path, s, starts_with(s, '#') OR starts_with(s, '//') OR starts_with(s, '/*')
             OR starts_with(s, '*') AS is_comment FROM l),
per AS (SELECT repository_id, path, count(*) FILTER (WHERE s <> '' AND NOT is_comment) AS sloc,
               count(*) FILTER (WHERE is_comment) AS comments FROM c GROUP BY 1, 2)
SELECT repository_id, path, CAST(sloc AS BIGINT) AS lines_of_code,
       round(1.0 + k / 2.0, 6) AS cyclomatic_complexity,
       round(CASE WHEN v <= 0 OR sloc <= 0 THEN 100.0 ELSE greatest(0.0, least(100.0,
             (171 - 5.2 * ln(v) - 0.23 * g - 16.2 * ln(sloc) + 50 * sin(sqrt(2.4 * radians(comments * 100.0 / sloc))))
             * 100 / 171)) END, 6) AS maintainability_index,
       round(comments / sloc, 6) AS comment_ratio
FROM m
UNION ALL
SELECT repository_id, path, CAST(coalesce(sloc, 0) AS BIGINT), NULL, NULL,
       round(CASE WHEN sloc > 0 THEN comments / sloc ELSE 0.0 END, 6)
FROM rest LEFT JOIN per USING (repository_id, path)""")
def q_a5_all(spark, sf):
    return _file_metrics(P.files(spark, sf), _symbols(spark, sf))


# =====================================================================================
# C : context assembly (nested output; checked by row count and by tests)
# =====================================================================================

from codeloom.operators import context as C  # noqa: E402


def _chat_questions(spark, sf):
    """Sessions whose last message is the user's: the question is that message (F8, A10)."""
    m = P.messages(spark, sf)
    s = A.user_sessions(m)
    return s.select(F.col("session_id").alias("query_id"), "session_id",
                    F.concat(F.lit("src"), (F.col("session_id") % P.N_REPOS).cast("string")).alias(REPO),
                    F.col("last_content").alias("text"))


@register("c1_build_context")
def q_c1(spark, sf):
    ctx = C.build_context(_chat_questions(spark, sf), P.files(spark, sf), P.commits(spark, sf),
                          P.file_changes(spark, sf), P.messages(spark, sf))
    return ctx.select("query_id", REPO, F.to_json("context").alias("context_json"))


@register("c2_text_context")
def q_c2(spark, sf):
    return C.build_text_context(_chat_questions(spark, sf), P.files(spark, sf), P.commits(spark, sf),
                                P.file_changes(spark, sf))


@register("c2_named_commit", W_(O.messages_cte(), O.commits_cte(), O.file_changes_cte()) + """,
q AS (SELECT session_id AS query_id, 'src' || CAST(session_id % 20 AS VARCHAR) AS repository_id
      FROM messages GROUP BY session_id HAVING arg_max(role, turn) = 'user'),
named AS (SELECT q.query_id, c.* FROM q JOIN commits c ON c.repository_id = q.repository_id AND c.seq = q.query_id % 7),
listed AS (SELECT n.query_id, f.path, f.change_type,
                  '@@ -1,' || CAST(f.deletions AS VARCHAR) || ' +1,' || CAST(f.insertions AS VARCHAR) || ' @@' || chr(10)
                    || repeat('+' || f.path || chr(10), f.insertions) AS patch,
                  row_number() OVER (PARTITION BY n.query_id ORDER BY f.path, f.change_type, f.insertions, f.deletions) AS rn
           FROM named n JOIN file_changes f ON f.repository_id = n.repository_id AND f.hash = n.hash),
txt AS (SELECT query_id, string_agg('  ' || change_type || ' ' || path, chr(10) ORDER BY rn) FILTER (rn <= 10) AS file_lines,
               max(CASE WHEN rn = 1 THEN chr(10) || chr(10) || 'Sample diff for ' || path || ':' || chr(10) || '```diff' || chr(10)
                                         || substr(patch, 1, 1000) || chr(10) || '```' END) AS sample
        FROM listed GROUP BY 1)
SELECT n.query_id, 'Commit ' || hash || chr(10) || 'Author: ' || author_name || ' <' || author_email || '>' || chr(10)
       || 'Date: ' || strftime(author_ts, '%Y-%m-%dT%H:%M:%S') || chr(10)
       || 'Message: ' || regexp_replace(message, '^\\s+|\\s+$', '', 'g') || chr(10) || 'Files:' || chr(10)
       || coalesce(file_lines, '') || coalesce(sample, '') AS specific_txt
FROM named n LEFT JOIN txt ON txt.query_id = n.query_id""")
def q_c2_named(spark, sf):
    commits = P.commits(spark, sf)
    q = _chat_questions(spark, sf).select("query_id", REPO, (F.col("query_id") % 7).alias("seq"))
    return C.specific_commits(q.join(commits, [REPO, "seq"]), commits, P.with_patch(P.file_changes(spark, sf)))


@register("c3_build_prompt")
def q_c3(spark, sf):
    q = stored(_chat_questions(spark, sf))
    ctx = C.build_context(q, P.files(spark, sf), P.commits(spark, sf), P.file_changes(spark, sf), P.messages(spark, sf))
    j = ctx.select("query_id", F.to_json("context").alias("context_json")).join(q.select("query_id", "text"), "query_id")
    return C.build_prompt(j)


C5_SQL = W_(O.files_cte(), O.messages_cte(), O.commits_cte()) + """,
q AS (SELECT session_id AS query_id, 'src' || CAST(session_id % 20 AS VARCHAR) AS repository_id,
             arg_max(content, turn) AS text
      FROM messages GROUP BY session_id HAVING arg_max(role, turn) = 'user'),
""" + _tf_sql("qtf", "q", "query_id", "text") + ",\n" + _tf_sql(
    "ftf", "(SELECT repository_id, path, content AS c FROM files WHERE NOT files.binary AND content IS NOT NULL)",
    "repository_id, path", "c") + ",\n" + _tf_sql("ctf", "commits", "hash", "message") + """,
qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM qtf GROUP BY 1),
fn AS (SELECT repository_id, path, sqrt(sum(tf * tf)) AS n FROM ftf GROUP BY 1, 2),
cn AS (SELECT hash, sqrt(sum(tf * tf)) AS n FROM ctf GROUP BY 1),
fdots AS (SELECT qtf.query_id, ftf.repository_id, ftf.path, sum(qtf.tf * ftf.tf) AS dp
          FROM qtf JOIN ftf USING (bucket) GROUP BY 1, 2, 3),
fcand AS (SELECT q.query_id, fn.path, CAST(coalesce(d.dp, 0) AS DOUBLE) / (qn.n * fn.n) AS score
          FROM q JOIN qn ON q.query_id = qn.query_id JOIN fn ON fn.repository_id = q.repository_id
          LEFT JOIN fdots d ON d.query_id = q.query_id AND d.repository_id = fn.repository_id AND d.path = fn.path
          WHERE qn.n > 0 AND fn.n > 0),
ftop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank
                        FROM fcand) WHERE rank <= 10),
cdots AS (SELECT qtf.query_id, ctf.hash, sum(qtf.tf * ctf.tf) AS dp FROM qtf JOIN ctf USING (bucket) GROUP BY 1, 2),
ccand AS (SELECT q.query_id, c.hash, c.seq, CAST(coalesce(d.dp, 0) AS DOUBLE) / (qn.n * cn.n) AS score
          FROM q JOIN qn ON q.query_id = qn.query_id JOIN commits c ON c.repository_id = q.repository_id
          JOIN cn ON cn.hash = c.hash LEFT JOIN cdots d ON d.query_id = q.query_id AND d.hash = c.hash
          WHERE qn.n > 0 AND cn.n > 0),
ctop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, hash) AS rank
                        FROM ccand) WHERE rank <= 5),
rf AS (SELECT query_id, string_agg(path, ',' ORDER BY rank) AS relevant_files FROM ftop GROUP BY 1),
rc AS (SELECT query_id, string_agg(hash, ',' ORDER BY seq, hash) AS relevant_commits FROM ctop GROUP BY 1)
SELECT q.query_id, coalesce(rf.relevant_files, '') AS relevant_files, coalesce(rc.relevant_commits, '') AS relevant_commits
FROM q LEFT JOIN rf ON q.query_id = rf.query_id LEFT JOIN rc ON q.query_id = rc.query_id"""


@register("c5_chat_result", C5_SQL)
def q_c5(spark, sf):
    r = C.chat_hits(_chat_questions(spark, sf), P.files(spark, sf), P.commits(spark, sf))
    return r.select("query_id", F.array_join("relevant_files", ",").alias("relevant_files"),
                    F.array_join("relevant_commits", ",").alias("relevant_commits"))


@register("c4_issue_context")
def q_c4(spark, sf):
    q = _bench_questions(spark, sf).select(F.col("query_id").alias("event_id"), REPO,
                                           F.lit("Question").alias("title"), F.col("text").alias("body"))
    return C.issue_context(q, P.files(spark, sf), P.commits(spark, sf), P.file_changes(spark, sf))


@register("k1_relevant_files", W_(O.files_cte(), O.messages_cte()) + """,
q AS (SELECT session_id AS query_id, 'src' || CAST(session_id % 20 AS VARCHAR) AS repository_id,
             arg_max(content, turn) AS text
      FROM messages GROUP BY session_id HAVING arg_max(role, turn) = 'user'),
""" + _tf_sql("qtf", "q", "query_id", "text") + ",\n"
          + _tf_sql("ftf", "(SELECT repository_id, path, content AS c FROM files WHERE NOT files.binary AND content IS NOT NULL)",
                    "repository_id, path", "c") + """,
qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM qtf GROUP BY 1),
fn AS (SELECT repository_id, path, sqrt(sum(tf * tf)) AS n FROM ftf GROUP BY 1, 2),
dots AS (SELECT qtf.query_id, ftf.repository_id, ftf.path, sum(qtf.tf * ftf.tf) AS dp
         FROM qtf JOIN ftf USING (bucket) GROUP BY 1, 2, 3),
cand AS (SELECT q.query_id, fn.path, CAST(coalesce(d.dp, 0) AS DOUBLE) / (qn.n * fn.n) AS score
         FROM q JOIN qn ON q.query_id = qn.query_id JOIN fn ON fn.repository_id = q.repository_id
         LEFT JOIN dots d ON d.query_id = q.query_id AND d.repository_id = fn.repository_id AND d.path = fn.path
         WHERE qn.n > 0 AND fn.n > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, path, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank FROM cand)
WHERE rank <= 10""")
def q_k1_files(spark, sf):
    rel = C.relevant_files(_chat_questions(spark, sf), P.files(spark, sf), k=10)
    return rel.select("query_id", F.col("rank").cast("int"), "path", r6(F.col("score")).alias("score"))


# =====================================================================================
# T : batch forms of the streaming operators (the stream forms are tested against these)
# =====================================================================================

from codeloom.streaming import live as L  # noqa: E402


@register("t4_latest_value_batch", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_type, value FROM events),
a AS (SELECT max(ts) AS asof FROM events),
n AS (SELECT user_id, arg_max(ts, ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value
      FROM e GROUP BY 1)
SELECT user_id, CASE WHEN n.ts > a.asof - INTERVAL 24 HOUR THEN 'ready' ELSE 'not_ready' END AS status,
       CASE WHEN n.ts > a.asof - INTERVAL 24 HOUR THEN n.ts END AS ts,
       CASE WHEN n.ts > a.asof - INTERVAL 24 HOUR THEN n.event_type END AS event_type,
       CASE WHEN n.ts > a.asof - INTERVAL 24 HOUR THEN round(n.value, 6) END AS value
FROM n, a""")
def q_t4(spark, sf):
    ev = P.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), "ts", "event_type", "value")
    asof = ev.agg(F.max("ts").cast("string")).first()[0]  # one scalar to the driver, as wall-clock text
    out = L.latest_value(ev, ["user_id"], "ts", ["event_type", "value"], F.lit(asof).cast(ev.schema["ts"].dataType))
    return out.select("user_id", "status", "ts", "event_type", r6(F.col("value")).alias("value"))


@register("t5_sessions_batch", """
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                                    OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                               THEN 1 ELSE 0 END AS new_s FROM events),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
      FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, CAST(count(*) AS BIGINT) AS n_events
FROM s GROUP BY user_id, sid""")
def q_t5(spark, sf):
    ev = P.table(spark, sf, "events").select("user_id", "ts")
    s = L.sessions(ev, "user_id", "ts", "30 minutes")
    return s.select("user_id", "session_start", "session_end", "n_events")


@register("t5_session_state", """
WITH e AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                            OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                       THEN 1 ELSE 0 END AS new_s FROM events),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
      FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY ts DESC, event_type DESC, value DESC) AS n,
             min(ts) OVER (PARTITION BY user_id, sid) AS session_start FROM s)
SELECT user_id, session_start, ts AS last_ts, event_type AS last_event_type, round(value, 6) AS last_value FROM r WHERE n = 1""")
def q_t5_state(spark, sf):
    ev = P.table(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    s = L.sessions(ev, "user_id", "ts", "30 minutes", payload=["event_type", "value"])
    return s.select("user_id", "session_start", "last_ts", "last_event_type", r6(F.col("last_value")).alias("last_value"))


# =====================================================================================
# K3 / K4 / K5 / X2 : listings, previews, change messages
# =====================================================================================

from codeloom.operators import listing as LS  # noqa: E402


@register("k3_functions_by_complexity", _PY_ROWS + """
SELECT repository_id, path, name, kind, CAST(line_start AS INTEGER) AS line_number, CAST(complexity AS INTEGER) AS complexity,
       CAST(row_number() OVER (PARTITION BY repository_id, path
                               ORDER BY coalesce(complexity, 0) DESC, line_start, name, kind) AS INTEGER) AS position
FROM sym WHERE kind IN ('function', 'method')""")
def q_k3(spark, sf):
    fm = SY.function_metrics(_symbols(spark, sf))
    return LS.functions_by_complexity(fm).select(REPO, "path", "name", "kind", "line_number", "complexity",
                                                 F.col("position").cast("int"))


@register("k4_tree_listing", W_(O.files_cte()) + """,
parts AS (SELECT repository_id, path, string_split(path, '/') AS p FROM files),
dirs AS (SELECT DISTINCT repository_id, array_to_string(list_slice(p, 1, i), '/') AS node_path, true AS is_dir
         FROM parts, range(1, len(p)) AS r(i)),
nodes AS (SELECT * FROM dirs UNION ALL SELECT repository_id, path, false FROM files),
t AS (SELECT repository_id, node_path, regexp_extract(node_path, '^(.*)/[^/]*$', 1) AS parent_path,
             string_split(node_path, '/')[-1] AS name, CAST(len(string_split(node_path, '/')) - 1 AS INTEGER) AS depth,
             is_dir FROM nodes)
SELECT *, CAST(row_number() OVER (PARTITION BY repository_id, parent_path ORDER BY is_dir DESC, lower(name), name)
               AS INTEGER) AS position
FROM t""")
def q_k4(spark, sf):
    t = LS.tree_listing(LS.file_tree(P.files(spark, sf)))
    return t.select(REPO, "node_path", "parent_path", "name", F.col("depth").cast("int"), "is_dir",
                    F.col("position").cast("int"))


@register("k5_change_preview", W_(O.file_changes_cte()) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY repository_id, hash ORDER BY path, change_type) AS rn,
             count(*) OVER (PARTITION BY repository_id, hash) AS n FROM file_changes)
SELECT repository_id, hash, string_agg(path, ', ' ORDER BY rn) AS preview, CAST(greatest(max(n) - 5, 0) AS BIGINT) AS n_more
FROM r WHERE rn <= 5 GROUP BY 1, 2""")
def q_k5(spark, sf):
    return LS.change_preview(P.file_changes(spark, sf), n=5)


@register("x2_change_messages", _SNAP_SQL + """,
d AS (SELECT repository_id, path, NULL AS old_path,
             CASE WHEN d_old = d_new THEN 'unchanged' ELSE 'modified' END AS status FROM j
      WHERE d_old IS NOT NULL AND d_new IS NOT NULL
      UNION ALL SELECT repository_id, new_path, old_path, 'renamed' FROM pairs
      UNION ALL SELECT repository_id, path, NULL, 'added' FROM came c
        WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.repository_id = c.repository_id AND p.new_path = c.path)
      UNION ALL SELECT repository_id, path, NULL, 'deleted' FROM gone g
        WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.repository_id = g.repository_id AND p.old_path = g.path))
SELECT repository_id, path, status,
  CASE status WHEN 'added' THEN 'File was added in this commit:'
              WHEN 'deleted' THEN 'File was deleted in this commit. Previous content:'
              WHEN 'renamed' THEN 'File was renamed in this commit from ' || old_path
              WHEN 'unchanged' THEN 'No changes detected in this file for this commit' END AS message
FROM d""")
def q_x2(spark, sf):
    old, new = P.snapshots(spark, sf)
    return SN.classify_change(SN.snapshot_diff(old, new)).select(REPO, "path", "status", "message")


# =====================================================================================
# Known answers on inputs that reach every branch: hosted URLs, capped commits, asked names, fenced paths
# =====================================================================================

@register("p13_hosted_url", """
SELECT c_custkey, 'owner-' || CAST(c_custkey % 100 AS VARCHAR) AS owner,
       'repo' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN '.git' ELSE '' END AS repo,
       'repo' || CAST(c_custkey AS VARCHAR) AS repo_name
FROM customer""")
def q_p13_hosted(spark, sf):
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://github.com/owner-"), (k % 100).cast("string"), F.lit("/repo"), k.cast("string"),
                   F.when(k % 3 == 0, ".git").otherwise(""), F.when(k % 5 == 0, "/").otherwise(""))
    parts = X.repo_url_parts(url)
    return P.table(spark, sf, "customer").select("c_custkey", *[parts[c].alias(c) for c in ("owner", "repo", "repo_name")])


@register("p17_complexity_band", """
SELECT l_returnflag, CASE WHEN l_quantity > 10 THEN 'High' WHEN l_quantity > 5 THEN 'Medium' ELSE 'Low' END AS band,
       CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY 1, 2""")
def q_p17(spark, sf):
    li = P.table(spark, sf, "lineitem").select("l_returnflag", X.complexity_band(F.col("l_quantity")).alias("band"))
    return li.groupBy("l_returnflag", "band").agg(F.count("*").alias("n"))


@register("w2_cap_five", W_(O.file_changes_cte()) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY repository_id, hash ORDER BY path, change_type, insertions, deletions)
             AS file_no, count(*) OVER (PARTITION BY repository_id, hash) AS total_files FROM file_changes)
SELECT repository_id, hash, path, CAST(file_no AS INTEGER) AS file_no, CAST(least(total_files, 5) AS BIGINT) AS files_changed,
       CASE WHEN total_files > 5 THEN 'Display limited to 5 files' END AS note
FROM r WHERE file_no <= 5""")
def q_w2_five(spark, sf):
    return J.cap_changes(P.file_changes(spark, sf), 5).select(
        REPO, "hash", "path", F.col("file_no").cast("int"), F.col("files_changed").cast("long"), "note")


def _asked(spark, sf):
    """A question per part: two names asked about, and a path behind a code fence."""
    k = F.col("p_partkey").cast("string")
    even = F.concat(F.lit("Show me cls_"), k, F.lit(", and how does fn_"), k, F.lit(" work?"))
    odd = F.concat(F.lit("where is var_"), k, F.lit(" defined; the function go_"), k)
    fence = F.concat(F.lit("\n```py:src/f"), k, F.lit(".py\nx = 1\n```"))
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd), fence)
    return P.table(spark, sf, "part").select("p_partkey", text.alias("content"))


@register("u12_asked_names", """
SELECT p_partkey, i AS element_no,
       CASE WHEN p_partkey % 2 = 0 THEN CASE i WHEN 0 THEN 'fn_' ELSE 'cls_' END
            ELSE CASE i WHEN 0 THEN 'go_' ELSE 'var_' END END || CAST(p_partkey AS VARCHAR) AS name
FROM part, (VALUES (0), (1)) AS t(i)""")
def q_u12_asked(spark, sf):
    return TT.extract_code_elements(_asked(spark, sf), "content", ["p_partkey"]).select(
        "p_partkey", F.col("element_no").cast("int"), "name")


@register("u13_fenced_paths", "SELECT p_partkey, 'src/f' || CAST(p_partkey AS VARCHAR) || '.py' AS path FROM part")
def q_u13_fenced(spark, sf):
    return TT.extract_code_paths(_asked(spark, sf), "content", ["p_partkey"])
