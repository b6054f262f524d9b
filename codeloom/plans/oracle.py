"""DuckDB SQL for the proxy views, so every oracle query can rebuild the model tables.

These strings mirror :mod:`codeloom.sources.proxy` formula for formula.  They
are test oracles only; the library itself never parses or plans SQL.
"""

from __future__ import annotations

from codeloom.functions import exprs as X
from codeloom.sources import proxy as P


def _case(expr: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {expr} {arms} END)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def doc_dir_sql(d: str) -> str:
    return _case(f"({d}) % {len(P.PROXY_DIRS)}", P.PROXY_DIRS)


def doc_path_sql(d: str) -> str:
    special = ("CASE " + " ".join(
        f"WHEN ({d}) < {P.N_REPOS} AND ({d}) % 4 = {i} THEN '{n}'" for i, n in enumerate(P.PROXY_ROOT_NAMES))
        + " END")
    normal = f"{doc_dir_sql(d)} || 'm' || CAST({d} AS VARCHAR) || {_case(f'({d}) % {len(P.PROXY_EXTS)}', P.PROXY_EXTS)}"
    return f"coalesce({special}, {normal})"


def module_sql(d: str) -> str:
    return f"replace(replace({doc_dir_sql(d)}, '.', ''), '/', '.') || 'm' || CAST({d} AS VARCHAR)"


def python_source_sql(d: str = "doc_id", text: str = "text", n: str = "n_chars") -> str:
    i = f"CAST({d} AS VARCHAR)"
    prev = f"({d} - {P.N_REPOS})"
    return f"""('# ' || replace({text}, chr(10), chr(10) || '# ') || chr(10)
 || 'import os' || chr(10)
 || CASE WHEN {d} >= {P.N_REPOS} THEN 'import ' || {module_sql(prev)} ELSE 'import sys' END || chr(10) || chr(10)
 || 'LIMIT_' || {i} || ' = ' || CAST({n} AS VARCHAR) || chr(10) || chr(10)
 || 'def f_' || {i} || '(a, b):' || chr(10)
 || CASE WHEN {d} % 3 = 0 THEN '    \"\"\"Doc ' || {i} || '.\"\"\"' || chr(10) ELSE '' END
 || '    total = a' || chr(10)
 || repeat('    if a > 0:' || chr(10) || '        total += b' || chr(10), CAST({d} % 4 AS INTEGER))
 || '    return total' || chr(10) || chr(10)
 || 'class C_' || {i} || '(' || CASE WHEN {d} >= {P.N_REPOS} THEN 'C_' || CAST({prev} AS VARCHAR) ELSE 'object' END
 || '):' || chr(10)
 || '    def run(self, n):' || chr(10) || '        return n' || chr(10))"""


EXT_RE = r"^\.*[^.].*?(\.[^.]*)$"


def ext_sql(path: str) -> str:
    return f"regexp_extract(regexp_extract({path}, '[^/]*$', 0), '{EXT_RE}', 1)"


BINARY_LIST = ", ".join(sql_str(e) for e in X.BINARY_EXTENSIONS)


def js_source_sql(d: str = "doc_id", text: str = "text") -> str:
    i = f"CAST({d} AS VARCHAR)"
    nl = "chr(10)"
    return (f"({text} || {nl} || {nl} || 'function g_' || {i} || '(x) {{' || {nl} || '  return x;' || {nl} || '}}'"
            f" || {nl} || 'const h_' || {i} || ' = function (y) {{' || {nl} || '  return y;' || {nl} || '}};'"
            f" || {nl} || 'class K_' || {i} || ' {{' || {nl} || '}}' || {nl})")


def raw_tree_cte() -> str:
    path = doc_path_sql("doc_id")
    return f"""raw_tree AS (
  SELECT source AS repository_id, {path} AS path, doc_id,
         CASE WHEN ({path}) LIKE '%.py' THEN {python_source_sql()}
              WHEN ({path}) LIKE '%.js' THEN {js_source_sql()} ELSE text END AS text,
         n_chars AS size
  FROM documents)"""


def snapshots_cte() -> str:
    """old_snap / new_snap over ``files`` (needs files_cte first)."""
    return """old_snap AS (SELECT repository_id, path, doc_id, content FROM files WHERE doc_id % 11 <> 3),
new_snap AS (
  SELECT repository_id, CASE WHEN doc_id % 17 = 0 THEN 'moved/' || path ELSE path END AS path, doc_id,
         CASE WHEN doc_id % 13 = 0 AND doc_id % 17 <> 0 THEN content || chr(10) || 'edited line' || chr(10)
              ELSE content END AS content
  FROM files WHERE doc_id % 11 <> 5)"""


def diffs_cte() -> str:
    p = doc_path_sql("doc_id")
    body = "regexp_replace(text, '(?m)^', ' ', 'g')"
    body = f"regexp_replace({body}, '(?m)^ ([A-CE-M])', '-\\1', 'g')"
    body = f"regexp_replace({body}, '(?m)^ ([N-Z])', '+\\1', 'g')"
    body = f"regexp_replace({body}, '(?m)^ (D)', '---\\1', 'g')"
    return f"""diffs AS (
  SELECT doc_id AS diff_id,
         '--- a/' || {p} || chr(10) || '+++ b/' || {p} || chr(10) || '@@ -' || CAST(doc_id % 50 + 1 AS VARCHAR)
         || ',3 +' || CAST(doc_id % 40 + 1 AS VARCHAR) || ',3 @@' || chr(10) || {body} AS diff
  FROM documents)"""


def files_cte() -> str:
    """S1 applied to the raw tree: hidden paths dropped, binary by extension."""
    return raw_tree_cte() + f""",
files AS (
  SELECT repository_id, path, doc_id, size,
         lower({ext_sql('path')}) IN ({BINARY_LIST}) AS binary,
         CASE WHEN lower({ext_sql('path')}) IN ({BINARY_LIST}) THEN NULL ELSE text END AS content
  FROM raw_tree
  WHERE NOT regexp_matches(path, '(^|/)\\.'))"""


def commits_cte() -> str:
    return f"""commits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY author_ts DESC, hash DESC) - 1 AS BIGINT) AS seq
  FROM (SELECT 'src' || CAST(o_custkey % {P.N_REPOS} AS VARCHAR) AS repository_id,
               md5(CAST(o_orderkey AS VARCHAR)) AS hash,
               'dev' || CAST(o_custkey AS VARCHAR) AS author_name,
               'dev' || CAST(o_custkey AS VARCHAR) || '@example.com' AS author_email,
               o_orderdate AS author_ts,
               '  ' || o_orderpriority || ' update for order ' || CAST(o_orderkey AS VARCHAR)
                 || chr(10) || 'status ' || o_orderstatus || chr(10) AS message
        FROM orders) c0)"""


def file_changes_cte() -> str:
    return f"""file_changes AS (
  SELECT 'src' || CAST(o_custkey % {P.N_REPOS} AS VARCHAR) AS repository_id,
         md5(CAST(l_orderkey AS VARCHAR)) AS hash, 0 AS parent_no,
         {doc_path_sql('l_partkey')} AS path,
         CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' ELSE 'modified' END
           AS change_type,
         CAST(l_quantity AS BIGINT) AS insertions, CAST(l_linenumber AS BIGINT) AS deletions
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def messages_cte() -> str:
    return """messages AS (
  SELECT conv_id AS session_id, turn, role, text AS content FROM conversations)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
