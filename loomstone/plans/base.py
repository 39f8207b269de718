"""Registration of queries with their SQL, and SQL fragments used by several."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SPACE = r"[\s\p{Z}\x{85}\x{FEFF}]"


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


#: One row per declared symbol.
LIVE = """ls AS (SELECT * EXCLUDE (n_) FROM (SELECT *, row_number() OVER (PARTITION BY moniker ORDER BY file_id DESC, range DESC, signature DESC NULLS LAST, name DESC NULLS LAST) AS n_
          FROM symbols WHERE file_id >= 0) WHERE n_ = 1)"""
PATHS = "paths AS (SELECT file_id, min(path) AS path FROM files GROUP BY file_id)"
EDGES = "e AS (SELECT DISTINCT src, dst, type, layer, cause, occ FROM edges)"
USES = EDGES + """, us AS (SELECT src, dst, type, layer, cause, occ.file_id AS file_id, occ.range.start_line AS line, occ.range.start_col AS col,
       occ.range.end_line AS end_line, occ.range.end_col AS end_col, occ.role AS role FROM e WHERE occ.role <> 'NONE' AND occ.file_id >= 0),
     ok AS (SELECT * FROM us WHERE dst NOT LIKE '%~UNRESOLVED')"""
LINES = r"""lines AS (SELECT file_id, kind, range, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
       FROM (SELECT DISTINCT file_id, kind, range, text FROM text_units WHERE text IS NOT NULL)),
     l AS (SELECT file_id, kind, (range.start_line + i)::INT AS line, CASE WHEN i = 0 THEN range.start_col - 1 ELSE 0 END AS base, content FROM lines)"""
