"""Queries p2 (keys that hold most rows) and p5 (parent-child links) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import hotkeys, links
from loomstone.runtime import table


def _both(edges: DataFrame, usages: DataFrame) -> DataFrame:
    both = edges.withColumn("field", F.lit("edges.dst")).unionByName(usages.withColumn("field", F.lit("usages.target_name")))
    return both.withColumnRenamed("key", "key_value")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys holding at least 1.5 % of the rows of their table."""
    edges, usages = hotkeys.edge_keys(table(spark, sf, "edges")), hotkeys.usage_keys(table(spark, sf, "usages"))
    return _both(hotkeys.heavy_keys(edges), hotkeys.heavy_keys(usages)).select("field", "key_value")


def p2_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """uses, files and enclosing symbols of every key of both fields."""
    edges = table(spark, sf, "edges")
    found = _both(hotkeys.per_key(hotkeys.edge_keys(edges)), hotkeys.per_key(hotkeys.usage_keys(table(spark, sf, "usages")), hotkeys.places(edges)))
    return found.select("field", "key_value", "uses", "files", "enclosing_symbols")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of the enclosing links and of the stored hierarchy depths."""
    a = links.faults(table(spark, sf, "symbols")).select("fault", F.lit("").alias("walk_start"), F.col("node").alias("moniker"))
    b = links.depth_faults(table(spark, sf, "hierarchy_nodes"), table(spark, sf, "edges")).select(F.lit("depth").alias("fault"), "walk_start", "moniker")
    return a.unionByName(b)


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth and root of every symbol."""
    return links.hierarchy(table(spark, sf, "symbols"), label="name").withColumnRenamed("node", "moniker")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a symbol and one of its descendants, with their distance."""
    return links.descendants(table(spark, sf, "symbols")).withColumnRenamed("node", "moniker")


def p5_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The descendants of every symbol as one interval of preorder numbers."""
    return links.intervals(table(spark, sf, "symbols")).withColumnRenamed("node", "moniker")


QUERIES = {f.__name__: f for f in (p2_found, p2_per_key, p5_found, p5_paths, p5_descendants, p5_intervals)}

# White space of any kind at both ends; the class is spelled out because RE2 knows only ASCII in \s.
_TRIM = r"regexp_replace(target_name, '^[\s\p{Z}\x{85}\x{FEFF}]+|[\s\p{Z}\x{85}\x{FEFF}]+$', '', 'g')"

_EDGE_KEYS = "SELECT dst AS k, CASE WHEN occ.file_id >= 0 THEN occ.file_id END AS f, src AS s FROM (SELECT DISTINCT * FROM edges)"

_CHAIN = """
node AS (SELECT moniker, min(CASE WHEN enclosing <> '' THEN enclosing END) AS up, min(name) AS name FROM symbols WHERE moniker IS NOT NULL GROUP BY moniker),
reach(m, cur) AS (SELECT moniker, up FROM node WHERE up IS NOT NULL
                  UNION SELECT m, n.up FROM reach JOIN node n ON n.moniker = reach.cur WHERE n.up IS NOT NULL),
state AS (
  SELECT m AS moniker,
         CASE WHEN bool_or(m = cur) THEN 'cycle' WHEN bool_or(n.moniker IS NULL) THEN 'orphan'
              WHEN bool_or(n.up IS NULL) THEN 'rooted' ELSE 'hangs' END AS state
  FROM reach LEFT JOIN node n ON n.moniker = reach.cur GROUP BY m
  UNION ALL SELECT moniker, 'rooted' FROM node WHERE up IS NULL)"""

SQL = {
    "p2_found": f"""
WITH k AS (SELECT 'edges.dst' AS field, k FROM ({_EDGE_KEYS})
           UNION ALL SELECT 'usages.target_name', nullif({_TRIM}, '') FROM (SELECT DISTINCT * FROM usages)),
     c AS (SELECT field, k, count(*) AS n FROM k GROUP BY field, k),
     t AS (SELECT field, sum(n) AS total FROM c GROUP BY field)
SELECT field, k AS key_value FROM c JOIN t USING (field) WHERE k IS NOT NULL AND n >= 0.015 * total""",
    "p2_per_key": f"""
WITH place AS (SELECT occ.file_id AS f, occ.range.start_line AS l, occ.range.start_col AS c, min(src) AS s FROM edges WHERE occ.file_id >= 0 GROUP BY ALL),
     u AS (SELECT DISTINCT * FROM usages),
     k AS (SELECT 'edges.dst' AS field, k, f, s FROM ({_EDGE_KEYS})
           UNION ALL SELECT 'usages.target_name', nullif({_TRIM}, ''), file_id, place.s
           FROM u LEFT JOIN place ON f = file_id AND l = u.range.start_line AND c = u.range.start_col)
SELECT field, k AS key_value, count(*) AS uses, count(DISTINCT f) AS files, count(DISTINCT s) AS enclosing_symbols
FROM k WHERE k IS NOT NULL GROUP BY field, k""",
    "p5_found": f"""
WITH RECURSIVE {_CHAIN},
up AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS')),
asked AS (SELECT DISTINCT walk_start, moniker, depth FROM hierarchy_nodes),
least(s, n, d) USING KEY (s, n) AS (
  SELECT DISTINCT walk_start, walk_start, 0 FROM asked
  UNION SELECT w.s, up.dst, min(w.d) + 1 FROM least w JOIN up ON up.src = w.n LEFT JOIN recurring.least r ON r.s = w.s AND r.n = up.dst WHERE r.d IS NULL GROUP BY w.s, up.dst)
SELECT state AS fault, '' AS walk_start, moniker FROM state WHERE state <> 'rooted'
UNION ALL
SELECT DISTINCT 'depth', walk_start, moniker FROM asked LEFT JOIN least ON s = walk_start AND n = moniker
WHERE depth IS NULL OR d IS NULL OR depth <> d""",
    "p5_paths": f"""
WITH RECURSIVE {_CHAIN},
path(m, cur, d, root, path) AS (
  SELECT moniker, moniker, 0, moniker, coalesce(name, '?') FROM node JOIN state USING (moniker) WHERE state IN ('rooted', 'orphan')
  UNION ALL
  SELECT m, p.moniker, d + 1, p.moniker, coalesce(p.name, '?') || '/' || path FROM path JOIN node c ON c.moniker = path.cur JOIN node p ON p.moniker = c.up)
SELECT moniker, state, d AS depth, root, path
FROM state LEFT JOIN (SELECT m, max(d)::BIGINT AS d, arg_max(root, d) AS root, arg_max(path, d) AS path FROM path GROUP BY m) ON m = moniker""",
    "p5_descendants": f"""
WITH RECURSIVE {_CHAIN},
path(m, cur, d) AS (
  SELECT moniker, moniker, 0 FROM node JOIN state USING (moniker) WHERE state IN ('rooted', 'orphan')
  UNION ALL SELECT m, c.up, d + 1 FROM path JOIN node c ON c.moniker = path.cur WHERE c.up IN (SELECT moniker FROM node))
SELECT cur AS moniker, m AS descendant, d::BIGINT AS distance FROM path WHERE d > 0""",
}
