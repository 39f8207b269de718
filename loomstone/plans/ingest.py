"""Queries of extraction, the index walk, log formats and streaming rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import graph, liveview
from loomstone.plans.base import query
from loomstone.runtime import table as t
from loomstone.sources import calllog, java
from loomstone.streaming import feed

S, D = SparkSession, DataFrame
_AT = ("start_line", "start_col", "end_line", "end_col")


def _flat(df: D, *cols: str) -> D:
    return df.select(*cols, *[F.col(f"range.{c}").alias(c) for c in _AT])


@query("""SELECT DISTINCT file_id, kind, text, range.start_line AS start_line, range.start_col AS start_col, range.end_line AS end_line, range.end_col AS end_col FROM text_units
WHERE text IS NOT NULL AND NOT (range.start_line = range.end_line AND range.start_col = range.end_col)""")
def extract_text(s: S, d: str) -> D:
    """Literals and comments of the raw sources; the stored units hold the same, but for the dirty ones of one character."""
    return _flat(java.extract_text(t(s, d, "source_files")), "file_id", "kind", "text")


@query()
def extract_usages(s: S, d: str) -> D:
    return _flat(java.extract_usages(t(s, d, "source_files")), "file_id", "kind", "target_name")


@query()
def extract_skim(s: S, d: str) -> D:
    return java.extract_skim(t(s, d, "source_files"))


@query()
def extract_all(s: S, d: str) -> D:
    """All four projections from one parse of each file: how many rows of each, and what did not parse."""
    found = java.facts(t(s, d, "source_files")).distinct()
    return found.select("file_id", *[F.size(c).alias(c) for c in java.PROJECTIONS], "failure")


@query()
def extract_outline(s: S, d: str) -> D:
    return _flat(java.extract_outline(t(s, d, "source_files")), "file_id", "decl_no", "parent_no", "kind", "name")


@query("SELECT DISTINCT file_id, moniker FROM symbols WHERE file_id >= 0")
def index_walk(s: S, d: str) -> D:
    """Monikers composed from the declaration trees."""
    return graph.compose_monikers(t(s, d, "skim_decls"), t(s, d, "files")).select("file_id", "moniker").distinct()


@query(r"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts, tool, request, ok, round(latency_ms, 3) AS latency_ms, resp_bytes FROM call_log""")
def sink_calllog(s: S, d: str) -> D:
    """Each call as a JSON line, read back member by member."""
    v = calllog.call_lines(t(s, d, "call_log"))
    return v.select(F.from_json("value", "ts STRING, tool STRING, request STRING, ok BOOLEAN, latency_ms DOUBLE, resp_bytes BIGINT").alias("c")).select("c.*")


@query("SELECT file_id, seq, deleted FROM (SELECT file_id, max(mtime) AS seq, bool_or(content_hash IS NULL) AS deleted FROM files GROUP BY file_id)")
def log_replay(s: S, d: str) -> D:
    """The edit log framed with checksums, verified, cut at the first damaged record and reduced to the last edit per file."""
    rec = t(s, d, "files").groupBy("file_id").agg(F.max("mtime").alias("seq"), F.bool_or(F.col("content_hash").isNull()).alias("deleted"))
    framed = calllog.frame(rec.select("seq", F.to_json(F.struct("file_id", "deleted")).alias("payload")))
    good = liveview.valid_prefix(calllog.verified(framed))
    rows = good.select("seq", F.from_json("payload", "file_id BIGINT, deleted BOOLEAN").alias("p")).select("seq", "p.file_id", "p.deleted")
    return liveview.latest_edits(rows)


@query("SELECT tool, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS calls, (count(*) FILTER (WHERE NOT ok)) AS failed, round(sum(latency_ms), 3) AS total_ms FROM call_log GROUP BY ALL")
def call_windows(s: S, d: str) -> D:
    """Hourly calls per tool."""
    w = feed.call_windows(t(s, d, "call_log"))
    return w.select("tool", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "calls", "failed", F.round("total_ms", 3).alias("total_ms"))


@query("""WITH g AS (SELECT tool, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY tool ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM call_log),
x AS (SELECT tool, ts, sum(n) OVER (PARTITION BY tool ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g)
SELECT tool, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS calls FROM x GROUP BY tool, id""")
def call_sessions(s: S, d: str) -> D:
    w = feed.call_sessions(t(s, d, "call_log"))
    return w.select("tool", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "calls")


@query("SELECT path, max(mtime) AS mtime, arg_max(content_hash, (mtime, content_hash)) AS content_hash FROM files GROUP BY path")
def latest_state(s: S, d: str) -> D:
    """The state that the change feed keeps: the latest fingerprint of each path."""
    return feed.merge_latest(None, t(s, d, "files").select("path", "mtime", "content_hash"), "path", "mtime")


@query("""SELECT path, mtime, content_hash FROM (SELECT *, row_number() OVER w AS n, lag(content_hash) OVER w AS before FROM (SELECT DISTINCT path, mtime, content_hash FROM files)
WINDOW w AS (PARTITION BY path ORDER BY mtime, content_hash NULLS FIRST)) WHERE n = 1 OR content_hash IS DISTINCT FROM before""")
def change_feed(s: S, d: str) -> D:
    """Reports of the file table whose content differs from the one before."""
    return feed.changes(t(s, d, "files").select("path", "mtime", "content_hash"))
