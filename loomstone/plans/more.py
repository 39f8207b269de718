"""Further queries: what sinks write, scalar functions, joins by position, cascades, answer shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.functions import text as tx
from loomstone.operators import closure as cl
from loomstone.operators import fresh, graph, liveview, match, quality, search, shape
from loomstone.operators.match import SearchSpec
from loomstone.plans.base import EDGES, LINES, LIVE, PATHS, SQL, USES, query, trim
from loomstone.plans.core import _EDITS, _GREP, _PAIRS, _TRI, _edits, _grep, _recall
from loomstone.runtime import scratch
from loomstone.runtime import table as t
from loomstone.sources.store import Store
from loomstone.streaming import feed

S, D = SparkSession, DataFrame


# ---- what sinks write: each is stored and read back


def _stored(s: S, name: str, df: D) -> D:
    """``df`` as the table ``name`` of a new store, read back from it."""
    store = Store(s, scratch(s))
    store.write({name: df})
    return store.read(name)


@query(f"WITH {LIVE} SELECT moniker, kind, file_id, name, signature, range.start_line AS line FROM ls")
def sink_symbols(s: S, d: str) -> D:
    return _stored(s, "symbols", search.live_symbols(t(s, d, "symbols"))).select("moniker", "kind", "file_id", "name", "signature", F.col("range.start_line").alias("line"))


_STORED_EDGES = "SELECT src, dst, type, layer, cause, occ.file_id AS file_id, occ.range.start_line AS line, occ.range.start_col AS col, occ.role AS role, copy FROM e, (SELECT unnest(['by src', 'by dst']) AS copy)"


@query(f"WITH {EDGES} {_STORED_EDGES}")
def sink_edges(s: S, d: str) -> D:
    """Both copies of the edges, sorted by src and by dst."""
    store, e = Store(s, scratch(s)), graph.edge_set(t(s, d, "edges"))
    store.write({"edges": e, "edges_by_dst": e})
    both = store.read("edges").withColumn("copy", F.lit("by src")).unionByName(store.read("edges_by_dst").withColumn("copy", F.lit("by dst")))
    return both.select("src", "dst", "type", "layer", "cause", F.col("occ.file_id").alias("file_id"), F.col("occ.range.start_line").alias("line"), F.col("occ.range.start_col").alias("col"), F.col("occ.role").alias("role"), "copy")


@query("SELECT DISTINCT path, file_id, size, mtime, content_hash, source_set FROM files")
def sink_files(s: S, d: str) -> D:
    return _stored(s, "files", t(s, d, "files").distinct())


@query("""SELECT DISTINCT file_id, kind, range.start_line AS start_line, range.start_col AS start_col, range.end_line AS end_line, range.end_col AS end_col, text FROM text_units""")
def sink_text(s: S, d: str) -> D:
    u = _stored(s, "text_units", t(s, d, "text_units").select("file_id", "kind", "range", "text").distinct())
    return u.select("file_id", "kind", *[F.col(f"range.{c}").alias(c) for c in ("start_line", "start_col", "end_line", "end_col")], "text")


@query(SQL["postings_build"])
def sink_usage_postings(s: S, d: str) -> D:
    return _stored(s, "usage_postings", graph.usage_postings(t(s, d, "usages")))


@query(f"WITH {LIVE}, {_TRI} SELECT tri, moniker FROM tri")
def sink_trigrams(s: S, d: str) -> D:
    return _stored(s, "trigrams", search.trigram_postings(t(s, d, "symbols"))).select("tri", "moniker")


@query(f"SELECT DISTINCT file_id FROM usages WHERE {trim('target_name')} = 'append'")
def scan_usage_postings(s: S, d: str) -> D:
    """Files that use one exact name."""
    return t(s, d, "usages").where(tx.strip_space(F.col("target_name")) == "append").select("file_id").distinct()


@query("SELECT DISTINCT moniker, kind, flags, enclosing, file_id, name, signature, range.start_line || ':' || range.start_col || '-' || range.end_line || ':' || range.end_col AS place FROM symbols")
def dump_symbols(s: S, d: str) -> D:
    r = F.col("range")
    place = F.concat(r["start_line"].cast("string"), F.lit(":"), r["start_col"].cast("string"), F.lit("-"), r["end_line"].cast("string"), F.lit(":"), r["end_col"].cast("string"))
    return t(s, d, "symbols").distinct().select("moniker", "kind", "flags", "enclosing", "file_id", "name", "signature", place.alias("place"))


@query("SELECT DISTINCT src || ' -' || type || '-> ' || dst AS edge, layer, cause, occ.role AS role, occ.file_id AS file_id, occ.range.start_line AS line, occ.range.start_col AS col FROM edges")
def dump_edges(s: S, d: str) -> D:
    e = t(s, d, "edges").distinct()
    return e.select(F.concat("src", F.lit(" -"), "type", F.lit("-> "), "dst").alias("edge"), "layer", "cause", F.col("occ.role").alias("role"), F.col("occ.file_id").alias("file_id"), F.col("occ.range.start_line").alias("line"), F.col("occ.range.start_col").alias("col")).distinct()


@query("""SELECT 'symbols' AS tbl, count(*) AS n FROM (SELECT DISTINCT * FROM symbols) UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT * FROM edges)
UNION ALL SELECT 'usages', count(*) FROM (SELECT DISTINCT * FROM usages) UNION ALL SELECT 'text_units', count(*) FROM (SELECT DISTINCT * FROM text_units) UNION ALL SELECT 'files', count(*) FROM (SELECT DISTINCT * FROM files)""")
def stats(s: S, d: str) -> D:
    """Distinct rows of each table."""
    out = None
    for n in ("symbols", "edges", "usages", "text_units", "files"):
        one = t(s, d, n).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT path, to_json({'path': path, 'size': size, 'set': source_set})::VARCHAR AS line FROM (SELECT DISTINCT path, size, source_set FROM files)""")
def json_write(s: S, d: str) -> D:
    return t(s, d, "files").select("path", "size", "source_set").distinct().select("path", F.to_json(F.struct("path", "size", F.col("source_set").alias("set"))).alias("line"))


# ---- predicates and scalar functions


@query(f"WITH {_EDITS} SELECT DISTINCT moniker, file_id FROM symbols WHERE file_id >= 0 AND file_id NOT IN (SELECT file_id FROM ed)")
def filter_live(s: S, d: str) -> D:
    return t(s, d, "symbols").where("file_id >= 0").join(_edits(s, d), "file_id", "left_anti").select("moniker", "file_id").distinct()


@query("SELECT DISTINCT src, dst, type FROM edges WHERE type <> 'CONTAINS' AND src <> dst AND dst <> '' AND dst NOT IN ('~java.lang.Object', '~java.lang.String')")
def dep_noise_filter(s: S, d: str) -> D:
    e = t(s, d, "edges")
    return e.where((F.col("type") != "CONTAINS") & (F.col("src") != F.col("dst")) & (F.col("dst") != "") & ~F.col("dst").isin("~java.lang.Object", "~java.lang.String")).select("src", "dst", "type").distinct()


@query(r"""WITH l AS (SELECT DISTINCT file_id, range.start_line AS line, range.start_col AS col, text FROM text_units WHERE contains(text, 'limit'))
SELECT file_id, line, col, NOT regexp_matches(CASE WHEN position('limit' IN text) > 1 THEN substr(text, position('limit' IN text) - 1, 1) ELSE '' END, '[\p{L}\p{Nd}_$]') AND NOT regexp_matches(substr(text, position('limit' IN text) + 5, 1), '[\p{L}\p{Nd}_$]') AS whole FROM l""")
def whole_word(s: S, d: str) -> D:
    u = t(s, d, "text_units").where(F.contains("text", F.lit("limit"))).select("file_id", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col"), "text").distinct()
    return u.select("file_id", "line", "col", match.whole_word(F.col("text"), F.instr("text", "limit"), F.lit(5)).alias("whole"))


@query(r"SELECT file_id, decl_no, regexp_extract(header_text, '^(\s*)', 1) AS indent, trim(regexp_replace(header_text, '\s+', ' ', 'g')) AS squeezed, regexp_replace(header_text, '\s+$', '') AS cut FROM (SELECT DISTINCT file_id, decl_no, header_text FROM skim_decls)")
def string_functions(s: S, d: str) -> D:
    h = F.col("header_text")
    return t(s, d, "skim_decls").select("file_id", "decl_no", "header_text").distinct().select("file_id", "decl_no", tx.leading_space(h).alias("indent"), tx.squeeze(h).alias("squeezed"), tx.rstrip(h).alias("cut"))


@query("SELECT DISTINCT file_id, range.start_line AS line, range.start_col AS col, floor((length(text) + 3) / 4)::BIGINT AS tokens, md5(text) AS digest FROM text_units WHERE text IS NOT NULL")
def token_estimates(s: S, d: str) -> D:
    u = t(s, d, "text_units").where("text IS NOT NULL")
    return u.select("file_id", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col"), tx.estimate_tokens(F.length("text")).alias("tokens"), F.md5("text").alias("digest")).distinct()


# ---- joins by position, cascades


@query(f"""WITH {USES}, p AS (SELECT DISTINCT file_id, range.start_line AS line, range.start_col AS col FROM usages),
c AS (SELECT p.*, dst, (end_line - us.line)::BIGINT * 1000000 + end_col - us.col AS span FROM p JOIN us ON us.file_id = p.file_id
      WHERE (us.line < p.line OR us.line = p.line AND us.col <= p.col) AND (end_line > p.line OR end_line = p.line AND end_col >= p.col))
SELECT file_id, line, col, arg_min(dst, (span, dst)) AS enclosing FROM c GROUP BY ALL""")
def join_position(s: S, d: str) -> D:
    """The smallest resolved use around each use position."""
    u = graph.use_sites(t(s, d, "edges"))
    r = u.select(F.col("dst").alias("moniker"), "file_id", F.col("line").alias("sl"), F.col("col").alias("sc"), F.col("end_line").alias("el"), F.col("end_col").alias("ec"),
                 ((F.col("end_line") - F.col("line")).cast("bigint") * 1_000_000 + F.col("end_col") - F.col("col")).alias("span"))
    p = t(s, d, "usages").select("file_id", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col")).distinct()
    return graph.innermost(p, r, ["file_id", "line", "col"])


@query(f"""WITH {LIVE}, m AS (SELECT *, regexp_replace(moniker, '[^#/]*$', '') AS owner FROM ls WHERE kind IN ('METHOD', 'CONSTRUCTOR', 'FIELD', 'ENUM_CONSTANT'))
SELECT m.file_id, m.range.start_line AS line, m.range.start_col AS col, m.moniker, m.owner, o.kind AS owner_kind, o.range.start_line AS owner_line FROM m LEFT JOIN ls o ON o.moniker = m.owner""")
def owner_join(s: S, d: str) -> D:
    """Declaration position to the type that owns it, with that type's kind and place."""
    live = search.live_symbols(t(s, d, "symbols"))
    m = live.where(F.col("kind").isin("METHOD", "CONSTRUCTOR", "FIELD", "ENUM_CONSTANT")).select(
        "file_id", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col"), "moniker", F.expr("substring(moniker, 1, length(moniker) - length(regexp_extract(moniker, '([^#/]*)$', 1)))").alias("owner"))
    o = live.select(F.col("moniker").alias("owner"), F.col("kind").alias("owner_kind"), F.col("range.start_line").alias("owner_line"))
    return m.join(o, "owner", "left").select("file_id", "line", "col", "moniker", "owner", "owner_kind", "owner_line")


@query()
def bfs_first_parent(s: S, d: str) -> D:
    """The edge from its first discovered parent that finds each node, at all depths and without the cap."""
    return cl.closure(t(s, d, "edges"), cap=None).select("start", "node", "depth", "via")


_SIG = f"WITH {LIVE}, o AS (SELECT moniker FROM symbols WHERE file_id >= 0 GROUP BY moniker HAVING count(DISTINCT range) > 1), h AS (SELECT DISTINCT src AS moniker FROM edges WHERE type = 'IMPLEMENTS')"


@query(_SIG + " SELECT moniker FROM o UNION SELECT moniker FROM h")
def changed_union(s: S, d: str) -> D:
    """Symbols with an older slice at another place, or with implemented types: the union that a cascade starts from."""
    moved = t(s, d, "symbols").where("file_id >= 0").groupBy("moniker").agg(F.count_distinct("range").alias("n")).where("n > 1").select("moniker")
    return moved.unionByName(t(s, d, "edges").where(F.col("type") == "IMPLEMENTS").select(F.col("src").alias("moniker"))).distinct()


@query(f"WITH {_EDITS} SELECT DISTINCT file_id, type FROM (SELECT occ.file_id AS file_id, type FROM edges WHERE occ.file_id >= 0 AND type <> 'CONTAINS') WHERE file_id NOT IN (SELECT file_id FROM ed)")
def exclude_resolved(s: S, d: str) -> D:
    """Referring files but those just resolved."""
    r = graph.use_sites(t(s, d, "edges")).where(F.col("type") != "CONTAINS").select("file_id", "type").distinct()
    return r.join(_edits(s, d), "file_id", "left_anti")


@query(_SIG.replace("h AS", f"ow AS (SELECT DISTINCT moniker, file_id FROM symbols WHERE file_id >= 0), nm AS (SELECT DISTINCT {trim('name')} AS name FROM symbols WHERE moniker IN (SELECT moniker FROM o)), h AS") + f"""
SELECT DISTINCT ow.file_id, 'edge' AS reason FROM edges JOIN ow ON ow.moniker = src WHERE type <> 'CONTAINS' AND dst IN (SELECT moniker FROM o)
UNION SELECT ow.file_id, 'placeholder' FROM edges JOIN ow ON ow.moniker = src WHERE dst IN (SELECT name || '~UNRESOLVED' FROM nm WHERE name IS NOT NULL)
UNION SELECT file_id, 'usage' FROM usages WHERE {trim('target_name')} IN (SELECT name FROM nm WHERE name <> '')""")
def cascade_refresh(s: S, d: str) -> D:
    """All edits at once: symbols whose slices differ, and the files that they invalidate."""
    sym = t(s, d, "symbols")
    moved = sym.where("file_id >= 0").groupBy("moniker").agg(F.count_distinct("range").alias("n")).where("n > 1")
    return fresh.invalidated(moved, t(s, d, "edges"), t(s, d, "usages"), sym)


@query(f"""WITH {_EDITS}, {LIVE}, {EDGES}, mine AS (SELECT e.*, ls.file_id IS NOT NULL AND ls.file_id IN (SELECT file_id FROM ed) AS edited, coalesce(ls.file_id IN (SELECT file_id FROM ed WHERE deleted), false) AS gone FROM e LEFT JOIN ls ON ls.moniker = e.src)
SELECT layer, type, count(*) AS n FROM mine WHERE layer = 'structural' OR NOT edited OR (NOT gone AND cause IS NULL) GROUP BY ALL""")
def slice_union(s: S, d: str) -> D:
    """Structural slices and the resolved layers after the edited files were resolved again, which finds their edges without a failure."""
    e = graph.edge_set(t(s, d, "edges"))
    both = liveview.resolved_again(e, e.where("cause IS NULL"), t(s, d, "symbols"), _edits(s, d))
    return both.groupBy("layer", "type").agg(F.count(F.lit(1)).alias("n"))


# ---- quality and shape


@query(f"WITH {_PAIRS} SELECT CASE WHEN sum(wanted) = 0 THEN 1.0 ELSE sum(matched) / sum(wanted) END AS micro_recall FROM bo")
def micro_recall(s: S, d: str) -> D:
    return quality.micro_macro(_recall(s, d)).select("micro_recall")


@query(f"WITH {_PAIRS} SELECT avg(CASE WHEN wanted > 0 THEN matched / wanted END) AS macro_recall FROM bo")
def macro_recall(s: S, d: str) -> D:
    return quality.micro_macro(_recall(s, d)).select("macro_recall")


@query(_GREP + "SELECT DISTINCT path FROM g WHERE path IS NOT NULL")
def grep_files(s: S, d: str) -> D:
    """The files with a hit."""
    return _grep(s, d).where(F.col("path").isNotNull()).select("path").distinct()


@query(_GREP + "SELECT count(*) || ' matches across ' || count(DISTINCT path) || CASE WHEN count(DISTINCT path) = 1 THEN ' file' ELSE ' files' END AS shown FROM g")
def grep_count(s: S, d: str) -> D:
    """The count as it is shown."""
    n = search.count_header(_grep(s, d))
    return n.select(F.concat(F.col("total").cast("string"), F.lit(" matches across "), F.col("files").cast("string"), F.when(F.col("files") == 1, " file").otherwise(" files")).alias("shown"))


_WORDS = ("range", "limit", "cache", "session", "header", "index", "names", "lock", "files", "rows")


@query(rf"""WITH {LINES}, {PATHS}, q AS (SELECT unnest([{", ".join(f"'{w}'" for w in _WORDS)}]) AS query),
h AS (SELECT query, coalesce(path, '') AS path, line, regexp_replace(content, '\r$', '') AS snippet FROM l JOIN q ON contains(content, query) LEFT JOIN paths USING (file_id)),
pf AS (SELECT query, path, sum(length(path) + length(line::VARCHAR) + 2 + length(snippet) + 2) AS f, sum(length(path) + length(line::VARCHAR) + 2) AS l_, length(path) + length(count(*)::VARCHAR) + 3 AS r FROM h GROUP BY query, path),
sz AS (SELECT query, floor((sum(f) + 3) / 4)::BIGINT AS f, floor((sum(l_) + 3) / 4)::BIGINT AS l_, floor((sum(r) + 3) / 4)::BIGINT AS r FROM pf GROUP BY query)
SELECT query, f AS "full", l_ AS locations, r AS rollup, CASE WHEN f <= 4000 THEN 'full' WHEN l_ <= 4000 THEN 'locations' WHEN r <= 4000 THEN 'rollup' ELSE 'over' END AS rung FROM sz""".replace("\\\\r", "\\r"))
def budget_grep(s: S, d: str) -> D:
    """The rung of the budget ladder for text searches of ten words, one answer each, from one scan."""
    lines = search.text_lines(t(s, d, "text_units"))
    words = F.filter(F.array(*[F.lit(w) for w in _WORDS]), lambda w: F.contains(F.col("content"), w))
    hits = lines.select("file_id", "line", F.regexp_replace("content", "\r$", "").alias("snippet"), F.explode(words).alias("query"))
    h = match.with_path(hits, t(s, d, "files")).select("query", F.coalesce("path", F.lit("")).alias("path"), "line", "snippet")
    return shape.rung_sizes(h, "query").withColumn("rung", shape.choose_rung(shape.DEFAULT_CAP))


@query(f"WITH {LIVE}, {PATHS} SELECT moniker, coalesce(path, '?') || ':' || range.start_line || '  ' || coalesce(signature, moniker) AS shown FROM ls LEFT JOIN paths USING (file_id)")
def shape_definition(s: S, d: str) -> D:
    sym = match.with_path(search.live_symbols(t(s, d, "symbols")), t(s, d, "files"))
    return sym.select("moniker", F.concat(F.coalesce("path", F.lit("?")), F.lit(":"), F.col("range.start_line").cast("string"), F.lit("  "), schema.display(F.col("signature"), F.col("moniker"))).alias("shown"))


@query("SELECT DISTINCT walk_start, moniker, repeat('  ', greatest(coalesce(depth, 0), 0)) || lower(kind) || ' ' || coalesce(signature, regexp_replace(moniker, '^~', '')) || coalesce('  ' || file || ':' || line, '') || '  (' || lower(via) || ')' AS shown FROM hierarchy_nodes")
def shape_hierarchy(s: S, d: str) -> D:
    pad = F.repeat(F.lit("  "), F.greatest(F.coalesce("depth", F.lit(0)), F.lit(0)))
    at = F.coalesce(F.concat(F.lit("  "), "file", F.lit(":"), F.col("line").cast("string")), F.lit(""))
    return t(s, d, "hierarchy_nodes").select("walk_start", "moniker", F.concat(pad, F.lower("kind"), F.lit(" "), schema.display(F.col("signature"), F.col("moniker")), at, F.lit("  ("), F.lower("via"), F.lit(")")).alias("shown")).distinct()


@query("""SELECT tool, w AS window_start, count(*) AS calls FROM (SELECT tool, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM call_log) GROUP BY ALL""")
def sliding_windows(s: S, d: str) -> D:
    """Calls per tool in windows of an hour that start every half hour."""
    w = feed.call_windows(t(s, d, "call_log"), slide="30 minutes")
    return w.select("tool", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "calls")
