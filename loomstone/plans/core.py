"""Queries of the relational operators: scans, matching, search, graph, live view, freshness, quality, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.functions import text as tx
from loomstone.operators import closure as cl
from loomstone.operators import fresh, graph, liveview, match, quality, search, shape
from loomstone.operators.ids import dense_ids
from loomstone.operators.match import SearchSpec
from loomstone.plans.base import EDGES, LINES, LIVE, PATHS, SPACE, USES, query, trim
from loomstone.runtime import table as t

S, D = SparkSession, DataFrame
big = lambda c: F.col(c).cast("bigint").alias(c)

# ---- scans and postings


@query(f"WITH {LIVE} SELECT moniker, kind, flags, enclosing, file_id, name, signature, range.start_line AS start_line FROM ls")
def scan_symbols(s: S, d: str) -> D:
    return search.live_symbols(t(s, d, "symbols")).select("moniker", "kind", "flags", "enclosing", "file_id", "name", "signature", F.col("range.start_line").alias("start_line"))


@query(f"WITH {EDGES} SELECT src, type, count(*) AS edges, count(DISTINCT dst) AS targets FROM e GROUP BY ALL")
def scan_edges_fwd(s: S, d: str) -> D:
    return graph.edge_set(t(s, d, "edges")).groupBy("src", "type").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("dst").alias("targets"))


@query(f"WITH {EDGES} SELECT dst, type, count(*) AS edges, count(DISTINCT src) AS sources FROM e GROUP BY ALL")
def scan_edges_rev(s: S, d: str) -> D:
    cells = graph.edge_set(t(s, d, "edges")).groupBy("dst", "type", "src").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("dst", "type").agg(F.sum("n").alias("edges"), F.count("src").alias("sources"))


@query("SELECT file_id, kind, count(*) AS units, sum(length(text))::BIGINT AS chars FROM (SELECT DISTINCT * FROM text_units) GROUP BY ALL")
def scan_text(s: S, d: str) -> D:
    return t(s, d, "text_units").distinct().groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("text")).alias("chars"))


@query("SELECT path, file_id, max(size) AS size, max(mtime) AS mtime, max(content_hash) AS content_hash, max(source_set) AS source_set FROM files GROUP BY path, file_id")
def scan_files(s: S, d: str) -> D:
    return t(s, d, "files").groupBy("path", "file_id").agg(*[F.max(c).alias(c) for c in ("size", "mtime", "content_hash", "source_set")])


@query(f"""SELECT target_name, count(*) AS n_files, list_sort(list(file_id)) AS file_ids
FROM (SELECT DISTINCT {trim('target_name')} AS target_name, file_id FROM usages) WHERE target_name <> '' GROUP BY target_name""")
def postings_build(s: S, d: str) -> D:
    return graph.usage_postings(t(s, d, "usages"))


_TRI = f"""tri AS (SELECT DISTINCT moniker, substr(name, i::INT, 3) AS tri FROM (SELECT moniker, name, unnest(range(1, greatest(length(name) - 1, 1))) AS i
          FROM (SELECT moniker, {trim('name')} AS name FROM ls)) WHERE length(name) >= 3)"""


@query(f"WITH {LIVE}, {_TRI} SELECT tri, count(*) AS entries FROM tri GROUP BY tri")
def scan_trigrams(s: S, d: str) -> D:
    return search.trigram_postings(t(s, d, "symbols")).groupBy("tri").agg(F.count("moniker").alias("entries"))


@query(f"WITH {LIVE}, {_TRI} SELECT moniker, count(*) AS trigrams FROM tri GROUP BY moniker")
def distinct_trigrams(s: S, d: str) -> D:
    return search.trigram_postings(t(s, d, "symbols")).groupBy("moniker").agg(F.count("tri").alias("trigrams"))


@query(f"""WITH {LIVE}, {_TRI} SELECT moniker FROM tri WHERE tri IN ('Led', 'edg', 'dge', 'ger') GROUP BY moniker HAVING count(*) = 4""")
def trigram_intersect(s: S, d: str) -> D:
    return search.trigram_candidates(search.trigram_postings(t(s, d, "symbols")), "Ledger")


@query(f"""SELECT 'duplicate' AS rule, moniker FROM symbols GROUP BY moniker HAVING count(DISTINCT file_id) > 1
UNION ALL SELECT DISTINCT 'dangling', moniker FROM symbols WHERE enclosing <> '' AND enclosing NOT IN (SELECT moniker FROM symbols)""")
def sink_symbols_check(s: S, d: str) -> D:
    """What the symbol sink refuses."""
    return schema.violations(t(s, d, "symbols"))


# ---- predicates


_HITS = "WITH {lines} SELECT file_id, kind, line, (base + position({find} IN content))::INT AS col, content AS snippet FROM l WHERE {cond}"


def _text(s: S, d: str, spec: SearchSpec) -> D:
    return search.text_hits(t(s, d, "text_units"), spec).select("file_id", "kind", "line", "col", F.regexp_replace("snippet", "\r$", "").alias("snippet"))


def _hits(cond: str, find: str) -> str:
    return "WITH " + LINES + rf" SELECT file_id, kind, line, (base + position({find} IN content))::INT AS col, regexp_replace(content, '\r$', '') AS snippet FROM l WHERE {cond}"


@query(_hits("contains(content, 'range')", "'range'"))
def match_literal(s: S, d: str) -> D:
    return _text(s, d, SearchSpec("range"))


@query(_hits("regexp_matches(content, 're[a-z]+s the')", "regexp_extract(content, 're[a-z]+s the')"))
def match_regex(s: S, d: str) -> D:
    return _text(s, d, SearchSpec("re[a-z]+s the"))


@query(_hits("regexp_matches(content, '[Tt][Hh][Ee] [Ff][Ii][Ll][Ee]')", "regexp_extract(content, '[Tt][Hh][Ee] [Ff][Ii][Ll][Ee]')"))
def match_icase(s: S, d: str) -> D:
    return _text(s, d, SearchSpec("the file", case_sensitive=False))


@query(_hits("contains(content, '{@code')", "'{@code'"))
def match_fixed(s: S, d: str) -> D:
    return _text(s, d, SearchSpec("{@code", fixed=True))


@query("SELECT file_id, kind, 0 AS line, 0 AS col, text AS snippet FROM text_units WHERE false")
def empty_pattern(s: S, d: str) -> D:
    return _text(s, d, SearchSpec("  "))


@query(f"WITH {LIVE} SELECT moniker, file_id FROM ls WHERE kind = 'RECORD'")
def filter_kind(s: S, d: str) -> D:
    return search.live_symbols(t(s, d, "symbols")).where(F.col("kind") == "RECORD").select("moniker", "file_id")


@query(r"SELECT DISTINCT path, file_id FROM files WHERE regexp_matches(path, '^(index|probe)/.*/[^/]*Ledger[^/]*\.java$')")
def filter_path_glob(s: S, d: str) -> D:
    return t(s, d, "files").where(match.path_matches(F.col("path"), "{index,probe}/**/*Ledger*.java")).select("path", "file_id").distinct()


@query("SELECT DISTINCT src, dst, type, CASE type WHEN 'EXTENDS' THEN 5 WHEN 'IMPLEMENTS' THEN 6 ELSE 7 END AS type_ord FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS', 'OVERRIDES')")
def filter_hierarchy(s: S, d: str) -> D:
    return graph.hierarchy_edges(t(s, d, "edges"))


@query(f"WITH {USES} SELECT src, dst, type, file_id, line, col, role FROM us")
def filter_use_sites(s: S, d: str) -> D:
    return graph.use_sites(t(s, d, "edges")).select("src", "dst", "type", "file_id", "line", "col", "role")


_PATH = r"list_filter(string_split_regex(regexp_replace(regexp_replace(moniker, '\([^()]*\)\.?$', ''), '^~', ''), '[/#.]'), lambda x: x <> '')"


@query(f"WITH {LIVE}, p AS (SELECT moniker, {_PATH} AS p FROM ls) SELECT moniker FROM p WHERE p[-1] = 'run'")
def qualified_match(s: S, d: str) -> D:
    return graph.select_declarations(t(s, d, "symbols"), "run").select("moniker")


@query(f"WITH {LIVE}, p AS (SELECT moniker, {_PATH} AS p FROM ls) SELECT a.moniker, count(*) AS selected FROM p a JOIN p b ON a.p[-2:] = b.p[-2:] GROUP BY a.moniker")
def qualified_match_all(s: S, d: str) -> D:
    """For each symbol, how many its two-part qualified name selects."""
    p = search.live_symbols(t(s, d, "symbols")).select("moniker", match.name_path(F.col("moniker")).alias("p"))
    p = p.withColumn("tail", F.slice("p", F.greatest(F.size("p") - 1, F.lit(1)), 2))
    n = p.groupBy("tail").agg(F.count(F.lit(1)).alias("selected"))
    return p.join(n, "tail").select("moniker", "selected")


@query(f"WITH {LIVE} SELECT moniker, kind FROM ls WHERE {trim('name')} = 'apply'")
def decl_exact_name(s: S, d: str) -> D:
    return search.live_symbols(t(s, d, "symbols")).where(tx.strip_space(F.col("name")) == "apply").select("moniker", "kind")


@query("""SELECT kind, CASE kind WHEN 'CALL' THEN 'CALLS' WHEN 'METHOD_REF' THEN 'CALLS' WHEN 'INSTANTIATION' THEN 'INSTANTIATES' WHEN 'ANNOTATION' THEN 'ANNOTATED_BY' ELSE 'REFERENCES' END AS edge_type,
CASE WHEN kind IN ('CALL', 'METHOD_REF', 'INSTANTIATION') THEN 'CALL' WHEN kind IN ('TYPE_REF', 'ANNOTATION') THEN 'TYPEREF' ELSE 'READ' END AS role, count(*) AS n
FROM (SELECT DISTINCT * FROM usages) GROUP BY ALL""")
def role_map(s: S, d: str) -> D:
    u = t(s, d, "usages").distinct()
    return u.groupBy("kind", schema.edge_type_of(F.col("kind")).alias("edge_type"), schema.role_of(F.col("kind")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LIVE} SELECT moniker, coalesce(signature, regexp_replace(moniker, '^~', '')) AS shown, CASE WHEN flags & 1 <> 0 THEN 'TEST' ELSE 'MAIN' END AS source_set FROM ls")
def display(s: S, d: str) -> D:
    return search.live_symbols(t(s, d, "symbols")).select("moniker", schema.display(F.col("signature"), F.col("moniker")).alias("shown"), schema.source_set(F.col("flags")).alias("source_set"))


@query("""WITH r AS (SELECT DISTINCT regexp_extract(path, '^(.*/src/[^/]+/java)/', 1) AS root, source_set FROM files), p AS (SELECT DISTINCT path FROM files)
SELECT p.path, coalesce(arg_max(r.source_set, length(root)), 'MAIN') AS source_set FROM p LEFT JOIN r ON root <> '' AND starts_with(p.path, root || '/') GROUP BY p.path""")
def classify_root(s: S, d: str) -> D:
    """The source set of the longest root above each path: paths are exploded to their ancestors and meet roots by equality."""
    f = t(s, d, "files")
    roots = f.select(F.regexp_extract("path", "^(.*/src/[^/]+/java)/", 1).alias("root"), "source_set").where("root <> ''").groupBy("root").agg(F.max("source_set").alias("source_set"))
    parts = F.split("path", "/")
    up = f.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    best = F.max_by("source_set", F.when(F.col("source_set").isNotNull(), F.length("root")))
    return up.join(roots, "root", "left").groupBy("path").agg(F.coalesce(best, F.lit("MAIN")).alias("source_set"))


@query("""SELECT cause, failure, count(*) AS n FROM (SELECT cause, CASE cause WHEN 'AMBIGUOUS_OVERLOAD' THEN 'OVERLOAD_AMBIGUITY' WHEN 'STACK_OVERFLOW' THEN 'GENERICS_INFERENCE'
WHEN 'LAMBDA_CONTEXT' THEN 'LAMBDA_METHODREF' ELSE CASE WHEN regexp_matches(regexp_replace(dst, '~UNRESOLVED$', ''), '^[a-z]\\w*$') AND cause = 'MISSING_CLASSPATH' THEN 'NON_SYMBOL_QUALIFIER' WHEN cause IN ('MISSING_CLASSPATH', 'UNSOLVED_SYMBOL') THEN 'MISSING_CLASSPATH' ELSE 'OTHER' END END AS failure
FROM (SELECT DISTINCT * FROM edges) WHERE cause IS NOT NULL) GROUP BY ALL""".replace("\\\\", "\\"))
def classify_failure(s: S, d: str) -> D:
    """The failure cascade over the unresolved edges, whose recorded cause stands for the failure's facts."""
    e = graph.edge_set(t(s, d, "edges")).where(F.col("cause").isNotNull())
    c, no = F.col("cause"), F.lit(False)
    name = F.regexp_replace("dst", "~UNRESOLVED$", "")
    exception = F.when(c == "AMBIGUOUS_OVERLOAD", "MethodAmbiguityException").when(c.isin("MISSING_CLASSPATH", "UNSOLVED_SYMBOL"), "UnsolvedSymbolException").otherwise("Other")
    message = F.when(c == "MISSING_CLASSPATH", F.concat(F.lit("Unsolved symbol : "), name))
    kind = quality.classify_failure(exception, message, c == "STACK_OVERFLOW", c == "LAMBDA_CONTEXT", no, no, no)
    return e.groupBy("cause", kind.alias("failure")).agg(F.count(F.lit(1)).alias("n"))


# ---- search


_RANKED = f"""WITH {LIVE}, {PATHS}, h AS (SELECT moniker, kind, {trim('name')} AS name, signature, file_id, range.start_line AS line FROM ls),
r AS (SELECT *, CASE WHEN name = 'add' THEN 0 WHEN starts_with(name, 'add') THEN 1 WHEN contains(name, 'add') THEN 2 ELSE 3 END AS tier FROM h WHERE contains(name, 'add'))
SELECT moniker, kind, name, path, line, tier FROM r LEFT JOIN paths USING (file_id)"""


@query(_RANKED + " ORDER BY tier, length(name), name, moniker LIMIT 50")
def limit_rank(s: S, d: str) -> D:
    return search.search_symbols(t(s, d, "symbols"), t(s, d, "files"), SearchSpec("add")).select("moniker", "kind", "name", "path", "line", "tier")


@query(_RANKED)
def rank_symbols(s: S, d: str) -> D:
    """All hits with their tier."""
    return match.with_path(search.symbol_hits(t(s, d, "symbols"), SearchSpec("add")), t(s, d, "files")).select("moniker", "kind", "name", "path", "line", "tier")


@query(f"WITH {LIVE} SELECT row_number() OVER (ORDER BY tier, length(name), name, moniker) - 1 AS rank, moniker FROM (SELECT moniker, {trim('name')} AS name, CASE WHEN {trim('name')} = 'Slice' THEN 0 WHEN starts_with({trim('name')}, 'Slice') THEN 1 ELSE 2 END AS tier FROM ls) WHERE contains(name, 'S')".replace("'Slice'", "'S'"))
def rank_symbols_base(s: S, d: str) -> D:
    """Positions of all hits in rank order, numbered without one task that holds them all."""
    return dense_ids(search.symbol_hits(t(s, d, "symbols"), SearchSpec("S")), *search.rank(), name="rank").select("rank", "moniker")


@query(f"WITH {LIVE} SELECT count(*) AS total, least(count(*), 50) AS shown FROM ls WHERE contains({trim('name')}, 'add')")
def honest_total(s: S, d: str) -> D:
    return search.symbol_hits(t(s, d, "symbols"), SearchSpec("add")).agg(F.count(F.lit(1)).alias("total")).select("total", F.least("total", F.lit(50)).cast("bigint").alias("shown"))


_WORD = r"[\p{L}\p{Nd}_$]"
_GREP = f"""WITH {LIVE}, {PATHS}, {LINES},
sy AS (SELECT 0 AS part, file_id, kind, range.start_line AS line, NULL::INT AS col, NULL::BOOLEAN AS whole_word, signature AS snippet,
       CASE WHEN {trim('name')} = 'range' THEN 0 WHEN starts_with({trim('name')}, 'range') THEN 1 ELSE 2 END AS tier, {trim('name')} AS name, moniker
       FROM ls WHERE contains({trim('name')}, 'range')),
tx AS (SELECT 1 AS part, file_id, kind, line, (base + position('range' IN content))::INT AS col,
       NOT regexp_matches(CASE WHEN position('range' IN content) > 1 THEN substr(content, position('range' IN content) - 1, 1) ELSE '' END, '{_WORD}')
       AND NOT regexp_matches(substr(content, position('range' IN content) + 5, 1), '{_WORD}') AS whole_word,
       regexp_replace(content, '\\r$', '') AS snippet, NULL::INT AS tier, NULL AS name, NULL AS moniker FROM l WHERE contains(content, 'range')),
g AS (SELECT x.*, path FROM (SELECT * FROM sy UNION ALL SELECT * FROM tx) x LEFT JOIN paths USING (file_id))
""".replace("\\\\r", "\\r")


def _grep(s: S, d: str) -> D:
    return search.grep(t(s, d, "symbols"), t(s, d, "text_units"), t(s, d, "files"), SearchSpec("range"))


@query(_GREP + "SELECT part, path, kind, line, col, whole_word, snippet, moniker FROM g")
def tier_concat(s: S, d: str) -> D:
    """All hits of a search over symbols and text."""
    return _grep(s, d).select("part", "path", "kind", "line", "col", "whole_word", "snippet", "moniker")


@query(_GREP + "SELECT part, path, kind, line, col, moniker FROM g ORDER BY part, tier, length(name), name, moniker, whole_word DESC, path, line, col, kind LIMIT 50")
def grep_content(s: S, d: str) -> D:
    return _grep(s, d).orderBy(*search.grep_rank()).limit(50).select("part", "path", "kind", "line", "col", "moniker")


@query(_GREP + "SELECT path, count(*) AS hits, count_if(part = 0)::BIGINT AS symbols, count_if(part = 1)::BIGINT AS text FROM g GROUP BY path")
def grep_per_file(s: S, d: str) -> D:
    return search.per_file(_grep(s, d)).select("path", "hits", "symbols", "text")


@query(_GREP + "SELECT count(*) AS total, count_if(part = 0)::BIGINT AS symbols, count_if(part = 1)::BIGINT AS text, count(DISTINCT path) AS files FROM g")
def count_header(s: S, d: str) -> D:
    return search.count_header(_grep(s, d))


@query(_GREP + """SELECT part, path, line, col, kind FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY part, tier, length(name), name, moniker, whole_word DESC, path, line, col, kind) AS n FROM g)
WHERE n = 1 ORDER BY part, tier, length(name), name, moniker, whole_word DESC, path, line, col, kind LIMIT 5""")
def one_per_file(s: S, d: str) -> D:
    return search.one_per_file(_grep(s, d)).select("part", "path", "line", "col", "kind")


@query(_GREP + "SELECT file_id, kind, line, col, whole_word FROM g WHERE part = 1")
def rank_text(s: S, d: str) -> D:
    return search.text_hits(t(s, d, "text_units"), SearchSpec("range")).select("file_id", "kind", "line", "col", "whole_word")


@query(f"""WITH m AS (SELECT file_id, kind, range, text, regexp_extract(text, 'the[^a-z]+file') AS m FROM (SELECT DISTINCT file_id, kind, range, text FROM text_units) WHERE regexp_matches(text, 'the[^a-z]+file')),
p AS (SELECT file_id, kind, range, string_split(text[:position(m IN text) - 1], chr(10)) AS lead FROM m)
SELECT file_id, kind, range.start_line AS unit_line, (range.start_line + len(lead) - 1)::INT AS line,
       (CASE WHEN len(lead) = 1 THEN range.start_col + length(lead[-1]) ELSE length(lead[-1]) + 1 END)::INT AS col FROM p""")
def line_dedup(s: S, d: str) -> D:
    """A pattern whose matches may cross lines; the first match on each line of each unit. The SQL finds only the first of a unit."""
    u = t(s, d, "text_units")
    hits = search.text_hits(u.select("file_id", "kind", "range", "text"), SearchSpec("the[^a-z]+file"))
    starts = u.select("file_id", "kind", "range").distinct().select("file_id", "kind", F.col("range.start_line").alias("unit_line"), F.col("range.start_col").alias("uc"), F.col("range.end_line").alias("unit_end"), F.col("range.end_col").alias("ue"))
    inside = ((F.col("line") > F.col("unit_line")) | (F.col("col") >= F.col("uc"))) & ((F.col("line") < F.col("unit_end")) | (F.col("col") <= F.col("ue")))
    j = hits.join(starts, ["file_id", "kind"]).where((F.col("line") >= F.col("unit_line")) & (F.col("line") <= F.col("unit_end")) & inside)
    return j.groupBy("file_id", "kind", "unit_line", "uc", "line").agg(F.min("col").alias("col")).select("file_id", "kind", "unit_line", "line", "col")


# ---- graph


@query(f"WITH {EDGES}, {LIVE} SELECT e.dst, e.type, ls.kind, coalesce(ls.signature, regexp_replace(e.dst, '^~', '')) AS shown, count(*) AS n FROM e LEFT JOIN ls ON ls.moniker = e.dst GROUP BY ALL")
def join_edge_symbol(s: S, d: str) -> D:
    n = graph.edge_set(t(s, d, "edges")).groupBy("dst", "type").agg(F.count(F.lit(1)).alias("n"))
    sym = search.live_symbols(t(s, d, "symbols")).select(F.col("moniker").alias("dst"), "kind", "signature")
    return n.join(sym, "dst", "left").select("dst", "type", "kind", schema.display(F.col("signature"), F.col("dst")).alias("shown"), "n")


@query(f"WITH {USES}, {PATHS} SELECT path, role, count(*) AS n FROM us LEFT JOIN paths USING (file_id) GROUP BY ALL")
def join_hit_file(s: S, d: str) -> D:
    n = graph.use_sites(t(s, d, "edges")).groupBy("file_id", "role").agg(F.count(F.lit(1)).alias("n"))
    return match.with_path(n, t(s, d, "files")).select("path", "role", "n")


_FILE_LINES = r"""fl AS (SELECT file_id, unnest(string_split_regex(text, '\r\n|\n|\r')) AS content, generate_subscripts(string_split_regex(text, '\r\n|\n|\r'), 1)::INT AS line FROM (SELECT DISTINCT * FROM source_files))"""


@query(f"WITH {LIVE}, {_FILE_LINES} SELECT moniker, coalesce(signature, moniker) AS shown, kind, ls.file_id, range.start_line AS line, regexp_replace(content, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS snippet FROM ls LEFT JOIN fl ON fl.file_id = ls.file_id AND fl.line = range.start_line")
def find_definition(s: S, d: str) -> D:
    """Declaration site and trimmed source line of every symbol."""
    return graph.definitions(t(s, d, "symbols"), t(s, d, "source_files"))


@query("SELECT DISTINCT dst AS moniker, regexp_replace(dst, '^~', '') AS shown FROM edges WHERE dst LIKE '~%'")
def find_definition_external(s: S, d: str) -> D:
    return graph.external_definitions(t(s, d, "edges"), t(s, d, "symbols"))


@query(f"WITH {USES}, {_FILE_LINES} SELECT src, dst, us.file_id, us.line, col, regexp_replace(content, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS snippet FROM us LEFT JOIN fl ON fl.file_id = us.file_id AND fl.line = us.line")
def join_snippet(s: S, d: str) -> D:
    u = graph.use_sites(t(s, d, "edges")).select("src", "dst", "file_id", "line", "col")
    return u.join(graph.lines_at(t(s, d, "source_files"), u), ["file_id", "line"], "left").select("src", "dst", "file_id", "line", "col", tx.java_trim(F.col("content")).alias("snippet"))


_INNER = f"""u AS (SELECT DISTINCT file_id, range.start_line AS line, range.start_col AS col, kind, {trim('target_name')} AS target_name FROM usages),
c AS (SELECT u.*, ls.moniker, (range.end_line - range.start_line)::BIGINT * 1000000 + range.end_col - range.start_col AS span FROM u JOIN ls ON ls.file_id = u.file_id
      WHERE (range.start_line < line OR range.start_line = line AND range.start_col <= col) AND (range.end_line > line OR range.end_line = line AND range.end_col >= col))"""


@query(f"WITH {LIVE}, {_INNER} SELECT file_id, line, col, kind, target_name, arg_min(moniker, (span, moniker)) AS enclosing FROM c GROUP BY ALL")
def join_enclosing(s: S, d: str) -> D:
    """The innermost declaration around every use site."""
    return graph.enclosing_of_usages(t(s, d, "usages"), t(s, d, "symbols"))


@query(f"""WITH {LIVE}, {USES}, pl AS (SELECT file_id, line, col, dst, end_col - col AS width, row_number() OVER (PARTITION BY file_id, line, col ORDER BY CASE WHEN role = 'CALL' THEN 0 ELSE 1 END, end_line, end_col, dst) AS n FROM us)
SELECT pl.file_id, line, col, dst, ls.file_id AS def_file, ls.range.start_line AS def_line FROM pl LEFT JOIN ls ON ls.moniker = dst WHERE n = 1""")
def find_definition_at(s: S, d: str) -> D:
    """Position to declaration for every use position: a call first, else a type; the smallest use there."""
    u = graph.use_sites(t(s, d, "edges"))
    first = F.min(F.struct((F.col("role") != "CALL").cast("int").alias("o"), "end_line", "end_col", "dst"))
    at = u.groupBy("file_id", "line", "col").agg(first["dst"].alias("dst"))
    sym = search.live_symbols(t(s, d, "symbols")).select(F.col("moniker").alias("dst"), F.col("file_id").alias("def_file"), F.col("range.start_line").alias("def_line"))
    return at.join(sym, "dst", "left").select("file_id", "line", "col", "dst", "def_file", "def_line")


@query(f"WITH {USES} SELECT dst AS target, src AS enclosing, count(*) AS n, list_sort(list([line, col])) AS places FROM ok GROUP BY dst, src")
def group_refs(s: S, d: str) -> D:
    return graph.reference_groups(t(s, d, "edges")).select("target", "enclosing", "n", F.transform("refs", lambda r: F.array(r["line"], r["col"])).alias("places"))


@query(f"WITH {USES} SELECT dst AS target, count(*) AS refs, count(DISTINCT file_id) AS files, count(DISTINCT src) AS groups FROM ok GROUP BY dst")
def count_refs(s: S, d: str) -> D:
    return graph.reference_counts(t(s, d, "edges"))


@query(f"WITH {USES} SELECT dst AS target, file_id, count(*) AS refs, min(line) AS first_line FROM ok GROUP BY dst, file_id")
def rollup_by_file(s: S, d: str) -> D:
    return graph.reference_rollup(t(s, d, "edges"))


@query(f"WITH {USES} SELECT regexp_replace(dst, '~UNRESOLVED$', '') AS name, file_id, line, col, src, cause FROM us WHERE dst LIKE '%~UNRESOLVED'")
def tail_order(s: S, d: str) -> D:
    """The unconfirmed tail of every name."""
    return graph.unconfirmed(t(s, d, "edges"))


@query(f"WITH {LIVE}, {USES}, p AS (SELECT moniker, {_PATH} AS p FROM ls) SELECT dst, src, file_id, line, col, 'confirmed' AS part FROM ok WHERE dst IN (SELECT moniker FROM p WHERE p[-1] = 'run') UNION ALL SELECT 'run', src, file_id, line, col, 'tail' FROM us WHERE dst = 'run~UNRESOLVED'")
def find_references(s: S, d: str) -> D:
    """All overloads that a typed name selects, and one tail for the shared name."""
    refs, tail = graph.find_references(t(s, d, "edges"), t(s, d, "symbols"), "run")
    return refs.select("dst", "src", "file_id", "line", "col", F.lit("confirmed").alias("part")).unionByName(tail.select(F.col("name").alias("dst"), "src", "file_id", "line", "col", F.lit("tail").alias("part")))


@query(f"WITH {USES} SELECT src AS caller, dst AS callee, count(*) AS calls FROM ok WHERE type = 'CALLS' GROUP BY ALL")
def call_hierarchy(s: S, d: str) -> D:
    return graph.call_hierarchy(t(s, d, "edges"))


@query("SELECT src AS moniker, dst AS supertype, type AS via FROM (SELECT DISTINCT src, dst, type FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS'))")
def supertypes(s: S, d: str) -> D:
    return graph.hierarchy_edges(t(s, d, "edges")).where(F.col("type") != "OVERRIDES").select(F.col("src").alias("moniker"), F.col("dst").alias("supertype"), F.col("type").alias("via"))


@query("SELECT dst AS moniker, count(*) AS subtypes, count(DISTINCT src) AS distinct_subtypes FROM (SELECT DISTINCT src, dst, type FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS')) GROUP BY dst")
def subtypes(s: S, d: str) -> D:
    h = graph.hierarchy_edges(t(s, d, "edges")).where(F.col("type") != "OVERRIDES")
    return h.groupBy("dst", "src").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("dst").alias("moniker")).agg(F.sum("n").alias("subtypes"), F.count("src").alias("distinct_subtypes"))


_CLOSURE = """WITH RECURSIVE h AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS') AND src <> dst),
w(s, n, d) USING KEY (s, n) AS (SELECT DISTINCT a, a, 0 FROM h
  UNION SELECT w.s, h.b, min(w.d) + 1 FROM w JOIN h ON h.a = w.n LEFT JOIN recurring.w r ON r.s = w.s AND r.n = h.b WHERE r.d IS NULL GROUP BY w.s, h.b)
SELECT s AS start, n AS node, d AS depth FROM w WHERE d > 0"""


@query(_CLOSURE.format(a="src", b="dst"))
def supertypes_transitive(s: S, d: str) -> D:
    return cl.closure(t(s, d, "edges")).select("start", "node", "depth")


@query(_CLOSURE.format(a="dst", b="src"))
def subtypes_transitive(s: S, d: str) -> D:
    """All subtypes of every start, without the cap."""
    return cl.closure(t(s, d, "edges"), up=False, cap=None).select("start", "node", "depth")


@query()
def node_cap(s: S, d: str) -> D:
    """First 5 nodes of each walk, with via and whether there were more."""
    return cl.closure(t(s, d, "edges"), cap=5)


@query(f"""WITH RECURSIVE {LIVE}, c(m, cur) AS (SELECT moniker, enclosing FROM ls WHERE kind NOT IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'ANNOTATION') AND enclosing <> ''
  UNION SELECT m, ls.enclosing FROM c JOIN ls ON ls.moniker = cur WHERE ls.kind NOT IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'ANNOTATION') AND ls.enclosing <> ''),
f AS (SELECT m, cur FROM c JOIN ls ON ls.moniker = cur WHERE ls.kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'ANNOTATION'))
SELECT moniker, CASE WHEN kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'ANNOTATION') THEN moniker ELSE f.cur END AS anchor FROM ls LEFT JOIN f ON f.m = moniker""")
def contains_closure(s: S, d: str) -> D:
    """The nearest type around every symbol."""
    return graph.anchors(t(s, d, "symbols"))


@query(f"""WITH {LIVE} SELECT file_id, range.start_line AS line, moniker, (len(list_filter(string_split_regex(regexp_replace(moniker, '\\([^()]*\\)', '', 'g'), '[#.]'), lambda x: x <> '')) - 1)::INT AS depth,
repeat('  ', len(list_filter(string_split_regex(regexp_replace(moniker, '\\([^()]*\\)', '', 'g'), '[#.]'), lambda x: x <> '')) - 1) || lower(kind) || ' ' || coalesce({trim('name')}, '?') AS shown FROM ls""")
def outline(s: S, d: str) -> D:
    return graph.outline(t(s, d, "symbols"))


_OWNER = r"regexp_replace(moniker, '[^#/]*$', '') AS owner, regexp_extract(moniker, '([^#/]*)$', 1) AS tail"


@query(f"WITH {LIVE}, m AS (SELECT moniker, {_OWNER} FROM ls WHERE kind = 'METHOD'), h AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS') AND src <> dst) SELECT DISTINCT a.moniker AS src, b.moniker AS dst FROM m a JOIN h ON h.src = a.owner JOIN m b ON b.owner = h.dst AND b.tail = a.tail")
def overrides_match(s: S, d: str) -> D:
    return graph.overrides(t(s, d, "edges"), t(s, d, "symbols"))


@query("""SELECT row_number() OVER (ORDER BY type_ord, dst, src) - 1 AS pos, src, dst, type
FROM (SELECT DISTINCT src, dst, type, CASE type WHEN 'EXTENDS' THEN 5 WHEN 'IMPLEMENTS' THEN 6 ELSE 7 END AS type_ord FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS', 'OVERRIDES'))""")
def hierarchy_order_edges(s: S, d: str) -> D:
    """One-hop edges with their position by edge type, dst and src."""
    return dense_ids(graph.hierarchy_edges(t(s, d, "edges")), "type_ord", "dst", "src", name="pos").select("pos", "src", "dst", "type")


@query("WITH c AS (" + _CLOSURE.format(a="src", b="dst") + ") SELECT start, node, depth, row_number() OVER (PARTITION BY start ORDER BY depth, node) - 1 AS pos FROM c")
def hierarchy_order(s: S, d: str) -> D:
    """Supertypes of each start with their position by depth and moniker."""
    return cl.in_order(cl.closure(t(s, d, "edges"), cap=None))


_ANCHORS = """c(m, cur) AS (SELECT moniker, enclosing FROM ls WHERE kind NOT IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'ANNOTATION') AND enclosing <> ''
  UNION SELECT m, ls.enclosing FROM c JOIN ls ON ls.moniker = cur WHERE ls.kind NOT IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'ANNOTATION') AND ls.enclosing <> ''),
f AS (SELECT m, cur FROM c JOIN ls ON ls.moniker = cur WHERE ls.kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'ANNOTATION'))"""


@query(f"""WITH RECURSIVE {LIVE}, {EDGES}, {_ANCHORS},
a AS (SELECT moniker, CASE WHEN kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'ANNOTATION') THEN moniker ELSE f.cur END AS owner FROM ls LEFT JOIN f ON f.m = moniker)
SELECT DISTINCT CASE WHEN type IN ('EXTENDS', 'IMPLEMENTS') THEN 'SUPERTYPE' ELSE 'TYPEREF' END AS relation, owner, dst AS target, NOT ends_with(dst, '~UNRESOLVED') AS resolved
FROM e JOIN a ON a.moniker = src WHERE (type IN ('EXTENDS', 'IMPLEMENTS') OR layer = 'typeref') AND owner <> dst AND dst NOT IN ('~java.lang.Object', '')""")
def file_dependencies(s: S, d: str) -> D:
    return graph.dependencies(t(s, d, "edges"), t(s, d, "symbols"))


@query(f"""WITH {LIVE}, n AS (SELECT DISTINCT {trim('name')} AS target_name FROM ls WHERE kind = 'METHOD'), u AS (SELECT DISTINCT {trim('target_name')} AS target_name, file_id FROM usages)
SELECT target_name, file_id FROM u WHERE target_name <> '' AND target_name IN (SELECT target_name FROM n WHERE target_name IS NOT NULL)""")
def semi_candidate_files(s: S, d: str) -> D:
    """Files that use the name of any declared method."""
    names = search.live_symbols(t(s, d, "symbols")).where(F.col("kind") == "METHOD").select(tx.strip_space(F.col("name")).alias("target_name"))
    return graph.candidate_files(t(s, d, "usages"), names)


@query(f"SELECT DISTINCT {trim('target_name')} AS name, file_id FROM usages WHERE {trim('target_name')} <> '' UNION SELECT regexp_replace(dst, '~UNRESOLVED$', ''), occ.file_id FROM edges WHERE dst LIKE '%~UNRESOLVED' AND occ.file_id >= 0")
def candidate_union(s: S, d: str) -> D:
    """Candidate files from use sites and from unresolved edges."""
    a = t(s, d, "usages").select(tx.strip_space(F.col("target_name")).alias("name"), "file_id").where("name <> ''")
    return a.unionByName(graph.unconfirmed(t(s, d, "edges")).select("name", "file_id")).distinct()


# ---- live view and compaction: files whose recorded size is stale were edited since, files without a hash were withdrawn

_EDITS = "ed AS (SELECT file_id, max(mtime) AS seq, bool_or(content_hash IS NULL) AS deleted FROM files JOIN (SELECT file_id, max(strlen(text)) AS now FROM source_files GROUP BY file_id) USING (file_id) GROUP BY file_id HAVING bool_or(content_hash IS NULL) OR max(size) <> max(now))"


def _edits(s: S, d: str) -> D:
    now = t(s, d, "source_files").groupBy("file_id").agg(F.max(F.octet_length("text")).alias("now"))
    log = t(s, d, "files").join(now, "file_id").groupBy("file_id").agg(F.max("mtime").alias("seq"), F.bool_or(F.col("content_hash").isNull()).alias("deleted"), F.max("size").alias("size"), F.max("now").alias("now"))
    return liveview.latest_edits(log.where("deleted OR size <> now").select("seq", "file_id", "deleted"))


@query(f"WITH {_EDITS} SELECT file_id, seq, deleted FROM ed")
def apply_edit(s: S, d: str) -> D:
    return _edits(s, d)


@query(f"WITH {_EDITS} SELECT DISTINCT file_id, kind, target_name, range.start_line AS line, range.start_col AS col FROM usages WHERE file_id NOT IN (SELECT file_id FROM ed)")
def anti_overlaid(s: S, d: str) -> D:
    u = t(s, d, "usages").join(_edits(s, d), "file_id", "left_anti")
    return u.select("file_id", "kind", "target_name", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col")).distinct()


@query(f"""WITH {_EDITS}, {LIVE} SELECT DISTINCT moniker, kind, file_id, range.start_line AS line, name FROM symbols WHERE file_id NOT IN (SELECT file_id FROM ed)
UNION SELECT moniker, kind, file_id, range.start_line, name FROM ls WHERE file_id IN (SELECT file_id FROM ed WHERE NOT deleted)""")
def live_union(s: S, d: str) -> D:
    """Symbols under the overlay of edited files, whose re-indexed slices hold each symbol once."""
    sym = t(s, d, "symbols")
    return liveview.live(sym, search.live_symbols(sym), _edits(s, d)).select("moniker", "kind", "file_id", F.col("range.start_line").alias("line"), "name").distinct()


@query(f"WITH {_EDITS}, {LIVE}, {EDGES} SELECT e.src, e.dst, e.type, count(*) AS n FROM e LEFT JOIN ls ON ls.moniker = e.src WHERE ls.file_id IS NULL OR ls.file_id NOT IN (SELECT file_id FROM ed WHERE deleted) GROUP BY ALL")
def live_edges(s: S, d: str) -> D:
    """Edges under the overlay of edited files, whose re-indexed slices hold each edge once."""
    e = t(s, d, "edges")
    return liveview.live_edges(e, e, t(s, d, "symbols"), _edits(s, d)).groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EDITS} SELECT DISTINCT file_id, kind, range.start_line AS line, range.start_col AS col, text FROM text_units WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM ed WHERE deleted)")
def live_text(s: S, d: str) -> D:
    """Text units under the overlay of edited files, whose re-indexed slices hold each unit once."""
    u = t(s, d, "text_units").select("file_id", "kind", "range", "text")
    return liveview.live(u, u.distinct(), _edits(s, d)).select("file_id", "kind", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col"), "text").distinct()


@query("SELECT moniker FROM (SELECT src AS moniker FROM edges UNION SELECT dst FROM edges) WHERE moniker NOT IN (SELECT moniker FROM symbols)")
def phantom_synth(s: S, d: str) -> D:
    return liveview.phantoms(t(s, d, "edges"), t(s, d, "symbols"))


_NODES = "nodes AS (SELECT moniker, row_number() OVER (ORDER BY moniker) - 1 AS id FROM (SELECT moniker FROM symbols UNION SELECT src FROM edges UNION SELECT dst FROM edges))"


@query(f"WITH {_NODES} SELECT moniker, id FROM nodes")
def dense_node_ids(s: S, d: str) -> D:
    return liveview.compact(t(s, d, "symbols"), t(s, d, "edges"))[0].select("moniker", "id")


@query(f"WITH {_NODES}, {EDGES} SELECT a.id AS src_id, b.id AS dst_id, type, count(*) AS n FROM e JOIN nodes a ON a.moniker = src JOIN nodes b ON b.moniker = dst GROUP BY ALL")
def compact(s: S, d: str) -> D:
    """The edge table rewritten over dense ids."""
    return liveview.compact(t(s, d, "symbols"), t(s, d, "edges"))[1].groupBy("src_id", "dst_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT moniker, max(file_id) AS file_id FROM symbols GROUP BY moniker")
def ids_dedup(s: S, d: str) -> D:
    return liveview.newest_by_moniker(t(s, d, "symbols"), _edits(s, d)).select("moniker", "file_id")


@query(f"WITH {_EDITS}, {LIVE}, {EDGES} SELECT layer, type, count(*) AS n FROM e LEFT JOIN ls ON ls.moniker = e.src WHERE layer = 'structural' OR ls.file_id IS NULL OR ls.file_id NOT IN (SELECT file_id FROM ed) GROUP BY ALL")
def drop_tier2(s: S, d: str) -> D:
    """Edges after the resolved layers of all edited files were reset; their structural edges stay."""
    e = liveview.without_resolved(graph.edge_set(t(s, d, "edges")), t(s, d, "symbols"), _edits(s, d))
    return e.groupBy("layer", "type").agg(F.count(F.lit(1)).alias("n"))


# ---- freshness

_NOW = "w AS (SELECT file_id, max(text) AS text FROM source_files WHERE text IS NOT NULL GROUP BY file_id), n AS (SELECT path, strlen(text)::BIGINT AS size, md5(text) AS hash FROM w LEFT JOIN (SELECT file_id, min(path) AS path FROM files GROUP BY file_id) USING (file_id)), k AS (SELECT path, max(size) AS size, max(content_hash) AS hash FROM files GROUP BY path), sd AS (SELECT path, CASE WHEN k.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN k.hash IS DISTINCT FROM n.hash THEN 'changed' WHEN k.size IS DISTINCT FROM n.size THEN 'touched' ELSE 'unchanged' END AS status FROM k FULL JOIN n USING (path))"


def _diff(s: S, d: str) -> D:
    f = t(s, d, "files")
    return fresh.snapshot_diff(f, fresh.walk_of(t(s, d, "source_files"), f))


@query(f"WITH {_NOW} SELECT path, status FROM sd")
def snapshot_diff(s: S, d: str) -> D:
    return _diff(s, d)


@query(f"WITH {_NOW} SELECT count(*) AS total, count_if(status = 'unchanged')::BIGINT AS unchanged, count_if(status = 'touched')::BIGINT AS touched, count_if(status = 'added')::BIGINT AS added, count_if(status = 'changed')::BIGINT AS changed, count_if(status = 'deleted')::BIGINT AS deleted, count_if(status IN ('added', 'changed'))::BIGINT AS reparsed, count(*) > count_if(status IN ('added', 'deleted')) AS warm FROM sd")
def reconcile_stats(s: S, d: str) -> D:
    return fresh.reconcile_stats(_diff(s, d))


@query("SELECT path, (SELECT max(file_id) FROM files) + row_number() OVER (ORDER BY path) AS file_id FROM (SELECT DISTINCT path FROM files)")
def alloc_ids(s: S, d: str) -> D:
    """Ids that all paths would get if every file came anew."""
    return fresh.allocate_ids(t(s, d, "files").select("path"), t(s, d, "files"))


_OLDNEW = f"{LIVE}, o AS (SELECT file_id, moniker, max(signature) AS sig FROM symbols WHERE file_id >= 0 GROUP BY ALL), nn AS (SELECT file_id, moniker, name AS sig FROM ls)"


@query(f"WITH {_OLDNEW} SELECT file_id, moniker, CASE WHEN nn.moniker IS NULL THEN 'removed' WHEN o.moniker IS NULL THEN 'added' ELSE 'signatureChanged' END AS change FROM o FULL JOIN nn USING (file_id, moniker) WHERE nn.moniker IS NULL OR o.moniker IS NULL OR o.sig IS DISTINCT FROM nn.sig")
def node_diff(s: S, d: str) -> D:
    """Declarations whose signature on record differs from their bare name, as an example of two snapshots."""
    sym = t(s, d, "symbols").where(F.col("file_id") >= 0)
    return fresh.node_diff(sym, search.live_symbols(sym).select("file_id", "moniker", F.col("name").alias("signature")))


@query(f"""WITH {_EDITS}, {LIVE}, h AS (SELECT DISTINCT src, dst, type FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS')),
n AS (SELECT h.* FROM h LEFT JOIN ls ON ls.moniker = h.src LEFT JOIN ls x ON x.moniker = h.dst WHERE (ls.file_id IS NULL OR ls.file_id NOT IN (SELECT file_id FROM ed WHERE deleted)) AND (x.file_id IS NULL OR x.file_id NOT IN (SELECT file_id FROM ed WHERE deleted)))
SELECT DISTINCT src AS moniker FROM (SELECT * FROM h EXCEPT SELECT * FROM n)""")
def hierarchy_diff(s: S, d: str) -> D:
    """Types whose supertypes change as the withdrawn files go, at either end of the edge."""
    e, sym, edits = t(s, d, "edges"), t(s, d, "symbols"), _edits(s, d)
    gone = edits.where("deleted")
    lost = search.live_symbols(sym).join(gone, "file_id", "left_semi").select(F.col("moniker").alias("dst"))
    now = liveview.live_edges(e, e, sym, edits).join(lost, "dst", "left_anti")
    h = lambda df: df.where(F.col("type").isin("EXTENDS", "IMPLEMENTS"))
    return fresh.hierarchy_diff(h(e), h(now))


_CHANGED = f"ch AS (SELECT DISTINCT moniker FROM symbols WHERE kind IN ('INTERFACE', 'RECORD')), nm AS (SELECT DISTINCT {trim('name')} AS name FROM symbols WHERE moniker IN (SELECT moniker FROM ch)), ow AS (SELECT DISTINCT moniker, file_id FROM symbols WHERE file_id >= 0)"


@query(f"""WITH {_CHANGED} SELECT DISTINCT ow.file_id, 'edge' AS reason FROM edges JOIN ow ON ow.moniker = src WHERE type <> 'CONTAINS' AND dst IN (SELECT moniker FROM ch)
UNION SELECT ow.file_id, 'placeholder' FROM edges JOIN ow ON ow.moniker = src WHERE dst IN (SELECT name || '~UNRESOLVED' FROM nm WHERE name IS NOT NULL)
UNION SELECT file_id, 'usage' FROM usages WHERE {trim('target_name')} IN (SELECT name FROM nm WHERE name <> '')""")
def invalidate_referrers(s: S, d: str) -> D:
    """Files to re-resolve if every interface and record changed."""
    sym = t(s, d, "symbols")
    return fresh.invalidated(sym.where(F.col("kind").isin("INTERFACE", "RECORD")), t(s, d, "edges"), t(s, d, "usages"), sym)


# ---- quality and observability

_CALLS = "c AS (SELECT DISTINCT * FROM call_log)"


@query(f"WITH {_CALLS} SELECT tool, count(*) AS calls, (count(*) FILTER (WHERE NOT ok)) AS failed, round(sum(latency_ms), 3) AS total_ms, max(latency_ms) AS max_ms, round(avg(latency_ms), 3) AS avg_ms FROM c GROUP BY tool")
def timer_agg(s: S, d: str) -> D:
    return quality.timers(t(s, d, "call_log"))


@query(f"WITH {_CALLS} SELECT tool, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.9) AS p90, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM c WHERE latency_ms IS NOT NULL GROUP BY tool")
def latency_percentiles(s: S, d: str) -> D:
    return quality.latency_percentiles(t(s, d, "call_log"))


@query(f"WITH {_CALLS} SELECT tool, ok, count(*) AS calls, sum(resp_bytes)::BIGINT AS bytes FROM c GROUP BY ALL")
def counter_agg(s: S, d: str) -> D:
    return t(s, d, "call_log").distinct().groupBy("tool", "ok").agg(F.count(F.lit(1)).alias("calls"), F.sum("resp_bytes").alias("bytes"))


@query(f"""WITH {_CALLS} SELECT ts, tool, request, CASE WHEN json_valid(request) THEN json_extract_string(request, '$.symbol') END AS symbol, CASE WHEN json_valid(request) THEN json_extract_string(request, '$.query') END AS query,
CASE WHEN json_valid(request) THEN try_cast(json_extract_string(request, '$.limit') AS BIGINT) END AS lim, request IS NOT NULL AND NOT json_valid(request) AS damaged FROM c""")
def json_read(s: S, d: str) -> D:
    """Members of the logged requests; cut-off JSON is flagged and gives no members."""
    v = F.expr("try_parse_json(request)")
    get = lambda k: F.expr(f"try_variant_get(try_parse_json(request), '$.{k}', 'string')")
    return t(s, d, "call_log").distinct().select("ts", "tool", "request", get("symbol").alias("symbol"), get("query").alias("query"), get("limit").cast("bigint").alias("lim"), (F.col("request").isNotNull() & v.isNull()).alias("damaged"))


@query(f"WITH {EDGES}, x AS (SELECT cause, count(*) AS n FROM e WHERE cause IS NOT NULL GROUP BY cause) SELECT cause, n, n / (SELECT sum(n) FROM x) AS share FROM x")
def failure_histogram(s: S, d: str) -> D:
    return quality.histogram(graph.edge_set(t(s, d, "edges")).where(F.col("cause").isNotNull()), ["cause"])


@query("SELECT kind, sum(strlen(text))::BIGINT AS bytes, count(*) AS units FROM (SELECT DISTINCT * FROM text_units) GROUP BY kind")
def text_footprint(s: S, d: str) -> D:
    return t(s, d, "text_units").distinct().groupBy("kind").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("units"))


@query(f"""WITH f AS (SELECT file_id, max(text) AS text FROM source_files GROUP BY file_id), {LIVE}
SELECT (SELECT count(*) FROM f) AS files, (SELECT sum(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)::BIGINT FROM f) AS loc, (SELECT count(*) FROM ls) AS symbols""")
def index_stats(s: S, d: str) -> D:
    """files, lines and symbols of the index."""
    f = t(s, d, "source_files").groupBy("file_id").agg(F.max("text").alias("text"))
    loc = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + F.when((F.col("text") != "") & ~F.col("text").endswith("\n"), 1).otherwise(0)
    a = f.select(F.lit(1).cast("bigint").alias("files"), loc.cast("bigint").alias("loc"), F.lit(0).cast("bigint").alias("symbols"))
    b = search.live_symbols(t(s, d, "symbols")).select(F.lit(0).cast("bigint").alias("files"), F.lit(0).cast("bigint").alias("loc"), F.lit(1).cast("bigint").alias("symbols"))
    return a.unionByName(b).agg(*[F.sum(c).alias(c) for c in ("files", "loc", "symbols")])


_PAIRS = f"""op AS (SELECT DISTINCT file_id, range.start_line AS line, range.start_col AS col FROM usages), pp AS (SELECT DISTINCT occ.file_id AS file_id, occ.range.start_line AS line, occ.range.start_col AS col FROM edges WHERE cause IS NULL AND occ.file_id >= 0),
bo AS (SELECT file_id, count(o) AS wanted, count(p) AS given, count(CASE WHEN o IS NOT NULL AND p IS NOT NULL THEN 1 END) AS matched FROM (SELECT *, 1 AS o FROM op) FULL JOIN (SELECT *, 1 AS p FROM pp) USING (file_id, line, col) GROUP BY file_id)"""


def _recall(s: S, d: str) -> D:
    """Use sites (wanted) against places of resolved edges (given), per file."""
    o = t(s, d, "usages").select("file_id", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col"))
    p = graph.use_sites(t(s, d, "edges")).where(F.col("cause").isNull()).select("file_id", "line", "col")
    return quality.compare(o, p, "file_id", ["file_id", "line", "col"])


@query(f"WITH {_PAIRS} SELECT file_id, wanted, given, matched FROM bo")
def recall_join(s: S, d: str) -> D:
    return _recall(s, d)


@query(f"WITH {_PAIRS} SELECT sum(matched) / sum(wanted) AS micro_recall, sum(matched) / sum(given) AS micro_precision, avg(CASE WHEN wanted > 0 THEN matched / wanted END) AS macro_recall FROM bo")
def micro_macro_recall(s: S, d: str) -> D:
    return quality.micro_macro(_recall(s, d))


@query(f"WITH {_PAIRS} SELECT file_id, wanted - matched AS misses, given - matched AS extras FROM bo WHERE wanted + given > 2 * matched ORDER BY wanted + given - 2 * matched DESC, file_id LIMIT 15")
def worst_offenders(s: S, d: str) -> D:
    return quality.worst_offenders(_recall(s, d), "file_id")


@query(f"WITH {_PAIRS} SELECT file_id, line, col, 'miss' AS side FROM (SELECT * FROM op EXCEPT SELECT * FROM pp) UNION ALL SELECT file_id, line, col, 'extra' FROM (SELECT * FROM pp EXCEPT SELECT * FROM op)")
def miss_extra(s: S, d: str) -> D:
    o = t(s, d, "usages").select("file_id", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col")).distinct()
    p = graph.use_sites(t(s, d, "edges")).where(F.col("cause").isNull()).select("file_id", "line", "col").distinct()
    return o.exceptAll(p).withColumn("side", F.lit("miss")).unionByName(p.exceptAll(o).withColumn("side", F.lit("extra")))


@query("SELECT src, dst FROM edges WHERE layer = 'typeref' EXCEPT SELECT src, dst FROM edges WHERE layer = 'hierarchy'")
def inferred_only(s: S, d: str) -> D:
    """Type references that are no supertype."""
    e = t(s, d, "edges")
    return e.where(F.col("layer") == "typeref").select("src", "dst").subtract(e.where(F.col("layer") == "hierarchy").select("src", "dst"))


# ---- shape

_REFLINES = f"""{USES}, {PATHS}, rl AS (SELECT dst, coalesce(path, '') AS path, line, src AS snippet FROM ok LEFT JOIN paths USING (file_id)),
pf AS (SELECT dst, path, sum(length(path) + length(line::VARCHAR) + 2 + length(snippet) + 2) AS full_, sum(length(path) + length(line::VARCHAR) + 2) AS locations, length(path) + length(count(*)::VARCHAR) + 3 AS rollup FROM rl GROUP BY dst, path),
sz AS (SELECT dst, floor((sum(full_) + 3) / 4)::BIGINT AS f, floor((sum(locations) + 3) / 4)::BIGINT AS l, floor((sum(rollup) + 3) / 4)::BIGINT AS r FROM pf GROUP BY dst)"""


@query(f"WITH {_REFLINES} SELECT dst, f AS \"full\", l AS locations, r AS rollup, CASE WHEN f <= 4000 THEN 'full' WHEN l <= 4000 THEN 'locations' WHEN r <= 4000 THEN 'rollup' ELSE 'over' END AS rung FROM sz")
def budget_refs(s: S, d: str) -> D:
    """The rung of the budget ladder for the references of every target."""
    r = match.with_path(graph.confirmed(t(s, d, "edges")), t(s, d, "files")).select("dst", F.coalesce("path", F.lit("")).alias("path"), "line", F.col("src").alias("snippet"))
    return shape.rung_sizes(r, "dst").withColumn("rung", shape.choose_rung(shape.DEFAULT_CAP))


@query(f"WITH {USES}, x AS (SELECT dst, count(*) AS refs, count(DISTINCT file_id) AS files FROM ok GROUP BY dst) SELECT dst AS target, 'Total refs: ' || refs || ' across ' || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END AS shown FROM x")
def shape_refs(s: S, d: str) -> D:
    return graph.reference_counts(t(s, d, "edges")).select("target", shape.reference_header(F.col("refs"), F.col("files")).alias("shown"))


@query(f"WITH {LIVE}, {PATHS} SELECT moniker, coalesce(path, '(external)') || ':' || range.start_line || '  ' || lower(kind) || '  ' || coalesce(signature, moniker) AS shown FROM ls LEFT JOIN paths USING (file_id)")
def shape_symbol(s: S, d: str) -> D:
    sym = match.with_path(search.live_symbols(t(s, d, "symbols")), t(s, d, "files"))
    return sym.select("moniker", shape.render_symbol(F.col("path"), F.col("range.start_line"), F.col("kind"), F.col("signature"), F.col("moniker")).alias("shown"))


@query(r"""WITH x AS (SELECT DISTINCT file_id, decl_no, doc_text, header_text, start_line, body_inner, has_body, body_has_line_comment, trim(regexp_replace(body_inner, '\s+', ' ', 'g')) AS b FROM skim_decls)
SELECT file_id, start_line, decl_no, CASE WHEN doc_text IS NOT NULL AND trim(doc_text) <> '' THEN doc_text || chr(10) ELSE '' END || lpad(start_line::VARCHAR, 6, ' ') || '  ' || coalesce(regexp_replace(header_text, '\s+$', ''), '') ||
CASE WHEN NOT coalesce(has_body, false) THEN '' WHEN body_inner IS NOT NULL AND length(b) <= 100 AND NOT coalesce(body_has_line_comment, false) THEN ' { ' || b || ' }' ELSE ' { … }' END AS shown FROM x""")
def skim_render(s: S, d: str) -> D:
    return shape.skim_lines(t(s, d, "skim_decls"))


@query(f"SELECT coalesce(path, 'all') AS path, kind, count(*) AS n FROM (SELECT DISTINCT * FROM text_units) JOIN (SELECT file_id, min(path) AS path FROM files GROUP BY file_id) USING (file_id) GROUP BY ROLLUP (path, kind)".replace("coalesce(path, 'all') AS path", "path"))
def rollup_totals(s: S, d: str) -> D:
    """Units per file and kind with subtotals and the total."""
    return match.with_path(t(s, d, "text_units").distinct(), t(s, d, "files")).rollup("path", "kind").agg(F.count(F.lit(1)).alias("n"))
