"""Definitions, references, containment, call hierarchy and dependencies over the edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.functions.text import java_trim, strip_generics, strip_space
from loomstone.operators.match import name_path, qualified_match
from loomstone.operators.search import live_symbols
from loomstone.runtime import cut

UNRESOLVED = "~UNRESOLVED"
LINE_BUCKET = 64


def edge_set(edges: DataFrame) -> DataFrame:
    """Edges are a set on read."""
    return edges.select("src", "dst", "type", "layer", "cause", "occ").distinct()


def use_sites(edges: DataFrame) -> DataFrame:
    """src, dst, type, file_id, line, col, end_line, end_col, role of the edges that are places in files."""
    e = edge_set(edges).where(schema.is_use_site(F.col("occ")))
    return e.select(
        "src", "dst", "type", "layer", "cause", F.col("occ.file_id").alias("file_id"), F.col("occ.range.start_line").alias("line"), F.col("occ.range.start_col").alias("col"),
        F.col("occ.range.end_line").alias("end_line"), F.col("occ.range.end_col").alias("end_col"), F.col("occ.role").alias("role"))


def confirmed(edges: DataFrame) -> DataFrame:
    """Use sites of resolved targets."""
    return use_sites(edges).where(~F.col("dst").endswith(UNRESOLVED))


def unconfirmed(edges: DataFrame) -> DataFrame:
    """name, file_id, line, col, src, cause: the tail of uses whose target could not be resolved; ordered by file, line, col on display."""
    tail = use_sites(edges).where(F.col("dst").endswith(UNRESOLVED))
    return tail.select(F.regexp_replace("dst", UNRESOLVED + "$", "").alias("name"), "file_id", "line", "col", "src", "cause")


def reference_groups(edges: DataFrame) -> DataFrame:
    """target, enclosing, n, refs: uses of a target grouped by the declaration they stand in, sorted by place.

    A group is one declaration's uses of one target, so it is bounded by the declaration's size.
    """
    place = F.struct("line", "col", "file_id", "type")
    return confirmed(edges).groupBy(F.col("dst").alias("target"), F.col("src").alias("enclosing")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(place)).alias("refs"))


def reference_counts(edges: DataFrame) -> DataFrame:
    """target, refs, files, groups: two-level counts, so a hot target costs no task more than others."""
    cells = confirmed(edges).groupBy("dst", "src", "file_id").agg(F.count(F.lit(1)).alias("n"))
    a = cells.groupBy("dst", "file_id").agg(F.sum("n").alias("n")).groupBy("dst").agg(F.sum("n").alias("refs"), F.count("file_id").alias("files"))
    b = cells.groupBy("dst", "src").agg(F.lit(1).alias("one")).groupBy("dst").agg(F.count("one").alias("groups"))
    return a.join(b, "dst").withColumnRenamed("dst", "target")


def reference_rollup(edges: DataFrame) -> DataFrame:
    """target, file_id, refs, first_line: references per file; the first place gives the order of display."""
    return confirmed(edges).groupBy(F.col("dst").alias("target"), "file_id").agg(F.count(F.lit(1)).alias("refs"), F.min("line").alias("first_line"))


def find_references(edges: DataFrame, symbols: DataFrame, typed: str) -> tuple[DataFrame, DataFrame]:
    """(confirmed uses of every declaration that ``typed`` selects, one tail for their shared simple name)."""
    targets = select_declarations(symbols, typed).select(F.col("moniker").alias("dst"))
    refs = confirmed(edges).join(targets, "dst", "left_semi")
    name = [p for p in typed.replace("#", ".").replace("/", ".").split(".") if p][-1:]
    return refs, unconfirmed(edges).where(F.col("name") == (name[0] if name else ""))


def select_declarations(symbols: DataFrame, typed: str) -> DataFrame:
    """Live symbols whose qualified name ends with ``typed``. Constructors answer to ``<init>`` only."""
    return live_symbols(symbols).where(qualified_match(F.col("moniker"), typed))


def lines_at(source_files: DataFrame, wanted: DataFrame) -> DataFrame:
    """file_id, line, content of the wanted (file_id, line) places, by physical lines; places outside the file give none.

    The line numbers of a file go to its text, which is moved once at most, and only the wanted lines leave it.
    """
    asked = wanted.select("file_id", "line").where(F.col("line") > 0).distinct().groupBy("file_id").agg(F.collect_list("line").alias("lines"))
    s = source_files.where(F.col("text").isNotNull()).select("file_id", "text").join(asked, "file_id")
    s = s.select("file_id", "lines", F.split("text", r"\r\n|\n|\r", -1).alias("all"))
    found = s.select("file_id", F.explode(F.transform("lines", lambda n: F.struct(n.alias("line"), F.get("all", n - 1).alias("content")))).alias("x")).select("file_id", "x.line", "x.content")
    return found.where(F.col("content").isNotNull()).groupBy("file_id", "line").agg(F.max("content").alias("content"))


def definitions(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """moniker, shown, kind, file_id, line, snippet of every live symbol: the trimmed line its declaration starts on."""
    s = live_symbols(symbols).select("moniker", schema.display(F.col("signature"), F.col("moniker")).alias("shown"), "kind", "file_id", F.col("range.start_line").alias("line"))
    return s.join(lines_at(source_files, s), ["file_id", "line"], "left").select("moniker", "shown", "kind", "file_id", "line", java_trim(F.col("content")).alias("snippet"))


def external_definitions(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """moniker, shown: targets outside the repository, shown without their mark."""
    return edge_set(edges).where(F.col("dst").startswith("~")).select(F.col("dst").alias("moniker")).distinct().select(
        "moniker", schema.display(F.lit(None).cast("string"), F.col("moniker")).alias("shown"))


def declarations(symbols: DataFrame) -> DataFrame:
    """moniker, kind, file_id, sl, sc, el, ec, span of each live symbol."""
    r = F.col("range")
    span = (r["end_line"] - r["start_line"]).cast("bigint") * 1_000_000 + (r["end_col"] - r["start_col"])
    return live_symbols(symbols).select(
        "moniker", "kind", "file_id", r["start_line"].alias("sl"), r["start_col"].alias("sc"), r["end_line"].alias("el"), r["end_col"].alias("ec"), span.alias("span"))


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (file_id, line, col, ``keys``) the smallest range (moniker, file_id, sl..ec, span) that covers it, ties by moniker.

    Ranges are put into buckets of ``LINE_BUCKET`` lines, so the join is on (file, bucket): a file that
    holds a third of everything is many keys, and a point meets only ranges near it.
    """
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("sl") / LINE_BUCKET), F.floor(F.greatest("sl", "el") / LINE_BUCKET))))
    p = points.withColumn("bucket", F.floor(F.col("line") / LINE_BUCKET))
    covers = ((F.col("sl") < F.col("line")) | ((F.col("sl") == F.col("line")) & (F.col("sc") <= F.col("col")))) & (
        (F.col("el") > F.col("line")) | ((F.col("el") == F.col("line")) & (F.col("ec") >= F.col("col"))))
    return p.join(r, ["file_id", "bucket"]).where(covers).groupBy(*keys).agg(F.min(F.struct("span", "moniker"))["moniker"].alias("enclosing"))


USE_KEY = ["file_id", "line", "col", "kind", "target_name"]


def enclosing_of_usages(usages: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, line, col, kind, target_name, enclosing: the declaration each distinct use stands in; uses outside all are left out."""
    u = usages.distinct().select("file_id", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col"), "kind", strip_space(F.col("target_name")).alias("target_name"))
    return innermost(u, declarations(symbols).drop("kind"), USE_KEY)


def call_hierarchy(edges: DataFrame) -> DataFrame:
    """caller, callee, calls: one level of CALLS, read from either end."""
    return confirmed(edges).where(F.col("type") == "CALLS").groupBy(F.col("src").alias("caller"), F.col("dst").alias("callee")).agg(F.count(F.lit(1)).alias("calls"))


def hierarchy_edges(edges: DataFrame) -> DataFrame:
    """src, dst, type, type_ord of the one-hop type hierarchy (supertypes by src, subtypes by dst)."""
    e = edges.where(F.col("type").isin(schema.HIERARCHY)).select("src", "dst", "type").distinct()
    return e.withColumn("type_ord", schema.ordinal(F.col("type"), schema.EDGE_TYPES))


def anchors(symbols: DataFrame) -> DataFrame:
    """moniker, anchor: the nearest enclosing type of each live symbol (itself if it is one), null where the chain has none.

    All open chains climb one level per join; a chain that comes back to its start, or runs longer than the
    table of types, is dropped as circular.
    """
    s = cut(live_symbols(symbols).select("moniker", "kind", F.when(F.col("enclosing") != "", F.col("enclosing")).alias("up")))
    is_type = F.col("kind").isin(schema.TYPE_KINDS)
    found = s.where(is_type).select("moniker", F.col("moniker").alias("anchor"))
    open_ = s.where(~is_type & F.col("up").isNotNull()).select("moniker", F.col("up").alias("at"), F.array("up").alias("seen"))
    nodes = s.select(F.col("moniker").alias("at"), "kind", "up")
    while True:
        step = cut(open_.join(nodes, "at"))
        found = found.unionByName(step.where(is_type).select("moniker", F.col("at").alias("anchor")))
        open_ = step.where(~is_type & F.col("up").isNotNull() & ~F.array_contains("seen", F.col("up"))).select("moniker", F.col("up").alias("at"), F.concat("seen", F.array("up")).alias("seen"))
        if open_.isEmpty():
            return s.select("moniker").join(found, "moniker", "left")


def dependencies(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """relation, owner, target, resolved: supertypes and type references per enclosing type; self and java.lang.Object left out."""
    owner = anchors(symbols).where(F.col("anchor").isNotNull()).withColumnRenamed("moniker", "src")
    e = edge_set(edges).where(F.col("type").isin("EXTENDS", "IMPLEMENTS") | (F.col("layer") == "typeref"))
    rel = F.when(F.col("type").isin("EXTENDS", "IMPLEMENTS"), "SUPERTYPE").otherwise("TYPEREF")
    d = e.join(owner, "src").select(rel.alias("relation"), F.col("anchor").alias("owner"), F.col("dst").alias("target"), (~F.col("dst").endswith(UNRESOLVED)).alias("resolved"))
    return d.where((F.col("owner") != F.col("target")) & ~F.col("target").isin("~java.lang.Object", "")).distinct()


def overrides(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst: methods and the methods of direct supertypes with the same name and parameter types."""
    tail = F.regexp_extract("moniker", r"([^#/]*)$", 1)
    owner = F.expr("substring(moniker, 1, length(moniker) - length(regexp_extract(moniker, '([^#/]*)$', 1)))")
    m = live_symbols(symbols).where(F.col("kind") == "METHOD").select("moniker", owner.alias("owner"), tail.alias("tail"))
    up = hierarchy_edges(edges).where(F.col("type") != "OVERRIDES").select(F.col("src").alias("owner"), F.col("dst").alias("above")).where("owner <> above").distinct()
    above = m.select(F.col("moniker").alias("dst"), F.col("owner").alias("above"), "tail")
    return m.join(up, "owner").join(above, ["above", "tail"]).select(F.col("moniker").alias("src"), "dst").distinct()


def outline(symbols: DataFrame) -> DataFrame:
    """file_id, line, depth, shown of every live symbol: the containment tree of each file, depth by the names in the moniker."""
    depth = F.size(F.filter(F.split(F.regexp_replace("moniker", r"\([^()]*\)", ""), "[#.]"), lambda x: x != "")) - 1
    s = live_symbols(symbols)
    shown = F.concat(F.repeat(F.lit("  "), depth), F.lower("kind"), F.lit(" "), F.coalesce(strip_space(F.col("name")), F.lit("?")))
    return s.select("file_id", F.col("range.start_line").alias("line"), "moniker", depth.alias("depth"), shown.alias("shown"))


def candidate_files(usages: DataFrame, names: DataFrame) -> DataFrame:
    """(target_name, file_id) of files that use one of ``names`` (column target_name), the semi-join before any costlier work."""
    u = usages.select(strip_space(F.col("target_name")).alias("target_name"), "file_id").where(F.col("target_name") != "").distinct()
    return u.join(names.select("target_name").distinct(), "target_name", "left_semi")


def usage_postings(usages: DataFrame) -> DataFrame:
    """target_name, n_files, file_ids (sorted): the files of each exact name.

    The array is the posting list itself; its length is the number of files, since (name, file) pairs are made
    distinct before they are gathered.
    """
    pairs = usages.select(strip_space(F.col("target_name")).alias("target_name"), "file_id").where(F.col("target_name") != "").distinct()
    return pairs.groupBy("target_name").agg(F.count("file_id").alias("n_files"), F.sort_array(F.collect_list("file_id")).alias("file_ids"))


def compose_monikers(skim: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, decl_no, moniker, enclosing, kind, name: the declaration trees of files walked to monikers.

    Types close with ``#``, fields and constants with ``.``, methods with their parameter types as written, generics
    erased and varargs as arrays; the package is the path below the source root. Parents are resolved by doubling
    (each row's prefix joins the prefix of its outermost known parent), so nesting of depth d takes log2(d) joins.
    """
    params = F.regexp_extract("header_text", r"(?s)\(((?:[^()]|\([^()]*\))*)\)[^()]*$", 1)
    params = F.regexp_replace(params, r"@[\w.]+(?:\([^()]*\))?|\bfinal\s", "")
    types = F.transform(
        F.filter(F.split(strip_generics(params), ","), lambda p: F.trim(p) != ""),
        lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\.\.\.", "[] "), r"\s+[\w$]+\s*$", ""), r"\s+", ""))
    sig = F.concat(F.lit("("), F.array_join(types, ","), F.lit(")."))
    name = strip_space(F.col("name"))
    own = (
        F.when(F.col("kind") == "CONSTRUCTOR", F.concat(F.lit("<init>"), sig)).when(F.col("kind") == "METHOD", F.concat(name, sig))
        .when(F.col("kind").isin(schema.TYPE_KINDS), F.concat(name, F.lit("#"))).otherwise(F.concat(name, F.lit("."))))
    package = F.regexp_extract("path", r"(?:^|/)src/[^/]+/java/(.*/)[^/]*$", 1)
    d = skim.select("file_id", "decl_no", "parent_no", "kind", "name", "header_text", "start_line").distinct()
    paths = files.groupBy("file_id").agg(F.min("path").alias("path"))
    d = d.join(paths, "file_id").select("file_id", "decl_no", "parent_no", "kind", name.alias("name"), "start_line", own.alias("own"), package.alias("package"))
    state = cut(d.withColumn("prefix", F.lit("")).withColumn("at", F.col("parent_no")))
    while not state.where(F.col("at").isNotNull()).isEmpty():
        outer = state.select("file_id", F.col("decl_no").alias("at"), F.concat("prefix", "own").alias("more"), F.col("at").alias("beyond")).dropDuplicates(["file_id", "at"])
        state = cut(state.join(outer, ["file_id", "at"], "left").withColumn("prefix", F.concat(F.coalesce("more", F.lit("")), "prefix")).withColumn("at", F.col("beyond")).drop("more", "beyond"))
    enclosing = F.when(F.col("parent_no").isNotNull(), F.concat("package", "prefix"))
    return state.select("file_id", "decl_no", F.concat("package", "prefix", "own").alias("moniker"), enclosing.alias("enclosing"), "kind", "name", "start_line")
