"""Symbol search and text search with tiered ranks, rollups and honest totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import strip_space
from loomstone.operators.match import SearchSpec, path_matches, whole_word, with_path

DEFAULT_LIMIT = 50
COLLAPSE_ABOVE = 100
SAMPLE_FILES = 5


def live_symbols(symbols: DataFrame) -> DataFrame:
    """One row per declared symbol (externals apart): repeats and older slices go, the slice that stands last stays."""
    w = Window.partitionBy("moniker").orderBy(F.desc("file_id"), F.desc("range"), F.desc("signature"), F.desc("name"))
    return symbols.where(F.col("file_id") >= 0).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tier(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 substring, 3 none of these (a regex match)."""
    return F.when(name == query, 0).when(name.startswith(query), 1).when(F.contains(name, F.lit(query)), 2).otherwise(3)


def rank() -> list:
    """Tier, then shorter names, then name and moniker."""
    return ["tier", F.length("name"), "name", "moniker"]


def symbol_hits(symbols: DataFrame, spec: SearchSpec, kind: str | None = None) -> DataFrame:
    """moniker, kind, name, signature, file_id, line, tier of the live symbols whose trimmed name matches."""
    s = live_symbols(symbols).withColumn("name", strip_space(F.col("name")))
    s = s.where(spec.matches(F.col("name")))
    if kind:
        s = s.where(F.col("kind") == kind)
    return s.select("moniker", "kind", "name", "signature", "file_id", F.col("range.start_line").alias("line"), tier(F.col("name"), spec.query).alias("tier"))


def search_symbols(symbols: DataFrame, files: DataFrame, spec: SearchSpec, kind: str | None = None, glob: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The ``limit`` best hits; kind and path filters come before rank and limit."""
    hits = with_path(symbol_hits(symbols, spec, kind), files).where(path_matches(F.col("path"), glob))
    return hits.orderBy(*rank()).limit(limit)


def trigrams(name: Column) -> Column:
    """Distinct 3-grams of a name, none for shorter names."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: F.substring(name, i, F.lit(3)))
    return F.when(F.length(name) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigram_postings(symbols: DataFrame) -> DataFrame:
    """(tri, moniker) of every live symbol."""
    s = live_symbols(symbols).select("moniker", strip_space(F.col("name")).alias("name"))
    return s.select(F.explode(trigrams(F.col("name"))).alias("tri"), "moniker")


def trigram_candidates(postings: DataFrame, query: str) -> DataFrame:
    """Entries hit by all trigrams of ``query`` (3 characters or more); the caller verifies the substring."""
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    if not grams:
        raise ValueError("a query of fewer than 3 characters has no trigrams; scan instead")
    hit = postings.where(F.col("tri").isin(grams)).groupBy("moniker").agg(F.count("tri").alias("n"))
    return hit.where(F.col("n") == len(grams)).select("moniker")


def text_lines(units: DataFrame) -> DataFrame:
    """file_id, kind, line, base_col, content: each line of each distinct unit; base_col is the column before its first character."""
    u = units.where(F.col("text").isNotNull()).select("file_id", "kind", "range", "text").distinct()
    u = u.select("file_id", "kind", "range", F.posexplode(F.split("text", "\n", -1)).alias("i", "content"))
    return u.select(
        "file_id", "kind", (F.col("range.start_line") + F.col("i")).alias("line"),
        F.when(F.col("i") == 0, F.col("range.start_col") - 1).otherwise(0).alias("base_col"), "content", F.col("range.start_col").alias("unit_col"))


def text_hits(units: DataFrame, spec: SearchSpec) -> DataFrame:
    """file_id, kind, line, col, whole_word, snippet: the first match on each line of each unit.

    Per line wherever no match can cross a line; else the whole unit is searched and a match counts for the line
    it starts on. Null texts and blank patterns give nothing.
    """
    if spec.blank:
        spec = SearchSpec("\u0000", fixed=True)
    if not spec.per_line:
        return _crossing_hits(units, spec)
    lines = text_lines(units).where(spec.matches(F.col("content")))
    at, size = spec.position(F.col("content")), F.length(spec.matched(F.col("content")))
    return lines.select(
        "file_id", "kind", "line", (F.col("base_col") + at).alias("col"), whole_word(F.col("content"), at, size).alias("whole_word"),
        F.regexp_replace("content", "\r$", "").alias("snippet"))


def _crossing_hits(units: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matches over whole texts: each match is found again behind the end of the one before, which is exact for patterns without context."""
    u = units.where(spec.matches(F.col("text"))).select("file_id", "kind", "range", "text").distinct()
    every = F.regexp_extract_all("text", F.lit(spec.regex), F.lit(0))
    start = F.struct(F.array().cast("array<struct<at:int,size:int>>").alias("hits"), F.lit(1).alias("next"))

    def step(acc: Column, m: Column) -> Column:
        at = F.call_function("locate", m, F.col("text"), acc["next"])
        hit = F.struct(at.alias("at"), F.length(m).alias("size"))
        return F.struct(F.concat(acc["hits"], F.array(hit)).alias("hits"), (at + F.greatest(F.length(m), F.lit(1))).alias("next"))

    hits = u.select("file_id", "kind", "range", "text", F.explode(F.aggregate(every, start, step, lambda a: a["hits"])).alias("h"))
    lead = F.expr("substring(text, 1, h.at - 1)")
    line_no = F.size(F.split(lead, "\n", -1)) - 1
    offset = F.length(F.substring_index(lead, "\n", -1))
    hits = hits.select(
        "file_id", "kind", "range", (F.col("range.start_line") + line_no).alias("line"),
        F.when(line_no == 0, F.col("range.start_col") + offset).otherwise(offset + 1).alias("col"),
        whole_word(F.col("text"), F.col("h.at"), F.col("h.size")).alias("whole_word"),
        F.regexp_replace(F.element_at(F.split("text", "\n", -1), line_no + 1), "\r$", "").alias("snippet"))
    first = F.min(F.struct("col", "whole_word", "snippet"))
    return hits.groupBy("file_id", "kind", "range", "line").agg(first.alias("f")).select("file_id", "kind", "line", "f.col", "f.whole_word", "f.snippet")




def grep(symbols: DataFrame, units: DataFrame, files: DataFrame, spec: SearchSpec, kind: str | None = None, glob: str | None = None, match: str = "all") -> DataFrame:
    """All hits of one search: tier 0 symbols, then tier 1 text, with path; order by ``grep_rank``.

    match is all, symbols or text; kind filters symbols and drops the text tier.
    """
    if match not in ("all", "symbols", "text"):
        raise ValueError(f"match: {match}")
    out = None
    if match != "text":
        out = symbol_hits(symbols, spec, kind).select(
            F.lit(0).alias("part"), "file_id", "kind", "line", F.lit(None).cast("int").alias("col"), F.lit(None).cast("boolean").alias("whole_word"),
            F.col("signature").alias("snippet"), "tier", "name", "moniker")
    if match != "symbols" and not kind:
        text = text_hits(units, spec).select(
            F.lit(1).alias("part"), "file_id", "kind", "line", "col", "whole_word", "snippet", F.lit(None).cast("int").alias("tier"),
            F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("moniker"))
        out = text if out is None else out.unionByName(text)
    if out is None:
        raise ValueError("kind applies to symbols only")
    return with_path(out, files).where(path_matches(F.col("path"), glob))


def grep_rank() -> list:
    """Symbols in their rank, then text hits: whole words first, then by place."""
    return ["part", "tier", F.length("name"), "name", "moniker", F.desc("whole_word"), "path", "line", "col", "kind"]


def count_header(hits: DataFrame) -> DataFrame:
    """One row: total, symbols, text, files."""
    return hits.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("part") == 0).alias("symbols"),
        F.count_if(F.col("part") == 1).alias("text"), F.count_distinct("path").alias("files"))


def per_file(hits: DataFrame) -> DataFrame:
    """path, hits, symbols, text per file, best-ranked file first by ``best`` (part, not whole word, tier)."""
    best = F.min(F.struct("part", F.coalesce(F.col("tier"), F.lit(9)).alias("tier"), (~F.coalesce("whole_word", F.lit(False))).cast("int").alias("loose")))
    return hits.groupBy("path").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("part") == 0).alias("symbols"), F.count_if(F.col("part") == 1).alias("text"), best.alias("best"))


def one_per_file(hits: DataFrame, n: int = SAMPLE_FILES) -> DataFrame:
    """The best-ranked hit of each file, the first ``n`` of them by rank."""
    w = Window.partitionBy("path").orderBy(*grep_rank())
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(*grep_rank()).limit(n)


def collapses(total: int) -> bool:
    """Collapse depends on the total, not on the limit."""
    return total > COLLAPSE_ABOVE
