"""From sources to a stored index: walk, one parse of each file, all projections, one new version of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import squeeze
from loomstone.operators import fresh, graph, liveview
from loomstone.runtime import cut, drop
from loomstone.sources import java, walk
from loomstone.sources.store import FormatError, Store, index_tables

_EMPTY_FILES = "path string, file_id bigint, size bigint, mtime bigint, content_hash string, source_set string"


def _set_of(path: Column) -> Column:
    return F.when(path.rlike("(^|/)src/[^/]*[tT]est[^/]*/java/"), "TEST").otherwise("MAIN")


def tables_of(source_files: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """symbols, edges (containment), usages, text_units, skim_decls and failures of (file_id, text) rows, from one parse of each."""
    found = cut(java.facts(source_files))
    skim, outline = java.projection(found, "skim_decls"), java.projection(found, "outline")
    composed = cut(graph.compose_monikers(skim, files))
    place = outline.select("file_id", F.col("range.start_line").alias("start_line"), F.col("name"), "kind", "range").dropDuplicates(["file_id", "start_line", "name", "kind"])
    head = skim.select("file_id", "decl_no", squeeze(F.col("header_text")).alias("signature"))
    flags = files.groupBy("file_id").agg(F.max(F.when(F.col("source_set") == "TEST", 1).otherwise(0)).alias("flags"))
    symbols = composed.join(place, ["file_id", "start_line", "name", "kind"], "left").join(head, ["file_id", "decl_no"], "left").join(flags, "file_id", "left").select(
        "moniker", "kind", "flags", "enclosing", "file_id", "range", "name", "signature").dropDuplicates(["moniker", "file_id"])
    none = F.lit(None).cast("struct<file_id:bigint,range:struct<start_line:int,start_col:int,end_line:int,end_col:int>,role:string>")
    edges = symbols.where(F.col("enclosing").isNotNull()).select(
        F.col("enclosing").alias("src"), F.col("moniker").alias("dst"), F.lit("CONTAINS").alias("type"), F.lit("structural").alias("layer"), F.lit(None).cast("string").alias("cause"), none.alias("occ"))
    failures = found.where(F.col("failure").isNotNull()).select("file_id", "failure").distinct()
    return {"symbols": symbols, "edges": edges, "usages": java.projection(found, "usages"), "text_units": java.projection(found, "text_units"), "skim_decls": skim, "failures": failures}


def _stored(store: Store, files: DataFrame, sources: DataFrame, t: dict[str, DataFrame]) -> int:
    whole = index_tables(t["symbols"], t["edges"], t["text_units"], t["usages"], files)
    return store.write(whole | {"source_files": sources, "skim_decls": t["skim_decls"], "failures": t["failures"]})


def _numbered(walked: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, sources) of walked files: known paths keep their ids, new ones are numbered above all others."""
    now = walked.select("path", "size", "mtime", F.md5("text").alias("content_hash"), "text")
    ids = known.groupBy("path").agg(F.min("file_id").alias("file_id"))
    new = fresh.allocate_ids(now.select("path").join(ids, "path", "left_anti"), known)
    now = cut(now.join(ids.unionByName(new), "path"))
    return now.select("path", "file_id", "size", "mtime", "content_hash", _set_of(F.col("path")).alias("source_set")), now.select("file_id", "text")


def index_repo(store: Store, root: str) -> int:
    """Indexes every source file below ``root`` into a new version; returns its number. Files that do not parse stand in ``failures``."""
    spark = store.spark
    files, sources = _numbered(walk.walk(spark, root), spark.createDataFrame([], _EMPTY_FILES))
    return _stored(store, files, sources, tables_of(sources, files))


def reindex(store: Store, walked: DataFrame) -> int:
    """Replaces the slices of the walked files (path, size, mtime, text; a null text withdraws the file) in a new version; all else stays.

    A file whose content hash is on record already keeps its slices: only its size and time are updated.
    """
    known = store.read("files")
    files, sources = _numbered(walked, known)
    old = known.groupBy("path").agg(F.max("content_hash").alias("old"))
    changed = files.join(old, "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("old")) | F.col("content_hash").isNull()).drop("old")
    edits = cut(changed.select("file_id", F.lit(1).cast("bigint").alias("seq"), F.col("content_hash").isNull().alias("deleted")).distinct())
    changed_sources = sources.join(edits, "file_id", "left_semi").where(F.col("text").isNotNull())
    fresh_tables = tables_of(changed_sources, files)
    t = {}
    for name in ("symbols", "usages", "text_units", "skim_decls", "failures"):
        t[name] = liveview.live(store.read(name), fresh_tables[name].select(store.read(name).columns), edits)
    e = store.read("edges")
    inside = store.read("symbols").join(edits, "file_id", "left_semi").select(F.col("moniker").alias("src")).distinct()
    t["edges"] = e.join(inside, "src", "left_anti").unionByName(fresh_tables["edges"]).distinct()
    kept = known.join(files.select("path"), "path", "left_anti").unionByName(files.where(F.col("content_hash").isNotNull()))
    texts = store.read("source_files").join(edits.select("file_id"), "file_id", "left_anti").unionByName(changed_sources)
    try:
        return _stored(store, kept, texts, t)
    finally:
        drop(edits)


def failures(store: Store) -> DataFrame:
    """path, failure of the files that did not parse."""
    try:
        found = store.read("failures")
    except FormatError:
        return store.spark.createDataFrame([], "path string, failure string")
    return found.join(store.read("files").select("file_id", "path").distinct(), "file_id").select("path", "failure")
