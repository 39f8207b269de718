"""Freshness: snapshot and node differences, new ids, and what an edit invalidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import strip_space
from loomstone.operators.ids import dense_ids


def walk_of(source_files: DataFrame, files: DataFrame) -> DataFrame:
    """path, file_id, size, content_hash as the sources stand now."""
    s = source_files.where(F.col("text").isNotNull()).groupBy("file_id").agg(F.max("text").alias("text"))
    paths = files.groupBy("file_id").agg(F.min("path").alias("path"))
    return s.join(paths, "file_id", "left").select("path", "file_id", F.octet_length("text").cast("bigint").alias("size"), F.md5("text").alias("content_hash"))


def snapshot_diff(known: DataFrame, now: DataFrame) -> DataFrame:
    """path, status by full outer join: added, deleted, changed (content), touched (only the size on record is stale), unchanged.

    A missing hash on record proves nothing, so such a file counts as changed.
    """
    k = known.groupBy("path").agg(F.max("size").alias("old_size"), F.max("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    n = now.groupBy("path").agg(F.max("size").alias("size"), F.max("content_hash").alias("hash"), F.lit(True).alias("here"))
    status = (
        F.when(F.col("known").isNull(), "added").when(F.col("here").isNull(), "deleted").when(~F.col("old_hash").eqNullSafe(F.col("hash")), "changed")
        .when(~F.col("old_size").eqNullSafe(F.col("size")), "touched").otherwise("unchanged"))
    return k.join(n, "path", "full_outer").select("path", status.alias("status"))


def reconcile_stats(diff: DataFrame) -> DataFrame:
    """One row: total, unchanged, touched, added, changed, deleted, reparsed, warm."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("unchanged", "touched", "added", "changed", "deleted")]
    return diff.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if(F.col("status").isin("added", "changed")).alias("reparsed")).withColumn("warm", F.col("total") > F.col("added") + F.col("deleted"))


def allocate_ids(new_paths: DataFrame, files: DataFrame) -> DataFrame:
    """path, file_id: new paths numbered in path order from one above every id ever given."""
    top = files.agg(F.max("file_id")).first()[0]
    return dense_ids(new_paths.select("path").distinct(), "path", name="file_id", start=0 if top is None else top + 1)


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_id, moniker, change (removed, added, signatureChanged) between two declaration sets (file_id, moniker, signature)."""
    o = old.groupBy("file_id", "moniker").agg(F.max("signature").alias("old_sig"), F.lit(True).alias("was"))
    n = new.groupBy("file_id", "moniker").agg(F.max("signature").alias("new_sig"), F.lit(True).alias("is"))
    change = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(~F.col("old_sig").eqNullSafe(F.col("new_sig")), "signatureChanged")
    return o.join(n, ["file_id", "moniker"], "full_outer").select("file_id", "moniker", change.alias("change")).where("change IS NOT NULL")


def hierarchy_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """moniker of every src whose set of hierarchy edges (src, dst, type) differs."""
    o, n = (df.select("src", "dst", "type").distinct() for df in (old, new))
    return o.exceptAll(n).unionByName(n.exceptAll(o)).select(F.col("src").alias("moniker")).distinct()


def invalidated(changed: DataFrame, edges: DataFrame, usages: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, reason: files to re-resolve after ``changed`` monikers.

    Files whose declarations refer to one (edge), unresolved uses of its simple name (placeholder), and
    files that use that name at all (usage), which covers references a missing edge would hide.
    """
    c = changed.select("moniker").distinct()
    names = symbols.join(c, "moniker", "left_semi").select(strip_space(F.col("name")).alias("target_name")).where(F.col("target_name") != "").distinct()
    referred = edges.where(F.col("type") != "CONTAINS").join(c.withColumnRenamed("moniker", "dst"), "dst", "left_semi")
    owner = symbols.where(F.col("file_id") >= 0).select(F.col("moniker").alias("src"), "file_id").distinct()
    by_edge = referred.select("src").distinct().join(owner, "src").select("file_id", F.lit("edge").alias("reason"))
    waiting = names.select(F.concat("target_name", F.lit("~UNRESOLVED")).alias("dst"))
    by_place = edges.join(waiting, "dst", "left_semi").select("src").distinct().join(owner, "src").select("file_id", F.lit("placeholder").alias("reason"))
    by_use = usages.select(strip_space(F.col("target_name")).alias("target_name"), "file_id").distinct().join(names, "target_name", "left_semi").select("file_id", F.lit("usage").alias("reason"))
    return by_edge.unionByName(by_place).unionByName(by_use).distinct()
