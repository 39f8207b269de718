"""Base tables under an overlay of edited files: live views, phantoms, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.ids import dense_ids
from loomstone.operators.search import live_symbols


def latest_edits(log: DataFrame) -> DataFrame:
    """file_id, seq, deleted: the last edit of each file in a log (seq BIGINT, file_id BIGINT, deleted BOOLEAN); replays are harmless."""
    last = F.max_by(F.struct("seq", "deleted"), F.struct("seq", "deleted"))
    return log.groupBy("file_id").agg(last.alias("e")).select("file_id", "e.seq", "e.deleted")


def valid_prefix(log: DataFrame, ok: str = "ok") -> DataFrame:
    """Records of a log before the first damaged one (by seq): one aggregate finds it, no window over the log is needed."""
    bad = log.where(~F.col(ok) | F.col(ok).isNull()).agg(F.min("seq").alias("bad")).first()[0]
    return log if bad is None else log.where(F.col("seq") < bad)


def live(base: DataFrame, overlay: DataFrame, edits: DataFrame, file_id: str = "file_id") -> DataFrame:
    """base without the files edited, and the overlay rows of edited files that are not tombstones; a set.

    ``edits`` comes from ``latest_edits``. Overlay rows of files that were never edited do not count.
    """
    kept = base.join(edits.select(F.col("file_id").alias(file_id)), file_id, "left_anti")
    fresh = overlay.join(edits.where(~F.col("deleted")).select(F.col("file_id").alias(file_id)), file_id, "left_semi")
    return kept.unionByName(fresh).distinct()


def live_edges(edges: DataFrame, overlay: DataFrame, symbols: DataFrame, edits: DataFrame) -> DataFrame:
    """An edge belongs to the file that declares its src; edges of external sources are never suppressed."""
    edited = live_symbols(symbols).select(F.col("moniker").alias("src"), "file_id").join(edits.select("file_id", "deleted"), "file_id").select("src", "deleted")
    e = edges.join(edited, "src", "left_anti")
    o = overlay.join(edited.where(~F.col("deleted")), "src", "left_semi")
    return e.unionByName(o).distinct()


def without_resolved(edges: DataFrame, symbols: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges without the resolved layers of edited files: their structural edges, and whatever belongs to other files or none."""
    edited = live_symbols(symbols).select(F.col("moniker").alias("src"), "file_id").join(edits.select("file_id"), "file_id").select("src")
    return edges.where(F.col("layer") == "structural").unionByName(edges.where(~F.col("layer").eqNullSafe("structural")).join(edited, "src", "left_anti"))


def resolved_again(edges: DataFrame, found: DataFrame, symbols: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges after the edited files were resolved anew: their resolved layers give way to the edges ``found`` for them; a set."""
    edited = live_symbols(symbols).select(F.col("moniker").alias("src"), "file_id").join(edits.where(~F.col("deleted")).select("file_id"), "file_id").select("src")
    fresh = found.where(~F.col("layer").eqNullSafe("structural")).join(edited, "src", "left_semi")
    return without_resolved(edges, symbols, edits).unionByName(fresh.select(edges.columns)).distinct()


def newest_by_moniker(symbols: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per moniker: if several files declare it, the one edited last wins, else the largest file_id."""
    w = Window.partitionBy("moniker").orderBy(F.desc_nulls_last("seq"), F.desc("file_id"), F.desc("range"), F.desc("signature"))
    return symbols.join(edits.select("file_id", "seq"), "file_id", "left").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "seq")


def phantoms(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """moniker of every endpoint without a symbol row."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("moniker")).distinct()
    return ends.where(F.col("moniker").isNotNull()).join(symbols.select("moniker").distinct(), "moniker", "left_anti")


def compact(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols with id, edges with src_id and dst_id): one row per symbol, phantoms added, ids dense by moniker."""
    one = symbols.select("moniker", "kind", "file_id", "signature", "range")
    w = Window.partitionBy("moniker").orderBy(F.desc("file_id"), F.desc("range"), F.desc("signature"))
    one = one.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "range")
    missing = phantoms(edges, symbols).select("moniker", F.lit("UNKNOWN").alias("kind"), F.lit(-1).cast("bigint").alias("file_id"), F.regexp_replace("moniker", "^~", "").alias("signature"))
    nodes = dense_ids(one.unionByName(missing), "moniker")
    ids = nodes.select("moniker", "id")
    e = edges.distinct().join(ids.select(F.col("moniker").alias("src"), F.col("id").alias("src_id")), "src").join(ids.select(F.col("moniker").alias("dst"), F.col("id").alias("dst_id")), "dst")
    return nodes, e


def should_compact(base_bytes: int, log_bytes: int, ratio: float | None) -> bool:
    """Never for a manual policy (ratio None); else once the log reaches ``ratio`` times a base that is not empty."""
    return ratio is not None and base_bytes > 0 and log_bytes >= base_bytes * ratio
