"""Transitive super- and subtypes of every start at once, level by level, with depth, via and a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.graph import hierarchy_edges
from loomstone.operators.ids import dense_ids
from loomstone.runtime import cut

CAP = 500


def closure(edges: DataFrame, starts: DataFrame | None = None, up: bool = True, cap: int | None = CAP, types: tuple[str, ...] = ("EXTENDS", "IMPLEMENTS")) -> DataFrame:
    """start, node, depth, via, truncated.

    Breadth first from each start, as a queue would: neighbours of an earlier node come first, then by neighbour and
    edge type; the first arrival fixes depth and via. A start lists the first ``cap`` nodes found; truncated says
    that there were more. The start itself is not listed. Loops end, since a node is found once.
    starts (column start) defaults to every node with an outgoing edge. Rank limits are applied per start before the
    rows are ranked, so a type with millions of subtypes sends at most ``cap`` + 1 of them per task to its ranking.
    Without a cap (None) every node is listed and truncated is false; a level is then ranked by range partitions over
    all starts, so no task holds a whole start.
    """
    a, b = ("src", "dst") if up else ("dst", "src")
    hops = cut(hierarchy_edges(edges).where(F.col("type").isin(*types)).select(F.col(a).alias("at"), F.col(b).alias("node"), "type", "type_ord").where("at <> node"))
    starts = hops.select(F.col("at").alias("start")).distinct() if starts is None else starts.select("start").where("start IS NOT NULL").distinct()
    frontier = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).cast("bigint").alias("rnk"), F.lit(0).cast("bigint").alias("base")))
    seen, levels, depth = frontier.select("start", "node"), None, 0
    while True:
        depth += 1
        reached = frontier.select("start", F.col("node").alias("at"), F.col("rnk").alias("parent"), "base").join(hops, "at").join(seen, ["start", "node"], "left_anti")
        first = reached.groupBy("start", "node").agg(F.min(F.struct("parent", "type_ord", "type")).alias("f"), F.max("base").alias("base"))
        if cap is None:  # only the order within a start counts, so ids may have gaps between partitions
            flat = first.select("start", "node", "f.parent", F.col("f.type").alias("via"))
            level = flat.repartitionByRange("start", "parent", "node").sortWithinPartitions("start", "parent", "node")
            level = cut(level.select("start", "node", F.monotonically_increasing_id().alias("rnk"), "via", F.lit(depth).alias("depth")))
            if level.isEmpty():
                break
            levels = level if levels is None else levels.unionByName(level)
            seen = seen.unionByName(level.select("start", "node"))
            frontier = level.select("start", "node", "rnk", F.lit(0).cast("bigint").alias("base"))
            continue
        w = Window.partitionBy("start").orderBy("f.parent", "node")
        level = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap + 1).withColumn("rnk", F.col("base") + F.col("n"))
        level = cut(level.where(F.col("rnk") <= cap + 1).select("start", "node", "rnk", F.col("f.type").alias("via"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        levels = level if levels is None else levels.unionByName(level)
        seen = seen.unionByName(level.select("start", "node"))
        base = level.groupBy("start").agg(F.max("rnk").alias("base"))
        frontier = cut(level.join(base.where(F.col("base") <= cap), "start").select("start", "node", "rnk", "base"))
    if levels is None:
        levels = frontier.select("start", "node", "rnk", F.lit("").alias("via"), F.lit(0).alias("depth")).where("false")
    if cap is None:
        return levels.select("start", "node", "depth", "via", F.lit(False).alias("truncated"))
    over = levels.where(F.col("rnk") > cap).select("start", F.lit(True).alias("truncated"))
    return levels.where(F.col("rnk") <= cap).join(over, "start", "left").select("start", "node", "depth", "via", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def in_order(nodes: DataFrame) -> DataFrame:
    """start, node, depth, pos: the nodes of each start counted from 0 by depth and moniker, without one task that holds a whole start."""
    ranked = dense_ids(nodes.select("start", "node", "depth"), "start", "depth", "node")
    first = ranked.groupBy("start").agg(F.min("id").alias("first"))
    return ranked.join(first, "start").select("start", "node", "depth", (F.col("id") - F.col("first")).alias("pos"))
