"""Parent-child links of unknown depth to full hierarchies, with their faults.

A symbol table is a functional graph: each node has at most one parent. It is solved by

1. choosing splitters by a deterministic hash of the node (1 in ``SPLIT``), and treating the
   last node of every chain as one;
2. walking every node to its next splitter. Walks double in length each round, so a gap of g
   takes log2(g) joins, and each walk keeps the nodes it passed: gaps are ~SPLIT long;
3. solving the much smaller graph splitter -> next splitter in the same way;
4. putting the walk of a node before what its splitter knows: exact paths, depths or states.

A cycle that no splitter lies on shows up in step 2 as a walk that meets a node twice; it and
whatever runs into it are settled there. A cycle through splitters shows up likewise in step 3.
Walks carry only what is asked for: nothing for the faults, the labels for path texts, the ids for
descendants. All work on 64-bit ids made from the keys, so long keys are never shuffled but for the
answer. No step gathers a component or a chain on the driver; only counters get there. Joins are
from many nodes to one row per node, so adaptive execution can split a hot parent's children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.ids import dense_ids
from loomstone.runtime import cut, drop

SPLIT = 8

ROOTED, ORPHAN, CYCLE, HANGS = "rooted", "orphan", "cycle", "hangs"


def _id(c: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), c)


def numbered_links(symbols: DataFrame, node: str = "moniker", parent: str = "enclosing", label: str | None = None, seed: int = 1) -> DataFrame:
    """One row per node: id, label, parent_id, end. ``keys`` gives the nodes of the ids back.

    Repeated rows and older slices of a node give one link; should they disagree, a parent is
    preferred to none and then the least one taken. Rows with a null node are no nodes. ``end``
    is null for a node with a parent, ``rooted`` where the parent is null or empty, ``orphan``
    where the parent has no row of its own. Ids are 64-bit hashes with a second hash beside them; should two
    nodes share an id, another seed is taken, and a parent is known by both hashes. Only where a node has
    several parents their texts are compared, so no others are shuffled; nodes without a parent join nothing.
    """
    par = F.when(F.col(parent) != "", F.col(parent))
    lab = F.col(label) if label else F.lit(None).cast("string")
    rows = symbols.where(F.col(node).isNotNull()).select(
        _id(F.col(node), seed).alias("id"), _id(F.col(node), -seed).alias("check"), F.when(par.isNotNull(), _id(par, seed)).alias("up"),
        F.when(par.isNotNull(), _id(par, -seed)).alias("up_check"), lab.alias("label"), par.alias("parent"))
    one = cut(
        rows.groupBy("id").agg(F.min("check").alias("check"), F.max("check").alias("check2"), F.min("up").alias("up"), F.max("up").alias("up2"), F.min_by("up_check", "up").alias("up_check")),
        clash=F.count_if(F.col("check") != F.col("check2")), torn=F.count_if(F.col("up") != F.col("up2")))
    if one.counts["clash"]:
        drop(one)
        return numbered_links(symbols, node, parent, label, seed + 1)
    if one.counts["torn"]:
        least = rows.where(F.col("parent").isNotNull()).join(one.where("up <> up2").select("id"), "id", "left_semi").groupBy("id").agg(F.min("parent").alias("parent"))
        least = least.select("id", _id(F.col("parent"), seed).alias("least"), _id(F.col("parent"), -seed).alias("least_check"))
        one = one.join(least, "id", "left").withColumn("up", F.coalesce("least", "up")).withColumn("up_check", F.coalesce("least_check", "up_check"))
    if label:
        one = one.join(rows.where(F.col("label").isNotNull()).select("id", "label").distinct().groupBy("id").agg(F.min("label").alias("label")), "id", "left")
    else:
        one = one.withColumn("label", F.lit(None).cast("string"))
    known = one.select(F.col("id").alias("up"), F.col("check").alias("up_check"), F.col("id").alias("parent_id"))
    below = one.where(F.col("up").isNotNull()).join(known, ["up", "up_check"], "left").select(
        "id", "label", "parent_id", F.when(F.col("parent_id").isNull(), ORPHAN).alias("end"))
    tops = one.where(F.col("up").isNull()).select("id", "label", F.lit(None).cast("bigint").alias("parent_id"), F.lit(ROOTED).alias("end"))
    out = cut(below.unionByName(tops))
    out._seed = seed
    return out


def keys(symbols: DataFrame, links: DataFrame, node: str = "moniker", **_) -> DataFrame:
    """id, node of every node of ``links``, combined in the map tasks."""
    return symbols.where(F.col(node).isNotNull()).select(F.col(node).alias("node")).distinct().withColumn("id", _id(F.col("node"), links._seed))


#: What walks can carry: its value at a node, and how the part nearer to the root joins what is below it.
CARRIED = {
    "path": (lambda: F.array("id"), lambda low, high: F.concat(low, high)),
    "text": (lambda: F.coalesce("label", F.lit("?")), lambda low, high: F.concat(high, F.lit("/"), low)),
    "steps": (lambda: F.lit(1).cast("bigint"), lambda low, high: low + high),
}


def _walk(start: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """Doubles walks until each is over. In: id, cur, seg (nodes passed, the last one is cur), over, and what is carried from id to before cur.

    Out: id, seg, stop ('' at a splitter or an end, ``loop`` where a node was met twice), and what is carried. Walks that
    are over leave the loop and are not joined again as walkers; they serve as continuations.
    """
    walks, done = start, None
    while True:
        met_twice = F.array_contains("seg", F.col("id")) | (F.size(F.array_distinct("seg")) < F.size("seg"))
        walks = cut(walks.withColumn("loop", ~F.col("over") & met_twice), active=F.count_if(~F.col("over") & ~F.col("loop")))
        finished = walks.where(F.col("over") | F.col("loop")).select("id", "seg", F.when(F.col("loop"), "loop").otherwise("").alias("stop"), *carried)
        done = finished if done is None else done.unionByName(finished)
        active = walks.where(~F.col("over") & ~F.col("loop"))
        if not walks.counts["active"]:
            return done
        more = [F.col(c).alias(f"{c}_on") for c in carried]
        ahead = active.select(F.col("id").alias("cur"), F.col("seg").alias("more"), F.lit(False).alias("ends"), *more).unionByName(
            done.select(F.col("id").alias("cur"), F.col("seg").alias("more"), (F.col("stop") == "").alias("ends"), *more))
        walks = active.join(ahead, "cur").select(
            "id", F.concat("seg", "more").alias("seg"), F.element_at("more", -1).alias("cur"), F.col("ends").alias("over"),
            *[CARRIED[c][1](F.col(c), F.col(f"{c}_on")).alias(c) for c in carried])


def resolve(links: DataFrame, carried: tuple[str, ...] = (), split: int = SPLIT) -> DataFrame:
    """State of each node of ``numbered_links``: id, state, root, and what is carried.

    state is rooted, orphan, cycle or hangs. Where it is rooted or orphan, root is the id of the last node of the
    chain, path the ids from the node up to it, text the labels from there down to the node, steps
    their number; else these are null.
    """
    is_split = F.col("end").isNotNull() | (F.pmod(F.xxhash64("id"), F.lit(split)) == 0)
    here = [CARRIED[c][0]().alias(c) for c in carried]
    nodes = links.select("id", "parent_id", "end", is_split.alias("split"), *here)
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("split").alias("over"))
    step = nodes.where(F.col("end").isNull()).join(parents, "parent_id").select("id", F.col("parent_id").alias("cur"), F.array("parent_id").alias("seg"), "over", *carried)
    splits = F.pmod(F.xxhash64("id"), F.lit(split)) == 0  # of nodes that walk, which have no end
    walked = _walk(step, carried).withColumn("split", splits)

    looped = walked.where(F.col("stop") == "loop").select("id", F.when(F.array_contains("seg", F.col("id")), CYCLE).otherwise(HANGS).alias("state"), "split")
    to_split = walked.where(F.col("stop") == "").select("id", "seg", "split", F.element_at("seg", -1).alias("next"), *carried)

    # The reduced graph. Its ends: the last nodes of chains, and splitters that run into a cycle without splitters.
    nothing = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in carried]
    ends = nodes.where(F.col("end").isNotNull()).select("id", F.col("end").alias("state"), *carried).unionByName(
        looped.where("split").select("id", F.lit(HANGS).alias("state"), *nothing))
    hops = to_split.where("split")
    first = hops.join(ends.select(F.col("id").alias("next"), F.lit(True).alias("over")), "next", "left").select(
        "id", F.col("next").alias("cur"), F.array("next").alias("seg"), F.coalesce("over", F.lit(False)).alias("over"), *carried)
    solved = _walk(first, carried)

    def above(df: DataFrame, known: DataFrame, at: str) -> DataFrame:
        """``df`` with what is known of the node ``at`` put on top."""
        top = known.select(F.col("id").alias(at), "state", "root", *[F.col(c).alias(f"{c}_on") for c in carried])
        return df.join(top, at).select("id", "state", "root", *[CARRIED[c][1](F.col(c), F.col(f"{c}_on")).alias(c) for c in carried])

    top = ends.select("id", "state", F.when(F.col("state") != HANGS, F.col("id")).alias("root"), *carried)
    chains = above(solved.where(F.col("stop") == "").withColumn("last", F.element_at("seg", -1)), top, "last")
    # Whatever is a splitter but on no chain is on a cycle or runs into one.
    rest = solved.where(F.col("stop") == "loop").select("id", F.lit(HANGS).alias("state"), F.lit(None).cast("bigint").alias("root"), *nothing)
    splitters = cut(chains.unionByName(rest))
    others = above(to_split.where(~F.col("split")), top.unionByName(splitters), "next")
    # Splitters that walked into a splitterless cycle stand in ``looped``; here they only pass their state on.
    known = nodes.where(F.col("end").isNotNull()).select("id", F.col("end").alias("state"), F.col("id").alias("root"), *carried).unionByName(splitters).unionByName(others)
    on_cycle = solved.where((F.col("stop") == "loop") & F.array_contains("seg", F.col("id"))).select("id")
    cycle_nodes = hops.join(on_cycle, "id", "left_semi").select(F.explode("seg").alias("id")).distinct().withColumn("on", F.lit(True))
    hanging = known.where(F.col("state") == HANGS).join(cycle_nodes, "id", "left").withColumn("state", F.when(F.col("on"), CYCLE).otherwise(HANGS)).drop("on")
    return known.where(F.col("state") != HANGS).unionByName(hanging).unionByName(
        looped.select("id", "state", F.lit(None).cast("bigint").alias("root"), *nothing))


def faults(symbols: DataFrame, **columns) -> DataFrame:
    """(fault, node): cycle, hangs or orphan, for every node whose chain of parents is not sound."""
    links = numbered_links(symbols, **columns)
    bad = resolve(links).where(F.col("state") != ROOTED)
    return bad.join(keys(symbols, links, **columns), "id").select(F.col("state").alias("fault"), "node")


def hierarchy(symbols: DataFrame, **columns) -> DataFrame:
    """node, state, depth, root, path (labels from the root down to the node, joined by '/').

    depth is 0 at a root. For an orphan the chain up to its last node is given; on a cycle, or
    running into one, depth, root and path are null. Null labels are shown as ``?``.
    """
    links = numbered_links(symbols, **columns)
    res = cut(resolve(links, ("text", "steps")))
    names = cut(keys(symbols, links, **columns))
    roots = names.join(res.select(F.col("root").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("root"), F.col("node").alias("top"))
    return res.join(names, "id").join(roots, "root", "left").select(
        "node", "state", (F.col("steps") - 1).alias("depth"), F.col("top").alias("root"), F.col("text").alias("path"))


def descendants(symbols: DataFrame, **columns) -> DataFrame:
    """(node, descendant, distance) for every node on a sound or orphaned chain: one row for each pair.

    The number of rows is the sum of all depths; a node's descendants are never gathered in one row.
    ``intervals`` says the same with one row per node.
    """
    links = numbered_links(symbols, **columns)
    res = resolve(links, ("path",)).where(F.col("root").isNotNull())
    pairs = res.select(F.col("id").alias("low"), F.posexplode(F.slice("path", 2, F.size("path"))).alias("up", "at"))
    names = cut(keys(symbols, links, **columns))
    return (
        pairs.join(names.select(F.col("id").alias("at"), "node"), "at")
        .join(names.select(F.col("id").alias("low"), F.col("node").alias("descendant")), "low")
        .select("node", "descendant", (F.col("up") + 1).cast("bigint").alias("distance"))
    )


def intervals(symbols: DataFrame, **columns) -> DataFrame:
    """(node, first, last) for every node on a sound or orphaned chain: its number in preorder, and the last number below it.

    The descendants of a node are the nodes whose ``first`` is above its own and at most its ``last``. Numbers follow the order of
    the paths of ids, found by range partitions; sizes of subtrees are counted with map-side combining.
    """
    links = numbered_links(symbols, **columns)
    res = cut(resolve(links, ("path",)).where(F.col("root").isNotNull()).select("id", F.reverse("path").alias("path")))
    size = res.select(F.explode("path").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    placed = dense_ids(res, "path", name="first").select("id", "first")
    return placed.join(size, "id").join(keys(symbols, links, **columns), "id").select("node", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def _closed(pairs: DataFrame, on: Column) -> DataFrame:
    """(start, node, depth) with the least sums over chains of ``pairs`` that pass only nodes for which ``on`` (over node) holds.

    Chains double in length each round; a round without a new or lesser sum ends it, so loops end as well.
    """
    sums = cut(pairs.groupBy("start", "node").agg(F.min("depth").alias("depth")))
    while True:
        tails = sums.select(F.col("start").alias("at"), F.col("node").alias("to"), F.col("depth").alias("more"))
        longer = sums.where(on).join(tails, F.col("node") == F.col("at")).where(F.col("start") != F.col("to")).select("start", F.col("to").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))
        both = sums.select("*", F.col("depth").alias("was")).unionByName(longer.withColumn("was", F.lit(None).cast("bigint")))
        least = both.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min("was").alias("was"))
        now = cut(least, news=F.count_if(F.col("was").isNull() | (F.col("depth") < F.col("was"))))
        drop(sums)
        sums = now.drop("was")
        sums._cut_at = now._cut_at
        if not now.counts["news"]:
            return sums


def least_depths(edges: DataFrame, starts: DataFrame, split: int = SPLIT) -> DataFrame:
    """(start, node, depth): least number of edges src -> dst from each start to every node it reaches; start itself at 0.

    Nodes may have several parents here, so walks branch, but the method is the same: splitters are chosen by
    hash; all nodes walk to their next splitters, in doubling rounds, without passing one; the reduced graph of
    splitters is solved for the least sums; what splitters know is put behind the walks that end at them. Loops
    end, since a sum must fall to be kept.
    """

    def splits(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c), F.lit(7)), F.lit(split)) == 0

    hops = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    walks = _closed(hops.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).cast("bigint").alias("depth")), ~splits("node"))
    reduced = _closed(walks.where(splits("start") & splits("node")), F.lit(True))
    begun = starts.select("start").where(F.col("start").isNotNull()).distinct()
    first = walks.join(begun, "start", "left_semi")

    def behind(df: DataFrame, more: DataFrame) -> DataFrame:
        on = more.select(F.col("start").alias("at"), F.col("node").alias("to"), F.col("depth").alias("more"))
        return df.join(on, F.col("node") == F.col("at")).select("start", F.col("to").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))

    to_split = first.where(splits("node"))
    to_split = to_split.unionByName(behind(to_split, reduced)).groupBy("start", "node").agg(F.min("depth").alias("depth"))
    here = begun.select("start", F.col("start").alias("node"), F.lit(0).cast("bigint").alias("depth"))
    found = here.unionByName(first).unionByName(to_split).unionByName(behind(to_split, walks.where(splits("start"))))
    return found.groupBy("start", "node").agg(F.min("depth").alias("depth"))


def depth_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(walk_start, moniker) of answered rows whose depth is null or not the least number of hierarchy edges.

    A moniker that cannot be reached has no such number, so its row is at fault too. Works on 64-bit ids of the monikers.
    """
    asked = cut(nodes.where(F.col("walk_start").isNotNull()).select("walk_start", "moniker", "depth", F.xxhash64("walk_start").alias("start"), F.when(F.col("moniker").isNotNull(), F.xxhash64("moniker")).alias("node")).distinct())
    up = edges.where(F.col("type").isin("EXTENDS", "IMPLEMENTS") & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))
    true = least_depths(up, asked.select("start").distinct()).withColumnRenamed("depth", "least")
    ids = asked.select("start", "node", "depth").distinct().join(true, ["start", "node"], "left")
    bad = ids.where(F.col("depth").isNull() | ~F.col("depth").eqNullSafe(F.col("least"))).select("start", "node", "depth")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("node", "depth")]
    found = asked.alias("a").join(bad.alias("b"), (F.col("a.start") == F.col("b.start")) & same[0] & same[1], "left_semi").select("walk_start", "moniker")
    lost = nodes.where(F.col("walk_start").isNull()).select("walk_start", "moniker")
    return found.unionByName(lost).distinct()
