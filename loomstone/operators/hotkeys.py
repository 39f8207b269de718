"""Per-key results over tables in which a handful of keys own most rows.

Nothing here groups raw rows by the key alone, and no text is shuffled row by row. Each row is
reduced, where it is read, to a state of fixed width: 64-bit hash of its key, of its file and
enclosing symbol where they count, and of the row as a whole, which tells repeats. Spark's partial hash
aggregate combines equal states inside each map task (spilling when its table is full); what
follows are counts, one mergeable number per task and key. So a key that owns a third of all rows
costs a reducer as many numbers as there are map tasks. The texts of the keys come back at the
end, by their hash, from a map-side combined list of the keys.

Two different keys, or two different rows of one key in one file, would have to agree in 64 bits to be
taken for one: for a billion keys the chance that any two do is 3 %, for a million rows of one key and file 3e-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import strip_space
from loomstone.runtime import cut


def digest(df: DataFrame, *columns: str) -> Column:
    """64 bits of the whole row (nested fields one by one); a null is not the same as a value left out."""
    parts: list[Column] = []

    def add(c: Column, kind) -> None:
        parts.append(c.isNull().cast("int"))
        if kind.typeName() == "struct":
            for f in kind.fields:
                add(c[f.name], f.dataType)
        else:
            parts.append(c)

    for name in columns:
        add(F.col(name), df.schema[name].dataType)
    return F.xxhash64(*parts)


def edge_keys(edges: DataFrame) -> DataFrame:
    """key, file_id, enclosing, row of each edge: key is ``dst``, enclosing its ``src``, row the digest that tells repeats.

    A null dst stays a row with a null key. Edges without an occurrence have file_id -1,
    which is kept as null, so they belong to no file.
    """
    file_id = F.when(F.col("occ.file_id") >= 0, F.col("occ.file_id"))
    row = digest(edges, "src", "dst", "type", "layer", "cause", "occ")
    return edges.select(F.col("dst").alias("key"), file_id.alias("file_id"), F.col("src").alias("enclosing"), row.alias("row"))


def usage_keys(usages: DataFrame) -> DataFrame:
    """key, file_id, enclosing, row, line, col of each use site: key is the trimmed target_name, null where it is null or blank; enclosing is null."""
    name = strip_space(F.col("target_name"))
    row = digest(usages, "file_id", "kind", "target_name", "range")
    return usages.select(
        F.when(name != "", name).alias("key"), "file_id", F.lit(None).cast("string").alias("enclosing"), row.alias("row"),
        F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col"))


def places(edges: DataFrame) -> DataFrame:
    """file_id, line, col, owner: the hash of the least ``src`` of the edges recorded at each place, combined in the map tasks."""
    at = edges.where(F.col("occ.file_id") >= 0).select(
        F.col("occ.file_id").alias("file_id"), F.col("occ.range.start_line").alias("line"), F.col("occ.range.start_col").alias("col"), "src")
    return at.groupBy("file_id", "line", "col").agg(F.min("src").alias("src")).select("file_id", "line", "col", F.xxhash64("src").alias("owner"))


def _id(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.xxhash64(c))


def per_key(keyed: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """For each non-null key: uses (distinct rows), files and enclosing symbols (distinct, nulls apart).

    ``places`` (optional) supplies the enclosing symbol by file_id, line and col, which ``keyed`` then has.
    States of (key, file, enclosing, row) first, then counts per (key, file) or (key, enclosing), then the key.
    An empty table gives an empty result.
    """
    rows = keyed.where(F.col("key").isNotNull())
    at = ["line", "col"] if places is not None else []
    state = rows.select(_id("key").alias("k"), "file_id", _id("enclosing").alias("owner"), "row", *at).distinct()
    if places is not None:
        state = state.drop("owner").join(places, ["file_id", "line", "col"], "left")
    cells = cut(state.groupBy("k", "file_id", "owner").agg(F.count(F.lit(1)).alias("n")))
    by_file = cells.groupBy("k", "file_id").agg(F.sum("n").alias("n")).groupBy("k").agg(F.sum("n").alias("uses"), F.count("file_id").alias("files"))
    by_owner = cells.groupBy("k", "owner").agg(F.lit(1).alias("one")).groupBy("k").agg(F.count("owner").alias("enclosing_symbols"))
    names = rows.select("key").distinct().withColumn("k", _id("key"))
    return by_file.join(by_owner, "k").join(names, "k").select("key", "uses", "files", "enclosing_symbols")


def heavy_keys(keyed: DataFrame, share: float = 0.015) -> DataFrame:
    """(key, uses) of the keys that hold at least ``share`` of all distinct rows.

    Rows with a null key count in the total only. The counts per key are written once, and the total is
    their sum. At most 1 / ``share`` keys can be heavy, so their hashes may be broadcast to find the texts.
    """
    states = keyed.select(_id("key").alias("k"), "file_id", "row").distinct()
    counts = cut(states.groupBy("k").agg(F.count(F.lit(1)).alias("uses")))
    total = counts.agg(F.sum("uses")).first()[0] or 0
    heavy = counts.where(F.col("k").isNotNull() & (F.col("uses") >= F.lit(share) * F.lit(total)))
    names = keyed.where(F.col("key").isNotNull()).select("key", _id("key").alias("k"))
    return names.join(F.broadcast(heavy), "k").select("key", "uses").distinct()
