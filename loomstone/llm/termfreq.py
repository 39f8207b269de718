"""Frequency of every distinct term: rows and files, with a mark for the too rare and the too common.

A global integer dictionary is built, terms are encoded, and count arrays for occurrences and
file presence are accumulated block by block of identifiers inside each task; the partial
arrays are then summed by identifier range. A block is a range of ``BLOCK`` consecutive ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import strip_space
from loomstone.runtime import cut

BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: Partial arrays a task holds before it passes them on (16 KB each).
HELD = 2048

#: A term in more (file, term) cells than this, and in more than one of MOST_HOT of all, is hot.
LEAST_HOT, MOST_HOT = 1 << 20, 1000

_ARRAYS = "block bigint, occurrences array<bigint>, presence array<bigint>"


def occurrences(field: str, rows: DataFrame, term: str, file_id: str = "file_id") -> DataFrame:
    """(field, term, file_id) of each distinct row; terms are trimmed, null and blank ones left out."""
    t = strip_space(F.col(term))
    return rows.distinct().select(F.lit(field).alias("field"), t.alias("term"), F.col(file_id).alias("file_id")).where(F.col("term") != "")


def _accumulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, np.ndarray] = {}

    def emit():
        return pd.DataFrame({"block": list(held), "occurrences": [a[0] for a in held.values()], "presence": [a[1] for a in held.values()]})

    for f in frames:
        ids, n = f["id"].to_numpy("int64"), f["n"].to_numpy("int64")
        blocks, at = np.unique(ids >> BLOCK_BITS, return_inverse=True)
        flat = at * BLOCK + (ids & (BLOCK - 1))
        sums = np.stack([np.bincount(flat, weights=n, minlength=len(blocks) * BLOCK), np.bincount(flat, weights=f["present"].to_numpy("int64"), minlength=len(blocks) * BLOCK)])
        sums = sums.astype("int64").reshape(2, len(blocks), BLOCK)
        for i, b in enumerate(blocks.tolist()):
            held[b] = held[b] + sums[:, i] if b in held else sums[:, i].copy()
        if len(held) >= HELD:
            yield emit()
            held.clear()
    if held:
        yield emit()


def _sum_arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums the arrays of each block; rows come sorted by block, so one block is held at a time."""
    block, total = None, None

    def out():
        return pd.DataFrame({"block": [block], "occurrences": [total[0]], "presence": [total[1]]})

    for f in frames:
        for b, o, p in zip(f["block"], f["occurrences"], f["presence"]):
            if b != block:
                if block is not None:
                    yield out()
                block, total = b, np.zeros((2, BLOCK), "int64")
            total = total + np.stack([o, p])
    if block is not None:
        yield out()


def _encode(cells: DataFrame, dictionary: DataFrame, hot_above: int, most: int) -> DataFrame:
    """``cells`` with the id of their term. Terms with more than ``hot_above`` cells, of which there are at most ``MOST_HOT``, are sent to the cells, which stay where they are; others meet by term."""
    key = ["field", "term"]
    ids = dictionary.select(*key, "id", "cells")
    if most <= hot_above:
        return cells.join(ids, key)
    hot = F.broadcast(ids.where(F.col("cells") > hot_above))
    return cells.join(hot, key).unionByName(cells.join(hot, key, "left_anti").join(ids.where(F.col("cells") <= hot_above), key))


def frequencies(rows: DataFrame, least_hot: int = LEAST_HOT) -> DataFrame:
    """field, term, n_rows, n_files of every (field, term) of ``occurrences`` frames.

    n_files counts distinct file_id; rows with a null file_id count in n_rows only. An empty
    input gives an empty result. A term that owns a third of all rows is one row per file after
    the map-side combined grouping, and one array cell per task after that.
    """
    cells = cut(rows.groupBy("field", "term", "file_id").agg(F.count(F.lit(1)).alias("n")), total=F.count(F.lit(1)))
    dictionary = cut(cells.groupBy("field", "term").agg(F.count(F.lit(1)).alias("cells")).withColumn("id", F.monotonically_increasing_id()), most=F.max("cells"))
    encoded = _encode(cells, dictionary, max(least_hot, cells.counts["total"] // MOST_HOT), dictionary.counts["most"]).select("id", "n", F.col("file_id").isNotNull().cast("int").alias("present"))
    partial = encoded.mapInPandas(_accumulate, _ARRAYS)
    summed = partial.repartition("block").sortWithinPartitions("block").mapInPandas(_sum_arrays, _ARRAYS)
    counts = summed.select("block", F.posexplode(F.arrays_zip("occurrences", "presence")).alias("pos", "c")).select(
        (F.shiftleft("block", BLOCK_BITS) + F.col("pos")).alias("id"), F.col("c.occurrences").alias("n_rows"), F.col("c.presence").alias("n_files")).where("n_rows > 0")
    return counts.join(dictionary, "id").select("field", "term", "n_rows", "n_files")


def marked(freq: DataFrame, n_files: int, rare: int = 3, common: float = 0.1) -> DataFrame:
    """Adds mark: ``rare`` below ``rare`` files, ``common`` above the share ``common`` of ``n_files``, else null."""
    return freq.withColumn("mark", F.when(F.col("n_files") < rare, "rare").when(F.col("n_files") > F.lit(common) * F.lit(n_files), "common"))
