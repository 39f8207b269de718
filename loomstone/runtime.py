"""Session helpers shared by all operators: reading tables, cutting lineage, spreading scans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: below the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent and the session is local (tests, a laptop) a temporary folder is
    made, once. Whatever is left in it goes when the session's JVM ends.
    """
    sc = spark.sparkContext
    base = sc._jsc.sc().getCheckpointDir()
    base = base.get() if base.isDefined() else sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomstone-")
        sc.setCheckpointDir(base)
        base = sc._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/loomstone-{sc.applicationId}"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, gone when the session ends."""
    return f"{_shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame, **counts: Column) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: iterative plans stay short.

    The copy is columnar and compressed, its size is known to the optimizer (which decides about broadcasts
    by it), and it survives the loss of executors. ``drop`` deletes it. Aggregates given by name are
    taken while the rows are written and stand in ``counts`` of the result, so they cost no job.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
    watch = Observation() if counts else None
    (df.observe(watch, *[c.alias(n) for n, c in counts.items()]) if watch else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    out.counts = {n: (watch.get or {}).get(n) or 0 for n in counts} if watch else {}
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that ``cut`` wrote; nothing may read them later. Others, and None, are left alone."""
    for df in tables:
        path = getattr(df, "_cut_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in at least as many tasks as there are cores, for costly per-row work on a scan.

    Only a scan of fewer splits than cores is moved (by a hash of ``keys``), so what is shuffled is at most one
    split per core; larger scans stay where they are. For scans with narrow operators only.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, *keys)
