"""Structured Streaming: the change feed, latest state per file, and rollups of the call log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstone import schema
from loomstone.sources.store import Folder


def stream(spark: SparkSession, path: str, table: str, per_trigger: int = 64) -> DataFrame:
    """New parquet files of a table as a stream, ``per_trigger`` files a batch."""
    return spark.readStream.schema(schema.SCHEMAS[table]).option("maxFilesPerTrigger", per_trigger).parquet(path)


def changes(reports: DataFrame, state: DataFrame | None = None, key: str = "path", seq: str = "mtime", value: str = "content_hash") -> DataFrame:
    """The reports whose ``value`` differs from the one before it (by ``seq``) for the same key, in the batch or in the ``state``.

    Repeated reports are no changes, but going back to an earlier content is one. The first report of a key is a change;
    a null value differs from any other. Reports older than the state's are ignored: they were overtaken.
    """
    cols = reports.columns
    rows = reports.select(*cols, F.lit(1).alias("_new")).distinct()
    if state is not None:
        known = state.select(*[F.col(c) if c in state.columns else F.lit(None).cast(reports.schema[c].dataType).alias(c) for c in cols], F.lit(0).alias("_new"))
        newest = state.select(F.col(key), F.col(seq).alias("_last"))
        rows = rows.join(newest, key, "left").where(F.col("_last").isNull() | (F.col(seq) >= F.col("_last"))).drop("_last").unionByName(known)
    w = Window.partitionBy(key).orderBy(F.col(seq).asc_nulls_first(), "_new", value)
    rows = rows.withColumn("_no", F.row_number().over(w)).withColumn("_before", F.lag(value).over(w))
    return rows.where((F.col("_new") == 1) & ((F.col("_no") == 1) | ~F.col(value).eqNullSafe(F.col("_before")))).select(*cols)


def merge_latest(state: DataFrame | None, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """The latest row per key of the state and a batch; order is by ``seq``, not by arrival, so replays and late rows are harmless."""
    both = batch if state is None else state.unionByName(batch)
    cols = [c for c in both.columns if c != key]
    rest = F.struct(seq, *[c for c in cols if c != seq])
    return both.groupBy(key).agg(F.max(rest).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def keep_latest(
    feed: DataFrame, path: str, checkpoint: str, key: str = "path", seq: str = "mtime", value: str = "content_hash", on_change: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Keeps one row per key in ``path``/state=N. Each batch writes the next state beside the last one and then, in one step, its number.

    A repeated batch changes nothing; a batch that fails leaves the last state in place, and a state that cannot be read fails the batch
    instead of starting anew. The state before last is deleted. ``on_change`` gets the changes of each batch (``changes``)
    before the state moves on, so after a crash it may get them again.
    """

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        files = Folder(spark, path)
        at = files.read("latest")
        if at is not None and int(at) >= no:
            return
        state = None if at is None else spark.read.schema(batch.schema).parquet(f"{path}/state={at}")
        if on_change is not None:
            on_change(changes(batch, state, key, seq, value), no)
        merge_latest(state, batch, key, seq).write.mode("overwrite").parquet(f"{path}/state={no}")
        before = files.read("previous")
        files.write("previous", at or "")
        files.write("latest", str(no))
        if before and before != at:
            files.delete(f"state={before}")

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_windows(calls: DataFrame, late: str = "3 days", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """tool, window_start, calls, failed, total_ms per tumbling (or sliding) window; calls later than ``late`` are dropped on streams."""
    c = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return c.groupBy("tool", F.window("ts", size, slide)).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum("latency_ms").alias("total_ms")).select(
        "tool", F.col("window.start").alias("window_start"), "calls", "failed", "total_ms")


def call_sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "3 days") -> DataFrame:
    """tool, session_start, session_end, calls: runs of calls with pauses shorter than ``gap``."""
    c = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return c.groupBy("tool", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("calls")).select(
        "tool", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "calls")


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns the result table (for tests and small reports)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def deadline(spark: SparkSession, seconds: float, tag: str, job: Callable[[], object]) -> object:
    """Runs ``job`` and cancels its Spark work after ``seconds``; a cancelled job raises TimeoutError and gives no partial result."""
    import threading

    sc, done, expired = spark.sparkContext, threading.Event(), threading.Event()

    def watch() -> None:
        pause = seconds
        while not done.wait(pause):  # again and again: the query may still be planning its next job
            expired.set()
            sc.cancelJobsWithTag(tag)
            pause = 0.2

    sc.setInterruptOnCancel(True)
    sc.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return job()
    except Exception as e:
        if expired.is_set():
            raise TimeoutError(f"no answer within {seconds} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        sc.removeJobTag(tag)
        sc.setInterruptOnCancel(False)
