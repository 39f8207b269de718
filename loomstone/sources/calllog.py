"""The call log: one JSON object per call, and the append-only edit log with checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone import schema


def call_lines(calls: DataFrame) -> DataFrame:
    """value: the JSON line of each call; latency in ms with three decimals, null members left out."""
    row = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "tool", "request", "ok", F.round("latency_ms", 3).alias("latency_ms"), "resp_bytes")
    return calls.select(F.to_json(row).alias("value"))


def write_calls(calls: DataFrame, path: str) -> None:
    call_lines(calls).write.mode("append").text(path)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a log; lines that are no JSON object are left out."""
    parsed = F.from_json("value", schema.SCHEMAS["call_log"].replace("TIMESTAMP_NTZ", "TIMESTAMP"))
    return spark.read.text(path).where(F.expr("try_parse_json(value) IS NOT NULL")).select(parsed.alias("c")).select("c.*")


def frame(records: DataFrame) -> DataFrame:
    """seq, payload, crc: records (seq, payload STRING) with the CRC32 of their payload."""
    return records.select("seq", "payload", F.crc32(F.col("payload").cast("binary")).alias("crc"))


def verified(records: DataFrame) -> DataFrame:
    """Adds ok: whether the payload still has its checksum."""
    return records.withColumn("ok", F.coalesce(F.crc32(F.col("payload").cast("binary")) == F.col("crc"), F.lit(False)))
