"""The data model: fixed, versioned schemas and closed value sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT_VERSION = 1
RANGE = "STRUCT<start_line: INT, start_col: INT, end_line: INT, end_col: INT>"

SCHEMAS = {
    "symbols": f"moniker STRING, kind STRING, flags INT, enclosing STRING, file_id BIGINT, range {RANGE}, name STRING, signature STRING",
    "edges": f"src STRING, dst STRING, type STRING, layer STRING, cause STRING, occ STRUCT<file_id: BIGINT, range: {RANGE}, role: STRING>",
    "usages": f"file_id BIGINT, kind STRING, target_name STRING, range {RANGE}",
    "text_units": f"file_id BIGINT, kind STRING, range {RANGE}, text STRING",
    "files": "path STRING, file_id BIGINT, size BIGINT, mtime BIGINT, content_hash STRING, source_set STRING",
    "call_log": "ts TIMESTAMP_NTZ, tool STRING, request STRING, ok BOOLEAN, latency_ms DOUBLE, resp_bytes BIGINT",
}

# The closed sets, in their stored order.
SYMBOL_KINDS = ["PACKAGE", "CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION", "METHOD", "CONSTRUCTOR", "FIELD", "ENUM_CONSTANT", "PARAMETER", "TYPE_PARAMETER", "MODULE", "UNKNOWN"]
EDGE_TYPES = ["CONTAINS", "REFERENCES", "CALLS", "INSTANTIATES", "ANNOTATED_BY", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "HAS_TYPE", "THROWS", "IMPORTS"]
HIERARCHY = ["EXTENDS", "IMPLEMENTS", "OVERRIDES"]
TYPE_KINDS = ["CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION"]
TEXT_KINDS = ["STRING_LITERAL", "COMMENT", "JAVADOC"]
#: Use-site kind to (edge type, role).
USE_EDGES = {
    "CALL": ("CALLS", "CALL"), "INSTANTIATION": ("INSTANTIATES", "CALL"), "METHOD_REF": ("CALLS", "CALL"), "TYPE_REF": ("REFERENCES", "TYPEREF"),
    "ANNOTATION": ("ANNOTATED_BY", "TYPEREF"), "FIELD_ACCESS": ("REFERENCES", "READ"), "NAME": ("REFERENCES", "READ"),
}


def ordinal(c: Column, values: list[str]) -> Column:
    """Position of ``c`` in a closed set; null for anything else."""
    return F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])[c]


def source_set(flags: Column) -> Column:
    return F.when(flags.bitwiseAND(1) != 0, "TEST").otherwise("MAIN")


def role_of(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (_, r) in USE_EDGES.items() for x in (k, r)])[kind]


def edge_type_of(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (e, _) in USE_EDGES.items() for x in (k, e)])[kind]


def display(signature: Column, moniker: Column) -> Column:
    """The signature, else the moniker without a leading ``~``."""
    return F.coalesce(signature, F.regexp_replace(moniker, "^~", ""))


def is_use_site(occ: Column) -> Column:
    """An occurrence that is a place in a file, not a structural edge."""
    return (occ["role"] != "NONE") & (occ["file_id"] >= 0)


def violations(symbols: DataFrame) -> DataFrame:
    """(rule, moniker): monikers declared in more than one file (duplicate), and enclosing monikers without a row (dangling)."""
    s = symbols.select("moniker", "enclosing", "file_id").distinct()
    twice = s.groupBy("moniker").agg(F.count_distinct("file_id").alias("n")).where("n > 1").select(F.lit("duplicate").alias("rule"), "moniker")
    known = s.select(F.col("moniker").alias("enclosing")).distinct()
    dangling = s.where(F.col("enclosing") != "").join(known, "enclosing", "left_anti").select(F.lit("dangling").alias("rule"), "moniker").distinct()
    return twice.unionByName(dangling)
