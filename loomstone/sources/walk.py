"""Discovery of source files and source roots, and their fingerprints."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where build tools and package managers put what they make: Maven, Gradle, the common IDEs, npm. Hidden folders are left out by rule.
OUTPUT = {"target", "build", "out", "bin", "node_modules"}


def walk(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """path (below ``root``), size, mtime (ms), text of every source file; listing and reading are distributed."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = re.escape(root.rstrip("/"))
    return f.select(
        F.regexp_replace("path", rf"^.*?{base}/", "").alias("path"), F.col("length").alias("size"),
        (F.col("modificationTime").cast("double") * 1000).cast("bigint").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def fingerprints(walked: DataFrame) -> DataFrame:
    """path, size, mtime, content_hash."""
    return walked.select("path", "size", "mtime", F.md5("text").alias("content_hash"))


def source_roots(root: str, depth: int = 8) -> list[tuple[str, str]]:
    """(folder below ``root``, MAIN or TEST) of every conventional source root; an unconventional tree is one MAIN root."""
    found = []
    for here, dirs, _ in os.walk(root):
        level = os.path.relpath(here, root).count(os.sep) + (here != root)
        dirs[:] = sorted(d for d in dirs if d not in OUTPUT and not d.startswith(".")) if level < depth else []
        rel = os.path.relpath(here, root).replace(os.sep, "/")
        if m := re.search(r"(?:^|/)src/([^/]+)/java$", rel):
            found.append((rel, "TEST" if "test" in m[1].lower() else "MAIN"))
            dirs[:] = []
    return found or [("", "MAIN")]


def java_level(build_text: str) -> str | None:
    """The language level that a build file states."""
    m = re.search(r"<(?:maven\.compiler\.(?:release|source)|release|java\.version)>\s*(?:1\.)?(\d+)", build_text) or re.search(
        r"(?:languageVersion\D{0,60}?|(?:source|target)Compatibility\D{0,40}?(?:1[._])?)(\d+)", build_text)
    return m[1] if m else None
