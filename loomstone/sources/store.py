"""The index on disk: versioned parquet tables behind an atomically replaced pointer.

    <root>/CURRENT          text: the number of the live version
    <root>/v=000007/        one folder per table written then, and MANIFEST.json: format version, place and schema of every table
    <root>/LOCK             there while somebody writes

Writers put a whole new version beside the live one and then swing the pointer; readers never see half a
version. Paths go through Hadoop's file system API, so any store that Spark can reach serves.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.operators.graph import usage_postings
from loomstone.operators.search import trigram_postings

#: Column that each table is range-partitioned and sorted by, so that point lookups touch few row groups.
ORDER = {
    "symbols": ["moniker"], "edges": ["src", "dst", "type"], "edges_by_dst": ["dst", "type", "src"], "text_units": ["file_id", "range", "kind", "text"],
    "usages": ["target_name", "file_id"], "usage_postings": ["target_name"], "trigrams": ["tri", "moniker"], "files": ["path"],
}


class FormatError(IOError):
    """The stored tables have another format than this code reads."""


class Locked(OSError):
    """Another writer holds the store."""


class Folder:
    """Small text files in a folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str | None:
        """The text of a file, None if there is none; any other fault is raised."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if it is there already. Of several at once only one succeeds."""
        self._fs.mkdirs(self._path(self.root))
        try:
            stream = self._fs.create(self._at(name), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def write(self, name: str, text: str) -> None:
        """Puts ``text`` in place of the file in one step: readers see the former or the new text."""
        tmp = f".{name.replace('/', '-')}.tmp"
        stream = self._fs.create(self._at(tmp), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(name).toUri(), self._conf).rename(self._at(tmp), self._at(name), options)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()


class Store:
    """Readers see whole versions only; one writer at a time, held off by the file LOCK, which the writer removes.

    A writer that died leaves LOCK behind; ``unlock`` removes it once somebody has made sure of that.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False) -> None:
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self._files = Folder(spark, self.root)

    @property
    def version(self) -> int:
        """The live version, 0 for an empty store."""
        text = self._files.read("CURRENT")
        return int(text) if text else 0

    def _manifest(self, version: int) -> dict[str, dict[str, str]]:
        text = self._files.read(f"v={version:06d}/MANIFEST.json") if version else None
        if text is None:
            raise FormatError(f"no index at {self.root}")
        found = json.loads(text)
        if found.get("format") != schema.FORMAT_VERSION:
            raise FormatError(f"format {found.get('format')}, expected {schema.FORMAT_VERSION}")
        return found["tables"]

    def read(self, name: str) -> DataFrame:
        """A table of the live version; raises FormatError for another format or none."""
        tables = self._manifest(self.version)
        if name not in tables:
            raise FormatError(f"no table {name}")
        return self.spark.read.schema(tables[name]["schema"]).parquet(f"{self.root}/{tables[name]['at']}")

    def unlock(self) -> None:
        self._files.delete("LOCK")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """A new version from ``tables``; tables not given stay where they are and are named in its manifest. Returns its number."""
        if self.read_only:
            raise PermissionError("the index is open for reading only")
        if not self._files.create("LOCK", self.spark.sparkContext.applicationId):
            raise Locked(f"{self.root} is being written by {self._files.read('LOCK')}")
        try:
            old = self.version
            new = old + 1
            manifest = dict(self._manifest(old)) if old else {}
            for name, df in tables.items():
                order = [c for c in ORDER.get(name, []) if c in df.columns]
                if order:
                    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
                df.write.mode("overwrite").parquet(f"{self.root}/v={new:06d}/{name}")
                manifest[name] = {"at": f"v={new:06d}/{name}", "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)}
            self._files.write(f"v={new:06d}/MANIFEST.json", json.dumps({"format": schema.FORMAT_VERSION, "tables": manifest}))
            self._files.write("CURRENT", str(new))
            return new
        finally:
            self._files.delete("LOCK")

    def stats(self) -> dict[str, int]:
        """Bytes of each table of the live version."""
        return {n: self._files.size(t["at"]) for n, t in self._manifest(self.version).items()}


def index_tables(symbols: DataFrame, edges: DataFrame, text_units: DataFrame, usages: DataFrame, files: DataFrame, text_kinds: list[str] | None = None) -> dict[str, DataFrame]:
    """Everything an index holds. Raises ValueError for duplicate monikers over files; dangling parents are reported by ``schema.violations``."""
    e = edges.distinct()
    text = text_units.distinct()
    if text_kinds:
        text = text.where(F.col("kind").isin(text_kinds))
    return {
        "symbols": symbols.distinct(), "edges": e, "edges_by_dst": e, "text_units": text, "usages": usages.distinct(), "files": files.distinct(),
        "usage_postings": usage_postings(usages), "trigrams": trigram_postings(symbols),
    }
