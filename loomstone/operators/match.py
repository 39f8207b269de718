"""Patterns and filters as Columns: literal, regex, case, whole word, glob, qualified names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import glob_to_regex, quote_regex

META = set(r".\[](){}*+?^$|")
_WORD = r"[\p{L}\p{Nd}_$]"
_CROSSES_LINES = re.compile(r"\\n|\\r|\\s|\\R|\\W|\\D|\\S|\\A|\\[zZ]|\[\^|\(\?[a-z]*s|\n")


@dataclass(frozen=True)
class SearchSpec:
    """One search: the pattern, whether it is a fixed string, and whether case counts (ASCII folding if not)."""

    query: str
    fixed: bool = False
    case_sensitive: bool = True

    @property
    def blank(self) -> bool:
        return not self.query.strip()

    @property
    def is_regex(self) -> bool:
        return not self.fixed and any(c in META for c in self.query)

    @property
    def literal(self) -> bool:
        """A plain substring test serves, which is the fast path."""
        return self.case_sensitive and not self.is_regex

    @property
    def regex(self) -> str:
        """The Java regex: ``^`` and ``$`` match at lines, the dot does not match their ends."""
        return f"(?m{'' if self.case_sensitive else 'i'})" + (self.query if self.is_regex else quote_regex(self.query))

    @property
    def per_line(self) -> bool:
        """Whether each match lies within a line, so that texts can be searched line by line."""
        return not (_CROSSES_LINES.search(self.query) if self.is_regex else "\n" in self.query)

    def matches(self, c: Column) -> Column:
        if self.blank:
            return F.lit(False)
        return F.contains(c, F.lit(self.query)) if self.literal else c.rlike(self.regex)

    def position(self, c: Column) -> Column:
        """1-based place of the first match, 0 if there is none."""
        return F.instr(c, self.query) if self.literal else F.regexp_instr(c, F.lit(self.regex))

    def matched(self, c: Column) -> Column:
        return F.lit(self.query) if self.literal else F.regexp_extract(c, self.regex, 0)

    def validate(self, spark: SparkSession) -> None:
        """Raises ValueError for a malformed regex, before any table is read."""
        if self.is_regex:
            try:
                spark.range(1).select(F.lit("").rlike(self.regex)).collect()
            except PySparkException as e:
                raise ValueError(f"malformed pattern: {self.query}") from e


def whole_word(c: Column, at: Column, size: Column) -> Column:
    """Whether the ``size`` characters of ``c`` from the 1-based ``at`` have no identifier character beside them."""
    before = F.when(at > 1, F.substring(c, at - 1, F.lit(1))).otherwise("")
    after = F.substring(c, at + size, F.lit(1))
    return ~before.rlike(_WORD) & ~after.rlike(_WORD)


def path_matches(path: Column, glob: str | None) -> Column:
    """Glob on the whole path; a null path never matches, no glob always does."""
    return F.lit(True) if glob is None else F.coalesce(path.rlike(glob_to_regex(glob)), F.lit(False))


def name_path(moniker: Column) -> Column:
    """Names along a moniker: packages, types and the member, without parameters."""
    bare = F.regexp_replace(F.regexp_replace(moniker, r"\([^()]*\)\.?$", ""), r"^~", "")
    return F.filter(F.split(bare, r"[/#.]"), lambda x: x != "")


def qualified_match(moniker: Column, typed: Column | str) -> Column:
    """Whether the dotted name ``typed`` is a contiguous tail of the moniker's name path; a blank one never is."""
    typed = F.lit(typed) if isinstance(typed, str) else typed
    want = F.filter(F.split(typed, r"[.#/]"), lambda x: x != "")
    path, n = name_path(moniker), F.size(want)
    return (n > 0) & (F.size(path) >= n) & (F.when(F.size(path) >= n, F.slice(path, F.size(path) - n + 1, F.greatest(n, F.lit(1)))) == want)


def with_path(df: DataFrame, files: DataFrame) -> DataFrame:
    """Adds path; files is one row per file_id after its repeats, left join so external rows stay."""
    paths = files.groupBy("file_id").agg(F.min("path").alias("path"))
    return df.join(paths, "file_id", "left")
