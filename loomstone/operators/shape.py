"""Size-bounded answers: token estimates, a degradation ladder, and rendered lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.functions.text import estimate_tokens

DEFAULT_CAP = 4000
INLINE_BODY = 100


@dataclass(frozen=True)
class Budget:
    """Token caps per tool; manual (None) never reduces. Errors bypass it."""

    caps: dict[str, int] = field(default_factory=dict)
    default: int | None = DEFAULT_CAP

    def cap(self, tool: str) -> int | None:
        return self.caps.get(tool, self.default)


def rung_sizes(lines: DataFrame, key: str) -> DataFrame:
    """key, full, locations, rollup: estimated tokens of an answer with snippets, without them, and as one line per file.

    lines: key, path, line, snippet. Sizes are sums, so one pass with partial aggregates decides for all answers.
    """
    place = F.length("path") + F.length(F.col("line").cast("string")) + 2
    per_file = lines.groupBy(key, "path").agg(
        F.sum(place + F.length(F.coalesce("snippet", F.lit(""))) + 2).alias("full"), F.sum(place).alias("locations"),
        (F.length("path") + F.length(F.count(F.lit(1)).cast("string")) + 3).alias("rollup"))
    return per_file.groupBy(key).agg(*[estimate_tokens(F.sum(c)).alias(c) for c in ("full", "locations", "rollup")])


def choose_rung(cap: int | None) -> Column:
    """full, locations, rollup or over, whichever is the first to fit."""
    if cap is None:
        return F.lit("full")
    return F.when(F.col("full") <= cap, "full").when(F.col("locations") <= cap, "locations").when(F.col("rollup") <= cap, "rollup").otherwise("over")


def reference_header(refs: Column, files: Column) -> Column:
    return F.concat(F.lit("Total refs: "), refs.cast("string"), F.lit(" across "), files.cast("string"), F.when(files == 1, " file").otherwise(" files"))


def render_symbol(path: Column, line: Column, kind: Column, signature: Column, moniker: Column) -> Column:
    return F.concat(F.coalesce(path, F.lit("(external)")), F.lit(":"), line.cast("string"), F.lit("  "), F.lower(kind), F.lit("  "), schema.display(signature, moniker))


def skim_lines(skim: DataFrame, inline: int = INLINE_BODY, docs: bool = True) -> DataFrame:
    """file_id, start_line, decl_no, shown: each declaration with its line number in a gutter.

    A body of at most ``inline`` characters is shown (white space squeezed) unless it holds a line comment,
    which would swallow what follows; longer ones become ``{ … }``. Null headers are shown empty.
    """
    s = skim.select("file_id", "decl_no", "doc_text", "header_text", "start_line", "body_inner", "has_body", "body_has_line_comment").distinct()
    body = F.trim(F.regexp_replace("body_inner", r"\s+", " "))
    shown = F.when(~F.coalesce("has_body", F.lit(False)), "").when(
        F.col("body_inner").isNotNull() & (F.length(body) <= inline) & ~F.coalesce("body_has_line_comment", F.lit(False)), F.concat(F.lit(" { "), body, F.lit(" }"))).otherwise(" { … }")
    head = F.coalesce(F.regexp_replace("header_text", r"\s+$", ""), F.lit(""))
    doc = F.when(F.col("doc_text").isNotNull() & (F.trim("doc_text") != ""), F.concat("doc_text", F.lit("\n"))).otherwise("") if docs else F.lit("")
    return s.select("file_id", "start_line", "decl_no", F.concat(doc, F.lpad(F.col("start_line").cast("string"), 6, " "), F.lit("  "), head, shown).alias("shown"))


def skim_files(skim: DataFrame, inline: int = INLINE_BODY, docs: bool = True) -> DataFrame:
    """file_id, text: the rendered declarations of each file in order. A file's skim is its answer, so it is one row."""
    lines = skim_lines(skim, inline, docs)
    ordered = F.sort_array(F.collect_list(F.struct("start_line", "decl_no", "shown")))
    return lines.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), "\n").alias("text"))
