"""Natural language hidden inside code: the language of comments and literals, and its share of each file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import prose
from loomstone.runtime import spread


def _detect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, str | None] = {}
    for f in frames:
        if len(seen) > 50_000:  # bounded memo: the same short texts recur
            seen.clear()
        langs = []
        for text in f["text"]:
            if text is not None and len(text) < 200:
                if text not in seen:
                    seen[text] = prose.unit_language(text)
                langs.append(seen[text])
            else:
                langs.append(prose.unit_language(text))
        yield f[["file_id", "kind", "start_line", "start_col"]].assign(lang=langs, n_chars=f["text"].str.len().fillna(0).astype("int64"))


def text_languages(units: DataFrame) -> DataFrame:
    """file_id, kind, start_line, start_col, lang, n_chars of every distinct text unit; lang is null where it holds no natural language.

    A single Aho-Corasick pass over each undressed span finds the function words of all languages;
    inverse-language-frequency votes decide, script ranges settle the others. Repeats are removed behind
    the detection, so texts are not shuffled. Null and blank texts get a null lang and their length (0 for null);
    rows without a file or place are left out.
    """
    rows = units.select("file_id", "kind", F.col("range.start_line").alias("start_line"), F.col("range.start_col").alias("start_col"), "text").dropna(subset=["file_id", "start_line", "start_col"])
    found = spread(rows, "file_id", "start_line", "start_col").mapInPandas(_detect, "file_id bigint, kind string, start_line int, start_col int, lang string, n_chars bigint")
    return found.distinct()


def language_shares(units: DataFrame) -> DataFrame:
    """file_id, lang, units, share: characters of natural language in ``lang`` over all characters of the file's text units."""
    found = text_languages(units)
    by_lang = found.groupBy("file_id", "lang").agg(F.count(F.lit(1)).alias("units"), F.sum("n_chars").alias("chars"))
    total = by_lang.groupBy("file_id").agg(F.sum("chars").alias("total"))
    return by_lang.where(F.col("lang").isNotNull()).join(total, "file_id").select("file_id", "lang", "units", (F.col("chars") / F.col("total")).alias("share"))
