"""Queries of the training-data operators and, where it can be written, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import docpairs, leakage, natural, packing, sentences, termfreq
from loomstone.runtime import table


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Methods and constructors with what their own or inherited documentation says."""
    return docpairs.pairs(table(spark, sf, "skim_decls"), table(spark, sf, "symbols"), table(spark, sf, "edges"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs whose own documentation says something, out of all that ``docpairs.described`` resolves."""
    found = docpairs.described(table(spark, sf, "skim_decls"), table(spark, sf, "symbols"), table(spark, sf, "edges"))
    return found.where(F.col("origin") == "own").select("file_id", "start_line").distinct()


def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, files and mark of every distinct target_name and symbol name (repeated rows count once)."""
    rows = termfreq.occurrences("usages.target_name", table(spark, sf, "usages"), "target_name").unionByName(
        termfreq.occurrences("symbols.name", table(spark, sf, "symbols").where(F.col("file_id") >= 0), "name"))
    n_files = table(spark, sf, "files").agg(F.count_distinct("file_id")).first()[0]
    return termfreq.marked(termfreq.frequencies(rows), n_files)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The terms that are too rare or too common to help a lookup."""
    return p3_terms(spark, sf).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Text units that hold natural language, with their language."""
    found = natural.text_languages(table(spark, sf, "text_units")).where(F.col("lang").isNotNull())
    return found.groupBy("file_id", "start_line", "start_col").agg(F.min("lang").alias("lang"))


def p4_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each language in the text of each file."""
    return natural.language_shares(table(spark, sf, "text_units"))


def p6_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every text, or of every piece of a text larger than one."""
    return packing.assign(table(spark, sf, "documents"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Segments, tokens and fill of every container."""
    return packing.containers(p6_assignment(spark, sf))


def p6_instructions(spark: SparkSession, sf: str) -> DataFrame:
    """Containers under three limits of which each binds: 8,192 tokens, 12 segments, 6,144 loss-bearing tokens."""
    return packing.containers(packing.assign(table(spark, sf, "documents"), segments=12, loss=6144))


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What any right assignment has: texts and tokens placed, texts with a byte left out or placed twice, texts split needlessly, containers over a limit."""
    a = p6_assignment(spark, sf)
    per_doc = a.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.max("end_byte").alias("size"), F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"))
    docs = per_doc.agg(
        F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.count_if((F.col("tokens") != F.col("size")) | (F.col("n") != F.col("pieces"))).alias("incomplete"),
        F.count_if((F.col("size") <= packing.CAPACITY) & (F.col("n") > 1)).alias("split_needlessly"))
    over = packing.containers(a).agg(F.count_if((F.col("tokens") > packing.CAPACITY) | (F.col("segments") > packing.SEGMENTS)).alias("over_limit"))
    return docs.withColumn("k", F.lit(1)).join(over.withColumn("k", F.lit(1)), "k").drop("k")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the assignment had to split."""
    return p6_assignment(spark, sf).where(F.col("pieces") > 1).select("doc_id").distinct()


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items with the spans to remove."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return p7_spans(spark, sf).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences.sentence_units(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p3_found, p3_terms, p4_found, p4_shares, p6_found, p6_assignment, p6_containers, p6_instructions, p6_totals, p7_found, p7_spans, p8_found)}

_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{85}}\x{{FEFF}}]+$', '', 'g')"
_TERMS = f"""
WITH t AS (SELECT 'usages.target_name' AS field, {_TRIM.format('target_name')} AS term, file_id FROM (SELECT DISTINCT * FROM usages)
           UNION ALL SELECT 'symbols.name', {_TRIM.format('name')}, file_id FROM (SELECT DISTINCT * FROM symbols WHERE file_id >= 0)),
     c AS (SELECT field, term, count(*) AS n_rows, count(DISTINCT file_id) AS n_files FROM t WHERE term <> '' GROUP BY field, term),
     m AS (SELECT *, CASE WHEN n_files < 3 THEN 'rare' WHEN n_files > 0.1 * (SELECT count(DISTINCT file_id) FROM files) THEN 'common' END AS mark FROM c)
"""

SQL = {
    "p3_terms": _TERMS + "SELECT field, term, n_rows, n_files, mark FROM m",
    "p3_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p6_totals": r"""SELECT count(*) AS docs, sum(strlen(text))::BIGINT AS tokens, 0::BIGINT AS incomplete, 0::BIGINT AS split_needlessly, 0::BIGINT AS over_limit
FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')""",
    "p6_found": r"SELECT doc_id FROM documents WHERE strlen(text) > 8192 AND regexp_matches(text, '[^\s\p{Z}]')",
}
