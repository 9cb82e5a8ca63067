"""The thin queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chaining, decontam, langid, license, linededup, ngramjoin, spfst, surrogate, tokencount, vecdedup
from .common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(read_table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.link(read_table(spark, sf_dir, "embeddings"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogate.pseudonymise(read_table(spark, sf_dir, "documents"), key="registered-query", counts=True)
    return out.select("doc_id", "n_entities", "text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(read_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(read_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    # on its own it has room for more cuts than beside the pipeline's other operators
    return spfst.encode_column(read_table(spark, sf_dir, "documents"), ids=False, most_cached=4 * spfst.MOST_CACHED)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_decontamination, op4_embedding_near_dedup, op5_pii_surrogates, op6_token_counts, op7_substring_dedup, op8_sentencepiece, op9_license_scan, op10_ngram_jaccard)}
QUERIES["pipeline"] = corpus_pipeline.run

_OP2 = f"""
WITH lines AS (
  SELECT doc_id, source, u.pos AS pos, u.line AS line FROM (
    SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'pos': i - 1, 'line': x}})) AS u FROM documents)),
spread AS (
  SELECT trim(line) AS l, min((doc_id, pos)) AS first FROM lines WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {linededup.MIN_SITES}),
marked AS (
  SELECT doc_id, pos, line, spread.l IS NOT NULL AND (doc_id, pos) <> first AS gone
  FROM lines LEFT JOIN spread ON trim(lines.line) = spread.l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
"""

ORACLE_SQL = {"op2_line_dedup": _OP2, "op9_license_scan": license.scan_sql()}
