"""A training-data pipeline: language ID, line dedup, near dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``. ``run`` writes each stage's rows to
the shared folder and reads them back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outsieve.llm import decontam, langid, linededup, ngramjoin, spfst
from outsieve.llm.common import keyed, read_table, scratch

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined, or under even odds, go."""
    return langid.keep(docs, LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all but their first place; every document stays."""
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays.

    Rows that repeat an id and its text are one document; one without id goes where its
    group has a document with one.
    """
    named, key = keyed(docs, "doc_id", "text")
    kept = ngramjoin.link(docs, hashes=True).where("doc_id <=> component_id")
    kept = scratch(kept.groupBy(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).alias(key)).agg(F.count("*").alias("n")))
    out = named.join(kept.where("n = 1").select(key), key, "left_semi")
    again = kept.where("n > 1").select(key)
    if not again.isEmpty():  # only rows that occur again are shuffled for one of each to stay
        out = out.unionByName(named.join(again, key, "left_semi").dropDuplicates([key]))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, hash of the ids and round trip of each document left."""
    return spfst.encode_column(docs, ids=False)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: Language ID and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
