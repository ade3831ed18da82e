"""The corpus pipeline: documents through five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.cluster import discard, written
from edgeloom.llm import decontaminate, langid, line_dedup, near_dedup, queries


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return langid.drop_unidentified(docs, langid.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; all documents stay."""
    return line_dedup.drop_repeated_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, a similarity of 0.8) stays, that of the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; all others stay whole."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents goes."""
    return queries.packed(docs)


STAGES = [("language_id", identified), ("line_dedup", without_repeated_lines), ("simhash_near_dedup", without_near_copies), ("benchmark_decontamination", decontaminated), ("best_fit_packing", pack)]

#: Stages learn models and read tokenizers, which SQL can't; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        was, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(was)  # the given table stays
    return STAGES[-1][1](spark, docs, sf_dir)
