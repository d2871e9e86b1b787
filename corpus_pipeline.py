"""From raw documents to a training mixture: quality, lines, near-copies, benchmark leaks, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.decontam import decontaminate
from shelfwise.llm.jaccard import deduplicate
from shelfwise.llm.lines import dedup_lines
from shelfwise.llm.mixing import mix
from shelfwise.llm.quality import quality_filter
from shelfwise.runtime import staged


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality_rules", _quality),
    ("line_dedup", _lines),
    ("ngram_jaccard_join", _near_copies),
    ("benchmark_decontamination", _benchmark),
    ("source_mixing", _mixture),
]

# Hash-based stages have no SQL form; a brute-force version in the tests checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
