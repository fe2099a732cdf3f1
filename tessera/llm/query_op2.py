"""op2: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lm_scoring import score_documents


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, the unigram score and the automaton's score of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY = ("op2_lm_scoring", run)
ORACLE_SQL = None
