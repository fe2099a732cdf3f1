"""op5: documents linked by five-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .jaccard_join import jaccard_components


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERY = ("op5_jaccard_join", run)
ORACLE_SQL = None
