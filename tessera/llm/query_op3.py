"""op3: benchmark items in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontamination import find_leaks


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it contains."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERY = ("op3_decontamination", run)
ORACLE_SQL = None
