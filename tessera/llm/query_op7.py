"""op7: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import BASE_KINDS, find_personal_data


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_personal_data(docs).select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


QUERY = ("op7_pii", run)
ORACLE_SQL = None
